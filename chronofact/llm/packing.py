"""Packing token pieces into fixed-length sequences, balanced by an estimate of attention cost."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str | None, pattern: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids of the tokenizer file. With ranks of the same vocabulary the faster library does the plain texts.

    A text that holds an added token's string goes to the tokenizer file's own library, which knows those tokens.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(json_path)
    slow = lambda t: np.array(own.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
    if ranks_path is None:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = [x.content for x in own.get_added_tokens_decoder().values()]
    return lambda t: slow(t) if any(a in t for a in added) else fast.encode_to_numpy(t, disallowed_special=())


def balance(lengths: np.ndarray, capacity: int, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in item, length) that hold all lengths, in as few sequences as their sum needs.

    An item costs length + quadratic * length**2 / capacity, linear layers plus attention. Items come in descending
    order; each goes to the cheapest sequence that still has room for it. One that fits nowhere is cut over the
    sequences with the most room.
    """
    count = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(count, capacity, dtype=np.int64), np.zeros(count)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    price = lambda n: n + quadratic * n * n / capacity
    for i in np.argsort(-lengths, kind="stable"):
        left, start = int(lengths[i]), 0
        while left:
            fits = room >= left
            at = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(left, int(room[at]))
            out[at].append((int(i), start, n))
            room[at] -= n
            cost[at] += price(n)
            start, left = start + n, left - n
    return out


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    end_id: int = 1,
    quadratic: float = 1.0,
    group: int = 4096,
    tokenizer: str | None = None,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Every task tokenizes its rows and cuts full sequences from long documents; the remainders of each ``group``
    documents are packed together by ``balance``. Nothing is shuffled, a task holds one group's remainders
    (under group * capacity ids), and each group pads at most its last few sequences. sequence_id is unique over the
    table: the partition in the high bits, a counter in the low 33.

    A null text counts as empty: end_id alone. Repeated rows are packed each by itself. Empty tables give empty
    results; other columns are ignored. By default the tokenizer is public_tokenizers' byte_bpe_50k.
    """
    if tokenizer is None:
        import public_tokenizers as public

        tokenizer, ranks, pattern = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks, pattern)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held: list[tuple] = []

        def flush() -> None:
            nonlocal sequence
            for pieces in balance(np.array([len(x[2]) for x in held], dtype=np.int64), capacity, quadratic):
                offset = 0
                for i, start, n in pieces:
                    doc, before, ids, total = held[i]
                    rows.append((doc, before + start, n, total, sequence, offset, ids[start : start + n].tobytes()))
                    offset += n
                sequence += 1
            held.clear()

        def batch() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], [*names, "ids"])
            rows.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                full = len(ids) // capacity * capacity
                for at in range(0, full, capacity):
                    rows.append((doc, at, capacity, len(ids), sequence, 0, ids[at : at + capacity].tobytes()))
                    sequence += 1
                if full < len(ids):
                    held.append((doc, full, ids[full:].copy(), len(ids)))
                if len(held) == group:
                    flush()
                if len(rows) >= 4096:
                    yield batch()
        if held:
            flush()
        if rows:
            yield batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL: dict[str, str] = {}
QUERIES = {"op6_packing": op6_packing}

"""Substring deduplication: suffix orders and longest previous factors of the places where a match is possible."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.anchors import segments
from chronofact.llm.shingles import mixed
from chronofact.session import materialize, partitions

#: Windows of one run of a crowded anchor are compared in stretches of so many, aligned to the anchor.
STEP = 32
#: Bytes of text looked at once, and bytes put in one suffix order.
CHUNK, LOT = 1 << 20, 1 << 18
_SPACE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")

KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
RUNS = pa.list_(pa.struct([("off", pa.int32()), ("n", pa.int32()), ("deep", pa.bool_())]))
RUNS_DDL = "array<struct<off:int,n:int,deep:boolean>>"


def _row_key(key: int | None, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=0 if key is None else (key & 0xFFFFFFFF) + 1) - (1 << 63)


def _names(parts: Iterable[bytes | memoryview]) -> np.ndarray:
    """128-bit BLAKE2 names of byte strings, as rows of two 64-bit integers: equal names are taken as equal bytes."""
    return np.frombuffer(bytearray().join([blake2b(x, digest_size=16).digest() for x in parts]), dtype="<i8").reshape(-1, 2)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, KINDS[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


OCC = "id long, rk long, start long, n int, at int, anchor long, na long, nb long"


def occurrences(docs: DataFrame, floor: int, length: int) -> DataFrame:
    """OCC rows of (id, text): runs of windows of ``floor`` bytes by anchor.

    A run's bytes reach ``length`` bytes from its last window's start, or to the text's end; (na, nb) names them.
    """
    schema = _schema(OCC)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []  # id, row key, place in text, length of the part, text
        size = 0

        def done() -> pa.RecordBatch:
            data = b"".join(x[4][x[2] : x[2] + x[3]] for x in group)
            ends = np.cumsum([x[3] for x in group])
            starts = np.append(0, ends[:-1])
            first, count, at, anchor = segments(data, starts, ends, floor)
            of = np.searchsorted(ends, first, side="right")
            start = first - starts[of] + np.array([x[2] for x in group], dtype=np.int64)[of]
            views = [memoryview(x[4]) for x in group]
            named = _names(views[i][s:e] for i, s, e in zip(of.tolist(), start.tolist(), (start + count + length - 1).tolist(), strict=True)).copy()
            named[:, 1] ^= mixed((count << 32 | at - first).astype(np.uint64)).view(np.int64)  # runs of other windows have other names
            ids = pa.array([x[0] for x in group], pa.int64()).take(pa.array(of))
            keys = np.array([x[1] for x in group], dtype=np.int64)[of]
            cols = [ids, keys, start, count.astype(np.int32), (at - first).astype(np.int32), anchor.view(np.int64), *np.ascontiguousarray(named.T)]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=schema)

        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                text = value.as_py() or b""
                if len(text) < floor:
                    continue
                row = _row_key(key, text)
                for at in range(0, len(text) - floor + 1, CHUNK):
                    part = min(len(text) - at, CHUNK + floor - 1)
                    if group and size + part > CHUNK:
                        yield done()
                        group, size = [], 0
                    group.append((key, row, at, part, text))
                    size += part
        if group:
            yield done()

    return docs.mapInArrow(task, OCC)


def packed(docs: DataFrame) -> DataFrame:
    """(id, rk, z) of (id, text): the row key and the compressed text, so that a shuffle moves less."""
    ddl = "id long, rk long, z binary"
    schema = _schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                ids = part.column(0).to_pylist()
                yield _batch([(i, _row_key(i, t), packer.compress(t)) for i, t in zip(ids, texts, strict=True)], schema)

    return docs.mapInArrow(task, ddl)


SEGMENT = "anchor long, na long, nb long, n int, at int, c long, crowded boolean, lid long, lrk long, lstart long, start long, id long, rk long, bytes binary"


def segment_bytes(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """SEGMENT rows: the bytes of each wanted run, cut from its text."""
    schema = _schema(SEGMENT)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for b in batches:
            runs = b.column(3).flatten()
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(3)).to_numpy())
            start = runs.field("start").to_numpy()
            stop = start + runs.field("n").to_numpy() + length - 1
            edge = np.searchsorted(of, np.arange(b.num_rows + 1)).tolist()
            parts, held, at = [], 0, 0

            def batch() -> pa.RecordBatch:
                cut = runs.slice(at, len(parts))
                rows = pa.array(of[at : at + len(parts)])
                return pa.RecordBatch.from_arrays([*cut.flatten(), b.column(0).take(rows), b.column(1).take(rows), pa.array(parts, pa.binary())], schema=schema)  # noqa: B023

            for i, z in enumerate(b.column(2)):
                text = reader.decompress(z.as_py())
                for s, e in zip(start[edge[i] : edge[i + 1]].tolist(), stop[edge[i] : edge[i + 1]].tolist(), strict=True):
                    parts.append(text[s:e])
                    held += len(parts[-1])
                    if held > 4 << 20:
                        yield batch()
                        at, parts, held = at + len(parts), [], 0
            yield batch()

    kept = ["anchor", "na", "nb", "n", "at", "c", "crowded", "lid", "lrk", "lstart", "start"]
    runs = wanted.groupBy(F.col("id").alias("wid"), F.col("rk").alias("wrk")).agg(F.collect_list(F.struct(*kept)).alias("runs"))
    joined = texts.join(runs, (F.col("rk") == F.col("wrk")) & F.col("id").eqNullSafe(F.col("wid")))
    return joined.select("id", "rk", "z", "runs").mapInArrow(task, SEGMENT)


def common_prefixes(data: bytes, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """lcp[i]: how many bytes the suffixes at starts[i - 1] and starts[i] share, of at most ``depth`` and their sizes."""
    wide = -(-depth // 8) * 8
    raw = np.frombuffer(data + bytes(wide), dtype=np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(raw, wide)
    lcp = np.zeros(len(starts), dtype=np.int64)
    for at in range(1, len(starts), 4096):
        part = rows[starts[at - 1 : at + 4096]]
        differ = part[:-1].view(np.uint64) != part[1:].view(np.uint64)
        word = np.where(differ.any(axis=1), differ.argmax(axis=1), wide // 8 - 1)
        row = np.arange(len(word))[:, None]
        inside = word[:, None] * 8 + np.arange(8)
        byte = part[:-1][row, inside] != part[1:][row, inside]
        lcp[at : at + len(word)] = word * 8 + np.where(byte.any(axis=1), byte.argmax(axis=1), 8)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(sizes[:-1], sizes[1:]))
    return np.minimum(lcp, depth)


def nearest_smaller(place: np.ndarray, lcp: np.ndarray, floor: int) -> np.ndarray:
    """For each row of a suffix order, the bytes shared with the nearest row before it of a smaller place, 0 under ``floor``.

    lcp[i] is what rows i - 1 and i share. A row points at the row before it, and while that has a larger place, on to
    where that one points: what lies between has larger places still. What is shared is the least lcp passed.
    """
    at, low = np.arange(len(place)) - 1, lcp.copy()
    low[:1] = 0
    wait = np.flatnonzero((at >= 0) & (low >= floor))
    wait = wait[place[at[wait]] > place[wait]]
    while len(wait):
        on = at[wait]
        low[wait], at[wait] = np.minimum(low[wait], low[on]), at[on]
        wait = wait[(at[wait] >= 0) & (low[wait] >= floor)]
        wait = wait[place[at[wait]] > place[wait]]
    return np.where((at >= 0) & (low >= floor), low, 0)


def previous_factors(data: bytes, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, floor: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): for each suffix of data, the longest match with a suffix of a smaller and of a larger place.

    Suffixes, of ``depth`` bytes at most, are put in lexicographic order; neighbours' common prefixes are measured on
    the bytes. Each suffix has the places in its column of ``places``, a second one of -1 being none; it stands in the
    order once for each, and so do the results. The longest previous factor is the larger of what a row shares with
    the nearest rows before and behind it, in suffix order, that have smaller places (previous and next smaller
    values); with larger places, it is the longest next factor. Factors under ``floor`` bytes read 0.
    """
    sizes = np.minimum(sizes, depth)
    keys = [data[s:e] for s, e in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
    lcp = common_prefixes(data, starts[order], sizes[order], depth)
    twice = places[1][order] >= 0
    row = np.repeat(np.arange(len(order)), 1 + twice)
    second = np.append(False, row[1:] == row[:-1])
    lcp = np.where(second, sizes[order][row], lcp[row])
    place = places[second.astype(np.int64), order[row]]
    back = np.append(0, lcp[:0:-1])  # the same order read from its end
    out = []
    for p in (place, -place):
        factor = np.maximum(nearest_smaller(p, lcp, floor), nearest_smaller(p[::-1], back, floor)[::-1])
        by = np.zeros(places.shape, dtype=np.int64)
        by[second.astype(np.int64), order[row]] = factor
        out.append(by)
    return out[0], out[1]


FOUND = f"anchor long, na long, nb long, hid long, hrk long, hstart long, first {RUNS_DDL}, other {RUNS_DDL}"
FOUND_SCHEMA = pa.schema([*((x, pa.int64()) for x in ("anchor", "na", "nb", "hid", "hrk", "hstart")), ("first", RUNS), ("other", RUNS)])


def _found(factor: np.ndarray, of: np.ndarray, inner: np.ndarray, entries: int, floor: int, length: int) -> pa.ListArray:
    """The runs of windows of each entry with a factor of ``floor`` bytes or more; deep ones reach ``length``."""
    state = (factor >= floor).astype(np.int8) + (factor >= length)
    edge = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | (of[1:] != of[:-1])))
    size = np.diff(np.append(edge, len(state)))
    edge, size = edge[state[edge] > 0], size[state[edge] > 0]
    offsets = np.searchsorted(of[edge], np.arange(entries + 1))
    cols = [pa.array(inner[edge].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(state[edge] == 2)]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(cols, fields=list(RUNS.value_type)))


def suffix_order(runs: DataFrame, floor: int, length: int, keep: str) -> DataFrame:
    """FOUND rows: of each run, the windows that match, at its first place and at its others.

    Runs of one anchor are kept whole in a partition and read in order, whole anchors at a time. Each lot is one text
    whose suffixes at window starts are put in suffix order; a run that occurs more than once stands in it with its
    first and its last place, and what holds for the last holds for all places but the first.
    """

    def ranks(*columns: pa.ChunkedArray) -> np.ndarray:
        """The rank of each (id, rk, start), null ids first; equal ones differ."""
        ids, rk, start = (pa.concat_arrays([x for c in cs for x in c.chunks]) for cs in zip(*columns, strict=True))
        by = np.lexsort((start.to_numpy(), rk.to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)))
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        return rank.reshape(len(columns), -1)

    def lot(table: pa.Table) -> pa.RecordBatch:
        parts = table["bytes"].to_pylist()
        size, m = np.array([len(x) for x in parts]), table["n"].to_numpy()
        most = int(m.max())
        rank = ranks(*([table[c] for c in cs] for cs in (("id", "rk", "start"), ("lid", "lrk", "lstart"))))
        of = np.repeat(np.arange(len(m)), m)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        begin = np.append(0, np.cumsum(size)[:-1])
        places = rank[:, of] * most + inner
        places[1, table["c"].to_numpy()[of] == 1] = -1
        before, after = previous_factors(b"".join(parts), begin[of] + inner, size[of] - inner, places, floor, length)
        matched = before if keep == "first" else np.maximum(before, after)
        first, other = (_found(x, of, inner, len(m), floor, length) for x in matched)
        some = (pc.list_value_length(first).to_numpy() > 0) | (pc.list_value_length(other).to_numpy() > 0)
        heads = [table[c].combine_chunks() for c in ("anchor", "na", "nb", "id", "rk", "start")]
        return pa.RecordBatch.from_arrays([*heads, first, other], schema=FOUND_SCHEMA).filter(pa.array(some))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            anchor = b.column(0).to_numpy()
            total = np.append(0, np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).to_numpy(), dtype=np.int64))
            fresh = np.flatnonzero(np.append(bool(held) and held[-1].column(0)[-1].as_py() != anchor[0], anchor[1:] != anchor[:-1]))
            at = 0
            for e in fresh.tolist():  # rows from e on have another anchor
                if size + total[e] - total[at] >= LOT:
                    yield lot(pa.Table.from_batches([*held, b.slice(at, e - at)]))
                    held, size, at = [], 0, e
            held.append(b.slice(at))
            size += int(total[-1] - total[at])
        if held:
            yield lot(pa.Table.from_batches(held))

    slim = runs.select("anchor", "na", "nb", "n", "c", "id", "rk", "start", "lid", "lrk", "lstart", "bytes")
    return slim.repartition(partitions(runs.sparkSession), "anchor").sortWithinPartitions("anchor", "na", "nb").mapInArrow(task, FOUND)


STRETCH = "anchor long, sub int, lead int, off int, m int, ca long, cb long, body binary, c long, na long, nb long, id long, rk long, start long"


def _stretches(at: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(sub, first window, windows) of a run: windows whose distance to the anchor is sub * STEP .. sub * STEP + STEP - 1."""
    w = 0
    while w < n:
        m = min(n - w, (at - w) % STEP + 1)
        yield (at - w) // STEP, w, m
        w += m


def stretches(runs: DataFrame, window: int) -> DataFrame:
    """STRETCH rows of runs: a name of the bytes that all windows of a full stretch share (ca, cb), and the stretch's own
    bytes. Windows equal in bytes have equal anchor, sub and core."""
    schema = _schema(STRETCH)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cores = [], []
            for r in b.to_pylist():
                data = r["bytes"]
                for sub, w, m in _stretches(r["at"], min(r["n"], len(data) - window + 1)):
                    begin = r["at"] - sub * STEP  # where the last window of a full stretch starts
                    cores.append(data[begin : begin - STEP + 1 + window])
                    rows.append((r["anchor"], sub, r["at"] - w - sub * STEP, w, m, data[w : w + m - 1 + window], r["c"], r["na"], r["nb"], r["id"], r["rk"], r["start"]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 12
            cols = [*cols[:5], *np.ascontiguousarray(_names(cores).T), *cols[5:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return runs.select("anchor", "na", "nb", "n", "at", "c", "id", "rk", "start", "bytes").mapInArrow(task, STRETCH)


WINDOW = "anchor long, sub int, ca long, cb long, sid long, d int, body binary, id long, rk long, start long"


def _windows(runs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """WINDOW rows: the bytes of each window of the stretches in question, d its distance to the anchor in the stretch."""
    schema = _schema(WINDOW)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows, data = [], r["bytes"]
                for x in r["parts"]:
                    for w in range(x["m"]):
                        at = x["off"] + w
                        rows.append((r["anchor"], x["sub"], x["ca"], x["cb"], x["sid"], x["lead"] - w, data[at : at + window], r["id"], r["rk"], r["start"]))
                    if len(rows) * window > 4 << 20:
                        yield _batch(rows, schema)
                        rows = []
                yield _batch(rows, schema)

    name = [F.col(c).alias(f"w_{c}") for c in ("anchor", "na", "nb")]
    parts = wanted.groupBy(*name).agg(F.collect_list(F.struct("sub", "ca", "cb", "sid", "lead", "off", "m")).alias("parts"))
    on = (F.col("anchor") == F.col("w_anchor")) & (F.col("na") == F.col("w_na")) & (F.col("nb") == F.col("w_nb"))
    return runs.join(parts, on).select("anchor", "id", "rk", "start", "bytes", "parts").mapInArrow(task, WINDOW)


def crowd_order(runs: DataFrame, window: int, deep: bool, keep: str) -> DataFrame:
    """FOUND rows for runs of anchors with too many windows for one task: the same windows, ordered by Spark.

    Windows of equal bytes have equal distances to the anchor, so runs are cut into stretches of 32 windows aligned to
    it; a stretch whose common core is unique (by name) cannot match, one whose bytes repeat matches whole. The windows of
    the stretches left are grouped by their bytes; their least and greatest place tell where an earlier and a later
    equal exists. Every grouping is summed before its shuffle, so no group meets in one task.
    """
    parts = materialize(stretches(runs, window), "stretches")
    core = ["anchor", "sub", "ca", "cb"]
    key = [*core, "body"]
    head = F.min(F.struct("id", "rk", "start", "na", "nb", "lead", "off", "m")).alias("head")
    wholes = materialize(parts.groupBy(*key).agg(F.sum("c").alias("f"), head).withColumn("sid", F.monotonically_increasing_id()), "wholes")
    cores = materialize(wholes.groupBy(*core).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "cores")
    open_ = wholes.join(cores, core).select("sid", *core, "head.na", "head.nb", "head.lead", "head.off", "head.m")
    windows = materialize(_windows(runs, open_, window), "windows")
    place = F.struct("id", "rk", "start")
    same = [*core, "d", "body"]
    groups = materialize(windows.groupBy(*same).agg(F.min(place).alias("least"), F.max(place).alias("most")).where("NOT (least <=> most)"), "groups")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("d"))
    flags = windows.join(groups, same).groupBy("sid").agg(
        F.sum(F.when(~place.eqNullSafe(F.col("least")), bit).otherwise(0)).alias("before"),
        F.sum(F.when(~place.eqNullSafe(F.col("most")), bit).otherwise(0)).alias("after"),
    )
    bits = materialize(wholes.join(flags, "sid", "left").select(*key, "f", "head", "before", "after"), "bits")
    own = F.struct(F.col("id"), F.col("rk"), F.col("start")).eqNullSafe(F.struct(F.col("head.id"), F.col("head.rk"), F.col("head.start")))
    every = F.lit(-1).cast("long")
    if keep == "first":
        mine = F.when(~own, every).otherwise(F.coalesce("before", F.lit(0)))
    else:
        mine = F.when(F.col("f") > 1, every).otherwise(F.coalesce(F.col("before").bitwiseOR(F.col("after")), F.lit(0)))
    marked = parts.join(bits, key).select("anchor", "na", "nb", "id", "rk", "start", "off", "m", "lead", "c", mine.alias("bits"))
    lists = marked.groupBy("anchor", "na", "nb", "id", "rk", "start").agg(F.max("c").alias("c"), F.collect_list(F.struct("off", "m", "lead", "bits")).alias("parts"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                first, other = [], []
                for x in r["parts"]:
                    other.append({"off": x["off"], "n": x["m"], "deep": deep})
                    first += [{"off": x["off"] + w, "n": 1, "deep": deep} for w in range(x["m"]) if x["bits"] == -1 or x["bits"] >> (x["lead"] - w) & 1]
                if first or r["c"] > 1:
                    rows.append((r["anchor"], r["na"], r["nb"], r["id"], r["rk"], r["start"], first, other if r["c"] > 1 else None))
            yield _batch(rows, FOUND_SCHEMA)

    return lists.select("anchor", "na", "nb", "id", "rk", "start", "c", "parts").mapInArrow(task, FOUND)


OUT = "id long, n_bytes long, spans array<struct<start:long,end:long>>, shared array<struct<start:long,end:long,words:long>>, kept binary"


def _whole_words(text: bytes, start: int, end: int) -> int:
    """Words of text that lie in start..end from their first to their last byte."""
    n = len(text[start:end].split())
    if n and start and text[start] not in _SPACE and text[start - 1] not in _SPACE:
        n -= 1
    if n and end < len(text) and text[end] not in _SPACE and text[end - 1] not in _SPACE:
        n -= 1
    return n


def _cut(texts: DataFrame, spans: DataFrame, floor: int, length: int) -> DataFrame:
    """OUT rows: the union of the spans of each text, and what lies outside those of ``length`` bytes."""
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    triple = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pair), ("shared", triple), ("kept", pa.binary())])

    def covered(size: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        edge = np.zeros(size + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        inside = np.cumsum(edge[:-1]) > 0
        cut = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()
        return inside, list(zip(cut[::2], cut[1::2], strict=True))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for b in batches:
            runs = b.column(2).flatten()
            size = pc.list_value_length(runs.field("runs")).to_numpy(zero_copy_only=False)
            each = runs.field("runs").flatten()
            first = np.repeat(runs.field("start").to_numpy(zero_copy_only=False), size) + each.field("off").to_numpy(zero_copy_only=False)
            last = first + each.field("n").to_numpy(zero_copy_only=False) - 1
            deep = each.field("deep").to_numpy(zero_copy_only=False)
            counts = pc.list_value_length(b.column(2)).fill_null(0).to_numpy()
            edge = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))].tolist()
            rows, held = [], 0
            for i, (key, z) in enumerate(zip(b.column(0), b.column(1), strict=True)):
                text = reader.decompress(z.as_py())
                spans, shared, kept = [], [], text
                if edge[i] < edge[i + 1]:
                    f, e, d = (x[edge[i] : edge[i + 1]] for x in (first, last, deep))
                    shared = [{"start": s, "end": t, "words": _whole_words(text, s, t)} for s, t in covered(len(text), f, e + floor)[1]]
                    if d.any():
                        inside, cut = covered(len(text), f[d], e[d] + length)
                        spans = [{"start": s, "end": t} for s, t in cut]
                        kept = np.frombuffer(text, dtype=np.uint8)[~inside].tobytes()
                rows.append((key.as_py(), len(text), spans, shared, kept))
                held += len(kept)
                if held > 4 << 20:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    lists = spans.groupBy(F.col("id").alias("sid"), F.col("rk").alias("srk")).agg(F.collect_list(F.struct("start", "runs")).alias("runs"))
    joined = texts.join(lists, (F.col("rk") == F.col("srk")) & F.col("id").eqNullSafe(F.col("sid")), "left")
    return joined.select("id", "z", "runs").mapInArrow(task, OUT)


def suffix_dedup(
    docs: DataFrame, length: int = 400, keep: str = "first", floor: int | None = None, crowd: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id_col, n_bytes, spans (removed byte ranges), shared (ranges repeated at ``floor``), kept.

    Removed is each byte covered by a string of ``length`` bytes that also starts elsewhere, in this text or another,
    judged on the input. keep="first" spares the first place of each string (by id, then place), as longest previous
    factors do; keep="none" removes it there too. ``shared`` is the same for strings of ``floor`` bytes (at most, and
    by default, ``length``), which are reported, not removed. Each range has its number of whole words.

    Not every suffix can match, so not every one is sorted. (1) Each window of ``floor`` bytes chooses an anchor in
    it by content, so equal windows have equal anchors; windows whose anchor occurs once are done. (2) Runs of windows with
    one anchor are counted by their bytes (a 128-bit BLAKE2 name), and a run that occurs often goes on with its first and
    last place. (3) The runs of an anchor meet in one task, where all suffixes at their windows are put in suffix
    order; longest previous and next factors, from previous and next smaller positions, decide each window on its
    bytes. Anchors whose different runs have more than ``crowd`` windows cannot meet in one task: Spark orders the bytes of
    these windows instead (``crowd_order``), which decides the same. Counts are partial sums before each shuffle; texts move
    compressed, twice, and only run numbers and the bytes of distinct repeated runs otherwise.

    Texts are taken as UTF-8 bytes, null as empty; texts under ``floor`` bytes lose nothing. Rows equal in id and
    text count as different places of one document: with keep="none" both lose what they share, with keep="first"
    neither does for being equal. Empty tables give empty results; other columns are ignored.
    """
    floor = length if floor is None else min(floor, length)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    occ = materialize(occurrences(slim, floor, length), "occ")
    twice = materialize(occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "anchors")
    occ = materialize(occ.join(twice, "anchor"), "occ2")
    name = ["anchor", "na", "nb"]
    ends = F.struct("id", "rk", "start")
    variants = materialize(occ.groupBy(*name, "n", "at").agg(F.count(F.lit(1)).alias("c"), F.min(ends).alias("first"), F.max(ends).alias("last")), "variants")
    crowds = materialize(variants.groupBy("anchor").agg(F.sum("n").alias("v")).where(F.col("v") > crowd).select("anchor", F.lit(True).alias("crowded")), "crowds")
    crowded = not crowds.isEmpty()
    marked = variants.join(crowds, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))) if crowded else variants.withColumn("crowded", F.lit(False))
    wanted = marked.select(*name, "n", "at", "c", "crowded", "first.*", *[F.col(f"last.{c}").alias(f"l{c}") for c in ("id", "rk", "start")])
    texts = packed(slim)
    runs = materialize(segment_bytes(texts, wanted, length), "runs")
    found = suffix_order(runs.where("NOT crowded"), floor, length, keep)
    if crowded:
        hot = runs.where("crowded")
        for window, deep in {length: True, floor: floor == length}.items():
            found = found.union(crowd_order(hot, window, deep, keep))
    found = materialize(found, "found")
    here = F.struct("id", "rk", "start").eqNullSafe(F.struct(F.col("hid").alias("id"), F.col("hrk").alias("rk"), F.col("hstart").alias("start")))
    spans = occ.join(found, name).select("id", "rk", "start", F.when(here, F.col("first")).otherwise(F.col("other")).alias("runs")).where("size(runs) > 0")
    return _cut(texts, materialize(spans, "spans"), floor, length).withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The prescribed columns, for strings of 400 bytes; n_passages counts the maximal runs covered by strings of 256 bytes that
    start elsewhere, too, and with over 50 whole words: those under 400 bytes stay in the text."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 400, keep="none", floor=256)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    passages = F.size(F.filter("shared", lambda x: x["words"] > 50)).cast("long")
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), passages.alias("n_passages")
    )


SQL: dict[str, str] = {}
QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}

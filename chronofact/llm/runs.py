"""Periodic runs of words: all maximal repetitions of each text, from the Lyndon arrays of both orders of its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.exact_dedup import SPACE

#: Bytes of text worked on at once; a longer text is worked on alone.
GROUP = 4 << 20


def lyndon(w: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix, the next smaller one (the end, if none) and how many letters both share; letters are only compared.

    [i, next[i]) is the longest Lyndon word that starts at i. Suffixes are taken from left to right; a stack, linked by
    ``before``, holds those without a smaller one so far, each with the letters it shares with the one below. So a suffix
    going down the stack starts to compare where the last comparison ended, and only where both lengths are equal.

    The comparison that reached farthest is kept: from ``right`` to ``reach`` the word repeats what lies ``shift`` letters
    earlier. Two suffixes there share as many letters as their images did, if those were compared and stay
    within the reach; else letters are compared from the reach on, which moves it. So every letter is passed once or so.
    """
    n = len(w)
    after, shared = [n] * n, [0] * n
    before, common = [-1] * n, [0] * n
    right = reach = shift = 0
    for i in range(1, n):
        j = i - 1
        if w[j] < w[i]:
            before[i] = j
            continue
        same, known = 0, False
        while True:
            if not known:
                if i < reach:
                    b = i - shift
                    if j >= right:
                        a = j - shift
                        k = common[b] if before[b] == a else shared[a] if after[a] == b else -1
                    else:
                        k = common[b] if before[b] == j else -1
                    if k >= 0:
                        if i + k < reach:
                            same = k
                            known = True
                        elif i + same < reach:
                            same = reach - i
                if not known:
                    x, y = j + same, i + same
                    while y < n and w[x] == w[y]:
                        x += 1
                        y += 1
                    same = y - i
                    if y > reach:
                        right, reach, shift = i, y, i - j
            y = i + same
            if y < n and w[j + same] < w[y]:
                before[i], common[i] = j, same
                break
            after[j], shared[j] = i, same
            below = common[j]
            j = before[j]
            if j < 0:
                break
            if below < same:
                before[i], common[i] = j, below
                break
            known = below > same
    return after, shared


def runs(w: np.ndarray, least: int = 2) -> np.ndarray:
    """(start, length, period) of the maximal repetitions of w, at least ``least`` long, by start and period.

    Each run has a Lyndon word of its period's length for the order of letters or for the reverse order, and that
    is the longest Lyndon word at its start; so the runs are those of these words whose repeats to the right and to the
    left have the period's length together. The right ones are known from ``lyndon``. The left ones are
    compared at the first such word of a run alone, where they are shorter than the period.
    """
    n = len(w)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for letters in (w, -w):
        after, shared = (np.array(x, dtype=np.int64) for x in lyndon(letters.tolist()))
        i = np.flatnonzero(shared >= 1)
        end, r = after[i], shared[i]
        p = end - i
        again = np.flatnonzero(i >= p)
        first = np.ones(len(i), dtype=bool)
        first[again] = (after[i[again] - p[again]] != i[again]) | (shared[i[again] - p[again]] < p[again])
        preceded = (i > 0) & (w[np.maximum(i - 1, 0)] == w[end - 1])
        good = np.flatnonzero(first & ((r >= p) | preceded) & (2 * p + r - 1 >= least))
        if not len(good):
            continue
        left = _left(letters, i[good], p[good])
        i, p, r = i[good], p[good], r[good]
        run = (left + r >= p) & (p + left + r >= least)
        found.append(np.stack([i - left, p + left + r, p], axis=1)[run])
    return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _left(w: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """How many letters before each end equal those a period later.

    From right to left, with the comparison that reached farthest kept as in ``lyndon``: before ``top``, down to ``reach``, the word
    repeats what lies ``shift`` letters later, where the same period was compared already.
    """
    w, out = w.tolist(), [0] * len(ends)
    done, of = [-1] * len(w), [0] * len(w)
    reach, top, shift = len(w), len(w), 0
    for at in range(len(ends) - 1, -1, -1):
        i, p = int(ends[at]), int(periods[at])
        same = 0
        if reach < i and i + p <= top:
            k = done[i + shift] if of[i + shift] == p else -1
            if k >= 0:
                if i - k > reach:
                    done[i], of[i], out[at] = k, p, k
                    continue
                same = i - reach
        x = i - 1 - same
        y = x + p
        while x >= 0 and w[x] == w[y]:
            x -= 1
            y -= 1
        same = i - 1 - x
        done[i], of[i], out[at] = same, p, same
        if x + 1 < reach:
            reach, top, shift = x + 1, i, p
    return np.array(out, dtype=np.int64)


def _stretches(text: np.ndarray, codes: np.ndarray, least: int, rounds: int = 4) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that can hold runs: in a run each word occurs twice, so a word that a stretch holds once cuts it.

    Further ``rounds`` would cut some stretches further; they change no result.
    """
    place, part = np.arange(len(codes)), text
    for _ in range(rounds):
        if not len(place):
            break
        order = np.lexsort((codes[place], part))
        p, c = part[order], codes[place][order]
        new = np.append(True, (p[1:] != p[:-1]) | (c[1:] != c[:-1]))
        lone = new & np.append(new[1:], True)
        keep = np.ones(len(place), dtype=bool)
        keep[order[lone]] = False
        place, old = place[keep], part[keep]
        cut = np.append(True, (np.diff(place) != 1) | (old[1:] != old[:-1]))[: len(place)]
        part = np.cumsum(cut) - 1
        long = np.bincount(part, minlength=1)[part] >= least if len(part) else np.zeros(0, dtype=bool)
        place, part = place[long], part[long]
        if keep.all() and long.all():
            break
    edge = np.append(np.flatnonzero(np.append(True, np.diff(part) != 0)[: len(part)]), len(place))
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _collapse(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    """For each text its runs and the text without their repeats."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    word = lists.flatten()
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
    word, of = word.filter(pa.array(real)), of[real]
    first = np.searchsorted(of, np.arange(len(lists) + 1))
    named = word.dictionary_encode()
    rank = np.empty(len(named.dictionary), dtype=np.int64)
    rank[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(len(rank))
    codes = rank[named.indices.to_numpy()] if len(word) else np.zeros(0, dtype=np.int64)
    rows, owner = [], []
    gone = np.zeros(len(codes) + 1, dtype=np.int64)
    for a, b in _stretches(of, codes, least):
        found = runs(codes[a:b], least)
        if len(found):
            found = found + np.array([a, 0, 0])
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.add.at(gone, found[:, 0] + found[:, 1], -1)
            rows.append(found - np.array([first[of[a]], 0, 0]))
            owner.append(np.full(len(found), of[a]))
    table = np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)
    owner = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
    cut = lambda of: np.searchsorted(of, np.arange(len(lists) + 1)).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["start", "length", "period"])
    stay = np.cumsum(gone[:-1]) == 0
    left = pa.ListArray.from_arrays(pa.array(cut(of[stay])), word.filter(pa.array(stay)).cast(pa.string()))
    return pa.ListArray.from_arrays(pa.array(cut(owner)), struct), pc.binary_join(left, " ")


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of rows whose texts have about GROUP bytes together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + GROUP, side="right")))
        yield at, end
        at = end


def periodic_runs(docs: DataFrame, least: int = 12, text_col: str = "text") -> DataFrame:
    """docs' columns, with ``runs``, an array of (start, length, period) by start and period, and ``collapsed``, the text without repeats.

    Words are what white space of ASCII separates, numbered from 0. A run is a stretch of words in which those ``period`` apart are equal, no
    smaller period being possible, of ``least`` words and two periods or more, which neither neighbour continues. A word
    goes if a run contains it after its first period; those that stay are joined by single spaces. A text without a
    run comes back with single spaces too.

    Words become numbers in the order of their bytes (equal words by comparing them: an exact dictionary of each
    group of texts); from there letters are only compared. Each text is worked on whole, in its own row, in time
    linear in its words; nothing is shuffled, so equal texts in any number are rows like others.

    Null and empty texts have no runs and an empty ``collapsed``. Rows that repeat, null ids and columns of other names are kept
    as they come; columns named ``runs`` or ``collapsed`` are replaced. An empty table gives an empty result.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("runs", "collapsed")])
    names = [f"_c{i}" for i in range(len(kept.columns))]
    at = kept.columns.index(text_col)
    slim = kept.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept.columns, names, strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(batch.column(at)):
                part = batch.slice(a, b - a)
                found, collapsed = _collapse(part.column(at), least)
                yield pa.RecordBatch.from_arrays([*part.columns, found, collapsed], names=[*part.schema.names, "runs", "collapsed"])

    schema = slim.withColumns({"runs": F.expr("CAST(NULL AS array<struct<start: bigint, length: bigint, period: bigint>>)"), "collapsed": F.lit(None).cast("string")}).schema
    out = slim.mapInArrow(work, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept.columns, names, strict=True)], "runs", "collapsed")


def planted(words: Column, h: Column) -> Column:
    """Of a text's words, those from place a on replaced by repeats of the p words there, where h says so."""
    n, g = F.size("words"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(tail, " "))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of ``documents``, a tenth of which end in a planted repetition; rows with a null id have none planted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    split = F.when(F.col("h") % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda x: x != ""))
    worded = docs.select("*", F.explode(F.array(split)).alias("words"))
    found = periodic_runs(worded.select("doc_id", F.coalesce(planted(F.col("words"), F.col("h")), "text").alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest.alias("top"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("top.back")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.short")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.short")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


#: SQL has no fit form: a run's period and ends need all pairs of places of a text. The tests hold the query against all pairs in plain Python.
SQL: dict[str, str] = {}
QUERIES = {"op11_periodic_runs": op11_periodic_runs}

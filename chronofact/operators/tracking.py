"""Tracks of recognised text over sampled frames, and the string similarity they use (Arrow batches; SQL lacks both)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.session import materialize, partitions

TRACKS = "video_id string, text string, start double, end double, first_ts double, last_ts double, frame_count long, confidence double, stable boolean"


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of normalised lines; 0 when one is under half as long as the other."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 0.5 * max(len(a), len(b)):
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def grams(text: str) -> list[Counter]:
    """How often each string of one, two and three characters stands in the text."""
    return [Counter(text[i : i + n] for i in range(len(text) - n + 1)) for n in (1, 2, 3)]


def may_reach(a: str, b: str, of_a: list[Counter], of_b: list[Counter], least: float) -> bool:
    """False only where ``similarity(a, b)`` is surely under ``least``: a test without alignment.

    Let m characters match, in blocks with an unmatched character between any two: of both texts' s characters s - 2m
    are unmatched, so there are at most s - 2m + 1 blocks, and a block of k characters shares k - n + 1 strings of n
    characters. Hence m <= (shared + (n - 1) * (s + 1)) / (2n - 1), and the ratio is 2m / s.
    """
    s = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * s - 1e-9:
        return False
    return all(2 * ((x & y).total() + (n - 1) * (s + 1)) / (2 * n - 1) >= least * s - 1e-9 for n, (x, y) in enumerate(zip(of_a, of_b, strict=True), 1))


def _overlap(p: tuple, q: tuple) -> float:
    if any(v is None or v != v for v in (*p, *q)):
        return 1.0
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return w * h / (area(p) + area(q) - w * h)


def observed(text: str, confidence: float | None, box: tuple) -> dict:
    """An observation as ``advance`` pairs it: its normalised line and that one's strings, besides what was read."""
    norm = " ".join(text.lower().split())
    return {"norm": norm, "grams": grams(norm), "text": text, "box": box, "confidence": None if confidence is None or confidence != confidence else float(confidence)}


def advance(live: list[dict], t: float, new: list[dict], least: float, box: float, max_gap: float) -> list[dict]:
    """Take a recording's open tracks one frame on, in place; returns those that close.

    Tracks not seen for max_gap seconds close. Open ones and the frame's observations are paired best first, one to one,
    when their texts are alike and their boxes overlap; observations without a pair open tracks. A track keeps sums of
    what it has seen, its best reading (of equals the first) and the first frame after it was seen last.
    """
    for k in live:
        k["next"] = t if k["next"] is None else k["next"]
    closed = [k for k in live if t - k["last"] > max_gap]
    live[:] = [k for k in live if t - k["last"] <= max_gap]
    near = (
        (i, j, k["norm"], n["norm"], o)
        for i, k in enumerate(live)
        for j, n in enumerate(new)
        if (k["norm"] == n["norm"] or may_reach(k["norm"], n["norm"], k["grams"], n["grams"], least)) and (o := _overlap(k["box"], n["box"])) >= box
    )
    pairs = sorted(((s, o, i, j) for i, j, a, b, o in near if (s := similarity(a, b)) >= least), key=lambda p: (-p[0], -p[1], p[2], p[3]))
    met: dict[int, int] = {}
    for _, _, i, j in pairs:
        if j not in met and i not in met.values():
            met[j] = i
    for j, n in enumerate(new):
        if j not in met:
            live.append({"first": t, "count": 0, "sum": 0.0, "known": 0, "best": (-2.0, -1), "text": ""})
        k = live[met.get(j, -1)]
        sure = n["confidence"]
        k |= {"norm": n["norm"], "grams": n["grams"], "box": n["box"], "last": t, "next": None, "count": k["count"] + 1, "sum": k["sum"] + (sure or 0.0), "known": k["known"] + (sure is not None)}
        rank = (-1.0 if sure is None else sure, len(n["text"]))
        if rank > k["best"]:
            k |= {"best": rank, "text": n["text"]}
    return closed


def finished(video: str, k: dict, duration: float) -> tuple:
    """A track as a row of TRACKS: it ends half way to the first frame without it, or at the recording's end."""
    end = duration if k["next"] is None else (k["last"] + k["next"]) / 2
    return (video, k["text"], k["first"], end, k["first"], k["last"], k["count"], round(k["sum"] / k["known"], 4) if k["known"] else None, k["count"] > 1)


def text_tracks(observations: DataFrame, frames: DataFrame, durations: DataFrame, least: float = 0.88, box: float = 0.30, max_gap: float = 3.0) -> DataFrame:
    """Intervals of text from observations (video_id, ts, text, confidence, x1, y1, x2, y2) over sampled frames (video_id, ts).

    Each recording's frames are gone through in order (``advance``). One group is one recording, its state the open tracks;
    ``streaming.tracks`` does the same over a stream.
    """
    seen = frames.select("video_id", "ts").distinct().withColumn("text", F.lit(None).cast("string"))
    rows = observations.select("video_id", "ts", "text", "confidence", "x1", "y1", "x2", "y2").unionByName(seen, allowMissingColumns=True).join(durations, "video_id")

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        video, total = pdf.video_id.iloc[0], float(pdf.duration.iloc[0])
        by = {t: g for t, g in pdf[pdf.text.notna()].groupby("ts")}
        live: list[dict] = []
        out = []
        for t in sorted(set(pdf.ts)):
            new = [observed(r.text, r.confidence, (r.x1, r.y1, r.x2, r.y2)) for r in by[t].itertuples()] if t in by else []
            out += [finished(video, k, total) for k in advance(live, t, new, least, box, max_gap)]
        out += [finished(video, k, total) for k in live]
        out.sort(key=lambda r: (r[2], r[3], r[1]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in TRACKS.split(", ")])

    return rows.groupBy("video_id").applyInPandas(track, TRACKS)


def tile_differences(frames: np.ndarray, tiles: int = 16) -> np.ndarray:
    """For each of a row of square grey pictures (flat) the greatest mean absolute difference of any tile from the one before; 0 for the first."""
    side = round(frames.shape[1] ** 0.5)
    if side * side != frames.shape[1] or side % tiles:
        raise ValueError(f"pictures of {frames.shape[1]} points are no squares of {tiles} by {tiles} tiles")
    step = np.abs(np.diff(frames, axis=0)).reshape(-1, tiles, side // tiles, tiles, side // tiles)
    return np.append(np.zeros(min(1, len(frames))), step.mean(axis=(2, 4)).max(axis=(1, 2)) if len(frames) > 1 else [])


def tile_runs(frames: DataFrame, most: float, tiles: int = 16, pixels: str = "pixels") -> DataFrame:
    """(video_id, ts, run): frames (video_id, ts, pixels) numbered by runs; one begins where a tile differs by over ``most`` from the frame before.

    Frames are dealt by range of recording and time and sorted, so a long recording lies in several tasks; each task scans
    its frames in Arrow batches and carries the last one from batch to batch. The first and the last frame of each
    task, two rows a task, are compared over the cuts. Pictures are never shuffled but for that dealing. Frames that are null
    are left out.
    """
    given = frames.where(F.col(pixels).isNotNull()).select("video_id", F.col("ts").cast("double").alias("ts"), F.col(pixels).cast("array<double>").alias("pixels"))
    spark = frames.sparkSession
    schema = "video_id string, ts double, part int, edge string, cut boolean, pixels array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def rows(video: list, ts: list, edge: str | None, cut: list, pictures: list) -> pa.RecordBatch:
            n = len(video)
            cols = [pa.array(video, pa.string()), pa.array(ts, pa.float64()), pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(cut, pa.bool_()), pa.array(pictures, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(cols, names=["video_id", "ts", "part", "edge", "cut", "pixels"])

        for b in batches:
            if not b.num_rows:
                continue
            video, ts, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            pictures = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if last is None:
                yield rows(video[:1], ts[:1], "first", [None], [pictures[0].tolist()])
                held, before = pictures, [None, *video[:-1]]
            else:
                held, before = np.vstack([last[2], pictures]), [last[0], *video[:-1]]
            far = tile_differences(held, tiles)[-b.num_rows :] > most
            cut = [bool(x) or v != w for x, v, w in zip(far, video, before, strict=True)]
            yield rows(video, ts, None, cut, [None] * b.num_rows)
            last = (video[-1], ts[-1], pictures[-1])
        if last is not None:
            yield rows([last[0]], [last[1]], "last", [None], [last[2].tolist()])

    order = ["video_id", "ts"]
    scanned = materialize(given.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(scan, schema), "frames")
    # Over the cuts: the first frame of a task against the last of the task before, if they are of one recording.
    ends = scanned.where("edge IS NOT NULL").withColumn("_e", F.col("edge") == "last")
    w = Window.orderBy("part", "_e")
    near = ends.select("video_id", "ts", "part", "edge", "pixels", F.lag("video_id").over(w).alias("pv"), F.lag("pixels").over(w).alias("pp")).where("edge = 'first' AND pv = video_id")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [float(tile_differences(np.array([p, q]), tiles)[1]) <= most for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.bool_())], names=["video_id", "ts", "same"])

    joined = near.select("video_id", "ts", "pp", "pixels").mapInArrow(over, "video_id string, ts double, same boolean").where("same")
    flags = scanned.where("edge IS NULL").select("video_id", "ts", "cut").join(joined, ["video_id", "ts"], "left")
    begins = F.when(F.col("cut") & ~F.coalesce("same", F.lit(False)), 1).otherwise(0)
    run = F.sum(begins).over(Window.partitionBy("video_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return flags.select("video_id", "ts", run.alias("run"))


def replayed(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (video_id, ts, and what was read from the frame) copied to every frame of their frame's run (``tile_runs``)."""
    read = rows.join(runs, ["video_id", "ts"]).withColumnRenamed("ts", "read_at")
    return runs.join(read, ["video_id", "run"]).select("video_id", "ts", "run", "read_at", *[c for c in rows.columns if c not in ("video_id", "ts")])

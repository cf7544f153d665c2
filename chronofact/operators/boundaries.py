"""Scene boundaries from several signals, windows of one rate, and segment cuts that spare sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators.intervals import islands

#: Seconds within which signals agree, least scene length, score of a strong cut, seconds a cut may move.
SAME, MIN_SCENE, STRONG, SNAP = 0.05, 1.5, 0.9, 3.0


def budgeted(cuts: DataFrame, durations: DataFrame, threshold: float = 0.5, per_minute: float = 4.0) -> DataFrame:
    """Cuts (video_id, ts, score, signal) of at least ``threshold``, and the best others while the density allows."""
    strong = F.col("score") >= threshold
    w = Window.partitionBy("video_id")
    room = F.greatest(F.lit(1), F.bround(F.col("duration") / 60.0 * per_minute).cast("int")) - F.sum(strong.cast("int")).over(w)
    place = F.row_number().over(w.orderBy(strong, F.desc("score"), "ts", "signal"))  # weak ones come first
    marked = cuts.join(durations, "video_id").withColumns({"_room": room, "_place": place, "_strong": strong})
    return marked.where(F.col("_strong") | (F.col("_place") <= F.col("_room"))).select("video_id", "ts", "score", "signal", "duration")


def arbitrated(cuts: DataFrame, least: float = MIN_SCENE) -> DataFrame:
    """(video_id, duration, cuts): each recording's cuts in order, those at one instant joined, too close ones decided.

    Of two strong cuts closer than ``least`` the later stays, as a flash; else the one with more signals, then the
    higher score, stays, the earlier on ties. What is kept decides what comes next, so both are folds over a recording.
    """
    rows = cuts.groupBy("video_id", "duration").agg(F.array_sort(F.collect_list(F.struct("ts", "score", F.array("signal").alias("signals")))).alias("c"))
    none = F.filter("c", lambda x: F.lit(False))
    last = lambda kept: F.element_at(kept, -1)
    head = lambda kept: F.slice(kept, 1, F.size(kept) - 1)
    cut = lambda ts, score, signals: F.struct(ts.alias("ts"), score.alias("score"), signals.alias("signals"))

    def join(kept: Column, x: Column) -> Column:
        p = last(kept)
        both = cut(p["ts"], F.greatest(p["score"], x["score"]), F.array_union(p["signals"], x["signals"]))
        return F.when(F.size(kept) == 0, F.array(x)).when(x["ts"] - p["ts"] <= SAME, F.array_append(head(kept), both)).otherwise(F.array_append(kept, x))

    def choose(kept: Column, x: Column) -> Column:
        p = last(kept)
        flash = cut(x["ts"], x["score"], F.array_union(F.array_union(x["signals"], p["signals"]), F.array(F.lit("flash"))))
        rank = lambda y: F.struct(F.size(y["signals"]), y["score"])
        return (
            F.when((x["ts"] <= 0) | (x["ts"] >= F.col("duration")), kept)
            .when(F.size(kept) == 0, F.array(x))
            .when(x["ts"] - p["ts"] >= least, F.array_append(kept, x))
            .when((p["score"] >= STRONG) & (x["score"] >= STRONG), F.array_append(head(kept), flash))
            .when(rank(x) > rank(p), F.array_append(head(kept), x))
            .otherwise(kept)
        )

    joined = rows.select("video_id", "duration", F.explode(F.array(F.aggregate("c", none, join))).alias("c"))
    return joined.select("video_id", "duration", F.explode(F.array(F.aggregate("c", none, choose))).alias("cuts"))


def boundary_spans(arranged: DataFrame) -> DataFrame:
    """Scenes that tile each recording: (video_id, start, end, score, signals, keyframe) from ``arbitrated`` cuts."""
    first = F.struct(F.lit(0.0).alias("ts"), F.lit(None).cast("double").alias("score"), F.array(F.lit("start")).alias("signals"))
    rows = arranged.where("duration > 0").select("video_id", "duration", F.posexplode(F.concat(F.array(first), "cuts")).alias("i", "x"))
    end = F.coalesce(F.lead("x.ts").over(Window.partitionBy("video_id").orderBy("i")), F.col("duration"))
    spans = rows.select("video_id", F.col("x.ts").alias("start"), end.alias("end"), "x.score", "x.signals").where(F.col("end") - F.col("start") > 1e-3)
    key = F.col("start") + F.least(F.lit(0.5), (F.col("end") - F.col("start")) / 2)
    return spans.select("video_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "score", F.array_join("signals", "+").alias("signals"), F.round(key, 3).alias("keyframe"))


def same_rate_windows(windows: DataFrame, gap: float = 1.0) -> DataFrame:
    """Windows (video_id, start, end, fps, reason) in order, neighbours of one rate within ``gap`` joined; reasons that differ read mixed."""
    w = Window.partitionBy("video_id").orderBy("start", "end", "fps", "reason")
    fresh = F.when(F.abs(F.col("fps") - F.lag("fps").over(w)) < 1e-9, 0).otherwise(1)
    blocks = windows.withColumn("_f", fresh).withColumn("block", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")
    runs = islands(blocks, ["video_id", "block"], gap, ("start", "end", "reason"))
    reason = F.when(F.min("reason") == F.max("reason"), F.min("reason")).otherwise("mixed")
    return runs.groupBy("video_id", "block", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("fps").alias("fps"), reason.alias("reason")).drop("block", "island")


def snapped_segments(scenes: DataFrame, utterances: DataFrame, longest: float = 45.0, snap: float = SNAP) -> DataFrame:
    """Windows that tile each recording, as ``plan_segments`` makes them, their inner cuts moved to the nearest silence.

    A cut moves to the middle of the nearest gap between utterances when that is within ``snap`` seconds. Gaps are an
    array a recording; each scene's cuts are one row's arrays.
    """
    t = Window.partitionBy("video_id").orderBy("start", "end", "fact_id")
    gaps = utterances.select("video_id", F.lag("end").over(t).alias("a"), F.col("start").alias("b")).where("b > a")
    gaps = gaps.groupBy("video_id").agg(F.array_sort(F.collect_list((F.col("a") + F.col("b")) / 2)).alias("gaps"))
    w = Window.partitionBy("video_id").orderBy("start", "end")
    closed = scenes.select("video_id", F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.col("start")).alias("s"), F.coalesce(F.lead("start").over(w), F.col("end")).alias("e"))
    rows = closed.where("e > s").join(gaps, "video_id", "left").withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("s")) / longest).cast("int")))
    cuts = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - 1)), lambda i: F.col("s") + i * ((F.col("e") - F.col("s")) / F.col("n")))).otherwise(F.array().cast("array<double>"))
    nearest = lambda c: F.array_min(F.transform("gaps", lambda g: F.struct(F.abs(g - c).alias("d"), g.alias("g"))))
    moved = F.transform(cuts, lambda c: F.when(F.coalesce(nearest(c)["d"] <= snap, F.lit(False)), nearest(c)["g"]).otherwise(c))
    edges = F.concat(F.array("s"), F.array_sort(F.filter(moved, lambda c: (c > F.col("s")) & (c < F.col("e")))), F.array("e"))
    pieces = rows.select("video_id", F.explode(F.array(edges)).alias("x")).select("video_id", F.explode(F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))).alias("p"))
    return pieces.where(F.col("p.end") - F.col("p.start") > 1e-6).select("video_id", "p.start", "p.end")

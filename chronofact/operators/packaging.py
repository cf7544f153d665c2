"""Budgeted packaging of evidence: deduplication, containment, anchors, budgets, spacing; every cut is in a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.timecode import format_span, format_timecode
from chronofact.operators.intervals import interval_join, merge_windows, window_around


def token_estimate(text: Column, per_span: int = 50) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4) + per_span


def distinct_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The first span of each (keys, ref_ids) in rank order."""
    w = Window.partitionBy(*keys, "ref_ids").orderBy("rank")
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_contained(spans: DataFrame, width: float = 30.0) -> DataFrame:
    """Spans (video_id, modality, span_id, start, end, score) without those inside a better one of their modality.

    Better is a higher score, ties to the smaller id.
    """
    slim = spans.select("video_id", "modality", "span_id", "start", "end", "score")
    pairs = interval_join(slim, slim, ["video_id", "modality"], width, 0.0, "closed")
    better = (F.col("r_score") > F.col("l_score")) | ((F.col("r_score") == F.col("l_score")) & (F.col("r_span_id") < F.col("l_span_id")))
    inside = (F.col("r_start") <= F.col("l_start")) & (F.col("l_end") <= F.col("r_end"))
    gone = pairs.where(better & inside).select(F.col("l_span_id").alias("span_id")).distinct()
    return spans.join(gone, "span_id", "left_anti")


def anchors_first(spans: DataFrame, most: int) -> DataFrame:
    """``most`` spans of each recording: the best of each modality first, then by score."""
    m = Window.partitionBy("video_id", "modality").orderBy(F.desc("score"), "span_id")
    v = Window.partitionBy("video_id").orderBy(F.col("_m") > 1, F.desc("score"), "span_id")
    return spans.withColumn("_m", F.row_number().over(m)).withColumn("rank", F.row_number().over(v)).where(F.col("rank") <= most).drop("_m")


def seconds_budget(spans: DataFrame, seconds: float) -> DataFrame:
    """Spans in rank order that fit the seconds: one that overflows is skipped, later ones may fit, the first stays.

    What is skipped depends on what was kept, so it is a fold over a recording's (bounded) ranked spans.
    """
    rows = spans.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("rank", (F.col("end") - F.col("start")).alias("len"), "span_id"))).alias("s"))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<string>").alias("kept"))
    fits = lambda acc, x: (F.size(acc["kept"]) == 0) | (acc["used"] + x["len"] <= seconds)
    fold = F.aggregate("s", start, lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["len"]).alias("used"), F.array_append(acc["kept"], x["span_id"]).alias("kept"))).otherwise(acc))
    kept = rows.select(F.explode(fold["kept"]).alias("span_id"))
    return spans.join(kept.withColumn("kept", F.lit(True)), "span_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def spaced(points: DataFrame, gap: float, keys: list[str]) -> DataFrame:
    """Points (keys, ts, score) in descending score, each kept when at least ``gap`` seconds from all kept ones.

    A fold over each group's points in score order; groups are a recording's candidate frames.
    """
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ts"))).alias("p"))
    near = lambda kept, x: F.exists(kept, lambda k: F.abs(k - x["ts"]) < gap)
    fold = F.aggregate("p", F.array().cast("array<double>"), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.array_append(kept, x["ts"])))
    return rows.select(*keys, F.explode(fold).alias("ts"))


def relevant_ranges(spans: DataFrame, durations: DataFrame, radius: float = 5.0) -> DataFrame:
    rows = spans.join(durations, "video_id")
    lo, hi = window_around(F.col("start"), F.col("end"), radius, F.col("duration"))
    # Whole milliseconds of the double's product, as SQL engines round; Spark's round to places rounds the double's decimal digits.
    ms = lambda c: (F.round(F.col(c) * 1000) / 1000).alias(c)
    return merge_windows(rows.select("video_id", lo.alias("start"), hi.alias("end")), ["video_id"]).select("video_id", ms("start"), ms("end"))


def expand(spans: DataFrame, facts: DataFrame, radius: float = 5.0, seen: DataFrame | None = None) -> DataFrame:
    """Facts within ``radius`` seconds of the spans' merged windows that were not seen yet, at score 0.5."""
    windows = merge_windows(spans.select("video_id", (F.col("start") - radius).alias("start"), (F.col("end") + radius).alias("end")), ["video_id"])
    found = interval_join(windows, facts, ["video_id"], 30.0, 0.0, "closed").select(*[F.col("r_" + c).alias(c) for c in facts.columns]).distinct()
    if seen is not None:
        found = found.join(seen.select("fact_id"), "fact_id", "left_anti")
    return found.withColumn("score", F.lit(0.5))


def package_json(spans: DataFrame) -> DataFrame:
    """One JSON package for each recording: its spans in rank order, their token estimate and the schema version."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "start", "end", "modality", "text")))
    rows = spans.groupBy("video_id").agg(ordered.alias("evidence"), F.sum(token_estimate(F.col("text"))).alias("tokens"))
    return rows.select("video_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "video_id", "tokens", "evidence")).alias("package"))


#: The lines of a rendered package.
TEXT_SPAN = "[%d] %s (%s): %s"
TEXT_OMITTED = "[omitted %d spans — see package]"
MARKDOWN_SPAN = "%d. **%s** (%s) — %s"
TEXT_CUT, MARKDOWN_CUT = 200, 300


def _evidence(spans: DataFrame, form: str, cut: int) -> DataFrame:
    """(video_id, lines): each recording's ranked spans as lines of the form."""
    line = F.format_string(form, "rank", format_span(F.col("start"), F.col("end")), "modality", F.substring(F.coalesce("text", F.lit("")), 1, cut))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return spans.groupBy("video_id").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))


def package_text(spans: DataFrame, asked: str, intent: str = "", omitted: DataFrame | None = None) -> DataFrame:
    """(video_id, package): ranked spans as plain lines for small contexts; omitted (video_id, n) closes with a count.

    Spans are those already cut to a budget, so the lines of a recording are bounded. Null texts are empty.
    """
    head = [f"QUERY: {asked}", *([f"INTENT: {intent}"] if intent else [])]
    rows = _evidence(spans, TEXT_SPAN, TEXT_CUT)
    if omitted is None:
        tail = F.array().cast("array<string>")
    else:
        rows = rows.join(omitted.select("video_id", F.col("n").alias("_n")), "video_id", "left")
        tail = F.when(F.col("_n") > 0, F.array(F.format_string(TEXT_OMITTED, "_n"))).otherwise(F.array().cast("array<string>"))
    return rows.select("video_id", F.array_join(F.concat(F.array(*map(F.lit, head)), "lines", tail), "\n").alias("package"))


def package_markdown(spans: DataFrame, asked: str, intent: str = "", ranges: DataFrame | None = None) -> DataFrame:
    """(video_id, package): ranked spans as a numbered markdown list under the question, intent and merged ranges."""
    rows = _evidence(spans, MARKDOWN_SPAN, MARKDOWN_CUT)
    head = [F.lit(f"# Context: {asked}"), F.lit(""), *([F.lit(f"**Intent:** `{intent}`")] if intent else [])]
    if ranges is not None:
        label = F.concat(format_timecode(F.col("start")), F.lit(" → "), format_timecode(F.col("end")))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("start", label.alias("label")))), lambda x: x["label"])
        rows = rows.join(ranges.groupBy("video_id").agg(F.concat(F.lit("**Ranges:** "), F.array_join(listed, ", ")).alias("_ranges")), "video_id", "left")
        head.append(F.col("_ranges"))
    lines = F.concat(F.array(*head, F.lit(""), F.lit("## Evidence")), "lines")
    return rows.select("video_id", F.array_join(lines, "\n").alias("package"))

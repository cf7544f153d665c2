"""Rules that stored facts must keep; each is one DataFrame of findings (video_id, fact_id, rule, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _found(rows: DataFrame, rule: str, severity: str = "error", id_col: str = "fact_id") -> DataFrame:
    return rows.select("video_id", F.col(id_col).cast("string").alias("fact_id"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def row_rules(facts: DataFrame, duration: Column) -> DataFrame:
    """Rules on single rows, in one pass: bounds (half a second of grace), order of ends, range of confidence."""
    broken = F.array(
        F.when((F.col("start") < 0) | (F.col("end") > duration + 0.5), F.lit("bounds")),
        F.when(F.col("end") < F.col("start"), F.lit("ordering")),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence")),
    )
    return facts.select("video_id", "fact_id", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule")).withColumn("severity", F.lit("error"))


def document_rules(documents: DataFrame, stages: DataFrame, segments: DataFrame, texts: DataFrame, most_texts: int = 20) -> DataFrame:
    """Rules on whole documents (video_id, version), of their stages (video_id, name), segments and screen texts (video_id, frame_count).

    A version is there and stages have different names; a warning where there are segments but no stage, or over
    ``most_texts`` screen texts none of which lasts over a frame.
    """
    none = documents.where(F.coalesce(F.trim("version"), F.lit("")) == "").withColumn("fact_id", F.lit(None).cast("string"))
    twice = stages.groupBy("video_id", "name").count().where("count > 1")
    bare = segments.select("video_id").distinct().join(stages.select("video_id").distinct(), "video_id", "left_anti").withColumn("fact_id", F.lit(None).cast("string"))
    short = texts.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.max("frame_count").alias("most")).where((F.col("n") > most_texts) & (F.coalesce("most", F.lit(0)) <= 1))
    short = short.withColumn("fact_id", F.lit(None).cast("string"))
    found = [_found(none, "version"), _found(twice, "stages", id_col="name"), _found(bare, "provenance", "warning"), _found(short, "ocr_dedup", "warning")]
    return reduce(lambda a, b: a.unionByName(b), found)


def strict(findings: DataFrame) -> DataFrame:
    """The findings with warnings counted as errors."""
    return findings.withColumn("severity", F.lit("error"))


def valid_recordings(recordings: DataFrame, findings: DataFrame) -> DataFrame:
    """The recordings (video_id) without an error."""
    return recordings.select("video_id").distinct().join(findings.where("severity = 'error'").select("video_id").distinct(), "video_id", "left_anti")


def validate(facts: DataFrame, durations: DataFrame, refs: DataFrame | None = None, exclusive: DataFrame | None = None) -> DataFrame:
    """All findings: row rules, repeated ids, references to facts that do not exist, overlaps of exclusive rows (of equal intervals the first id stands)."""
    found = [row_rules(facts.join(durations, "video_id"), F.col("duration"))]
    found.append(_found(facts.groupBy("video_id", "fact_id").count().where("count > 1"), "unique_id"))
    if refs is not None:
        known = facts.select("video_id", F.col("fact_id").alias("ref"))
        found.append(_found(refs.join(known, ["video_id", "ref"], "left_anti"), "dangling_ref", id_col="ref"))
    if exclusive is not None:
        w = Window.partitionBy("video_id").orderBy("start", "end", "fact_id")
        over = exclusive.withColumn("_before", F.lag("end").over(w)).where(F.col("start") < F.col("_before") - 1e-6)
        found.append(_found(over, "overlap"))
    return reduce(lambda a, b: a.unionByName(b), found)

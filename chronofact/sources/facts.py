"""Interval-stamped facts: the engine's central table, and its projection from the driver's tables.

A recording is a block of neighbouring ids, so the number of recordings grows with the input and each stays small.
Every projection is a function of its own row: no shuffle, and filters on video_id, modality and time reach the scan's
rows. Half-open intervals [start, end) in seconds; an instant has end = start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.session import table

MODALITIES = ("transcript", "ocr", "vision", "events")
COLUMNS = ("video_id", "modality", "fact_id", "start", "end", "text", "kind", "language", "confidence")


def transcript(conversations: DataFrame) -> DataFrame:
    begin = (F.col("conv_id") % 20) * 30.0 + F.col("turn") * 5.0
    return conversations.where(F.trim("text") != "").select(
        F.concat(F.lit("v"), F.floor(F.col("conv_id") / 20)).alias("video_id"),
        F.lit("transcript").alias("modality"),
        F.concat(F.lit("utt_"), "conv_id", F.lit("_"), "turn").alias("fact_id"),
        begin.alias("start"),
        (begin + F.least(F.lit(5.0), F.length("text") / 20.0)).alias("end"),
        "text",
        F.col("role").alias("kind"),
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("double").alias("confidence"),
    )


def screen_text(documents: DataFrame) -> DataFrame:
    begin = (F.col("doc_id") % 20) * 30.0
    return documents.where(F.trim("text") != "").select(
        F.concat(F.lit("v"), F.floor(F.col("doc_id") / 20)).alias("video_id"),
        F.lit("ocr").alias("modality"),
        F.concat(F.lit("ocr_"), "doc_id").alias("fact_id"),
        begin.alias("start"),
        (begin + F.least(F.lit(25.0), F.col("n_chars") / 100.0)).alias("end"),
        "text",
        F.col("source").alias("kind"),
        F.col("lang").alias("language"),
        (F.col("doc_id") % 10 / 10.0).alias("confidence"),
    )


def typed_events(events: DataFrame) -> DataFrame:
    """Instants; the shown text is the type with blanks for underscores."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) % 600000000) / 1000000.0
    return events.select(
        F.concat(F.lit("v"), F.floor(F.col("event_id") / 100)).alias("video_id"),
        F.lit("events").alias("modality"),
        F.concat(F.lit("evt_"), "event_id").alias("fact_id"),
        at.alias("start"),
        at.alias("end"),
        F.replace("event_type", F.lit("_"), F.lit(" ")).alias("text"),
        F.col("event_type").alias("kind"),
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("double").alias("confidence"),
    )


def descriptions(pages: DataFrame) -> DataFrame:
    """Vision facts: what a page shows, by its title or else its address, of a set of five frames (frame_ids, ids of events)."""
    title = F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>([^<]*)</title", 1))
    video, place = F.floor(F.col("page_id") / 20), F.col("page_id") % 20
    begin = place * 30.0
    return pages.select(
        F.concat(F.lit("v"), video).alias("video_id"), F.lit("vision").alias("modality"), F.concat(F.lit("vis_"), "page_id").alias("fact_id"), begin.alias("start"), (begin + 20.0).alias("end"),
        F.when(title != "", title).otherwise(F.coalesce("url", F.lit(""))).alias("text"), F.lit("page").alias("kind"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("evt_"), (video * 100 + place * 5 + i).cast("string"))).alias("frame_ids"),
    )


def facts(spark: SparkSession, sf_dir: str, *modalities: str) -> DataFrame:
    """All facts of the named modalities (all by default); unknown names are ignored."""
    made = {
        "transcript": lambda: transcript(table(spark, sf_dir, "conversations")),
        "ocr": lambda: screen_text(table(spark, sf_dir, "documents")),
        "events": lambda: typed_events(table(spark, sf_dir, "events")),
    }
    parts = [make() for name, make in made.items() if not modalities or name in modalities]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same projection for the SQL counterparts, as a common table expression named facts.
FACTS_SQL = """facts AS (
  SELECT 'v' || (conv_id // 20) AS video_id, 'transcript' AS modality, 'utt_' || conv_id || '_' || turn AS fact_id,
    CAST((conv_id % 20) * 30 + turn * 5 AS DOUBLE) AS "start",
    CAST((conv_id % 20) * 30 + turn * 5 AS DOUBLE) + least(CAST(5 AS DOUBLE), CAST(length(text) AS DOUBLE) / CAST(20 AS DOUBLE)) AS "end",
    text, role AS kind, CAST(NULL AS VARCHAR) AS language, CAST(NULL AS DOUBLE) AS confidence
  FROM conversations WHERE trim(text) <> ''
  UNION ALL
  SELECT 'v' || (doc_id // 20), 'ocr', 'ocr_' || doc_id, CAST((doc_id % 20) * 30 AS DOUBLE),
    CAST((doc_id % 20) * 30 AS DOUBLE) + least(CAST(25 AS DOUBLE), CAST(n_chars AS DOUBLE) / CAST(100 AS DOUBLE)),
    text, source, lang, CAST(doc_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE)
  FROM documents WHERE trim(text) <> ''
  UNION ALL
  SELECT 'v' || (event_id // 100), 'events', 'evt_' || event_id, CAST(epoch_us(ts) % 600000000 AS DOUBLE) / CAST(1000000 AS DOUBLE),
    CAST(epoch_us(ts) % 600000000 AS DOUBLE) / CAST(1000000 AS DOUBLE), replace(event_type, '_', ' '), event_type, NULL, NULL
  FROM events
)"""

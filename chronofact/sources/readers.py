"""Readers and writers of the formats that facts come in and go out by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The newest document version that is read.
VERSION = (1, 1)
_FACT = "id STRING, start DOUBLE, `end` DOUBLE, text STRING, type STRING, description STRING, language STRING, confidence DOUBLE, stable BOOLEAN, frame_count INT, first_frame_ts DOUBLE, last_frame_ts DOUBLE"
#: The document's schema: read as declared, never inferred.
DOCUMENT = (
    "vctx_version STRING, video STRUCT<id: STRING, filename: STRING, duration: DOUBLE, has_audio: BOOLEAN>, "
    + ", ".join(f"{k} ARRAY<STRUCT<{', '.join(c.strip().replace(' ', ': ', 1) for c in _FACT.split(','))}>>" for k in ("scenes", "transcript", "ocr", "events", "segments"))
    + ", stages ARRAY<STRUCT<name: STRING, status: STRING, error: STRING>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a path (JSON, gzip by suffix), one row each; an error for a missing or newer major version."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    major = F.split_part("vctx_version", F.lit("."), F.lit(1)).try_cast("int")
    bad = major.isNull() | (major > VERSION[0])
    return docs.withColumn("vctx_version", F.when(bad, F.raise_error(F.concat(F.lit("unreadable document version "), F.coalesce("vctx_version", F.lit("none"))))).otherwise(F.col("vctx_version")))


def migrate(docs: DataFrame) -> DataFrame:
    """Documents at the present version: absent arrays become empty ones."""
    filled = {k: F.coalesce(F.col(k), F.array().cast(docs.schema[k].dataType)) for k in ("scenes", "transcript", "ocr", "events", "segments", "stages")}
    return docs.withColumns(filled).withColumn("vctx_version", F.lit("%d.%d" % VERSION))


def fact_table(docs: DataFrame, kind: str) -> DataFrame:
    return docs.select(F.col("video.id").alias("video_id"), F.explode(kind).alias("f")).select("video_id", "f.*")


def write_documents(docs: DataFrame, path: str, compress: bool = True) -> None:
    """Write documents as JSON lines; Spark's commit makes the write atomic."""
    docs.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def json_schema(spark: SparkSession) -> str:
    return spark.createDataFrame([], DOCUMENT).schema.json()


#: The timing line of a subtitle cue, and what is stripped from its text.
TIMING = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
VOICE = r"<v(?:\.[^ >]*)?\s+([^>]+)>"


def _seconds(line: Column, first: int) -> Column:
    part = lambda i: F.coalesce(F.regexp_extract(line, TIMING, first + i).try_cast("double"), F.lit(0.0))
    return part(0) * 3600 + part(1) * 60 + part(2) + F.rpad(F.regexp_extract(line, TIMING, first + 3), 3, "0").try_cast("double") / 1000


def parse_cues(files: DataFrame) -> DataFrame:
    """(path, cue, start, end, speaker, text) of (path, payload) rows of SRT or WebVTT text.

    A timing line begins a cue, its lines follow up to the next one; counters on a line of their own before a timing
    line, tags and style overrides go; a voice tag names the speaker. Cues without text are dropped.
    """
    clean = F.regexp_replace(F.regexp_replace("payload", "^﻿", ""), r"\r\n?", "\n")
    lines = files.select("path", F.posexplode(F.split(clean, "\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n")
    timed = lines.withColumn("_t", F.col("line").rlike(TIMING)).withColumn("cue", F.sum(F.col("_t").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A bare counter directly before a timing line belongs to the next cue.
    timed = timed.withColumn("_next", F.lead("_t").over(w)).where("cue > 0").where(~(F.coalesce("_next", F.lit(False)) & F.col("line").rlike(r"^\s*\d+\s*$")))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", r"<[^>]*>", ""), r"\{\\[^}]*\}", ""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_t") & (bare != ""), F.struct("n", bare.alias("t"))))), lambda x: x["t"]), " ")
    cues = timed.groupBy("path", "cue").agg(
        F.max(F.when(F.col("_t"), _seconds(F.col("line"), 1))).alias("start"),
        F.max(F.when(F.col("_t"), _seconds(F.col("line"), 5))).alias("end"),
        F.min(F.when(~F.col("_t") & F.col("line").rlike(VOICE), F.regexp_extract("line", VOICE, 1))).alias("speaker"),
        body.alias("text"),
    )
    return cues.where("text <> ''")


def parse_recognition(tsv: DataFrame, least: float = 20.0) -> DataFrame:
    """Text lines of recogniser words (page, block, par, line, word, left, top, width, height, conf, text): joined words,
    mean confidence and hull of the boxes; words under ``least`` confidence, lines without letter or digit are dropped."""
    words = tsv.where((F.col("conf") >= least) & (F.trim("text") != ""))
    grouped = words.groupBy("page", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.round(F.avg("conf") / 100, 4).alias("confidence"),
        F.min("left").alias("x1"), F.min("top").alias("y1"), F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height")).alias("y2"),
    )
    return grouped.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def parse_scene_scores(log: DataFrame) -> DataFrame:
    """(path, pts, score) of (path, n, line) rows of an analysis log: each score belongs to the last time line before it."""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    pts = F.nullif(F.regexp_extract("line", r"pts_time:\s*([0-9.]+)", 1), F.lit("")).try_cast("double")
    score = F.nullif(F.regexp_extract("line", r"scene_score=([0-9.]+)", 1), F.lit("")).try_cast("double")
    return log.withColumn("pts", F.last(pts, ignorenulls=True).over(w)).withColumn("score", score).where("score IS NOT NULL AND pts IS NOT NULL").select("path", "pts", "score")


def parse_silences(log: DataFrame) -> DataFrame:
    """(path, start, end) of silence_start and silence_end lines; an open last silence has a null end."""
    w = Window.partitionBy("path").orderBy("n")
    at = lambda what: F.nullif(F.regexp_extract("line", rf"silence_{what}:\s*([0-9.]+)", 1), F.lit("")).try_cast("double")
    marks = log.withColumns({"s": at("start"), "e": at("end")}).where("s IS NOT NULL OR e IS NOT NULL")
    return marks.withColumn("end", F.lead("e").over(w)).where("s IS NOT NULL").select("path", F.col("s").alias("start"), "end")


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, n, text): the text lines of raw pages, tags, scripts and styles removed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", "\n")
    return pages.select("page_id", F.posexplode(F.split(bare, r"\s*\n\s*")).alias("n", "text")).where(F.trim("text") != "")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload) of text files, one row each, a task reading its files from whatever store Spark knows."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues (``parse_cues``) of the SRT and WebVTT files of a path."""
    return parse_cues(_whole(spark, path))


#: Columns of a recogniser's word table.
WORDS = "level INT, page INT, block INT, par INT, line INT, word INT, left INT, top INT, width INT, height INT, conf DOUBLE, text STRING"


def read_recognition(spark: SparkSession, path: str, least: float = 20.0) -> DataFrame:
    """(path, and lines as ``parse_recognition`` makes them) of recogniser word tables; quotes in them are text like any other."""
    words = spark.read.schema(WORDS).option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    words = words.select("*", F.col("_metadata.file_path").alias("path")).where("level = 5")
    by = words.withColumn("page", F.struct("path", "page"))
    return parse_recognition(by, least).select("page.path", "page.page", "block", "par", "line", "text", "confidence", "x1", "y1", "x2", "y2")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of analysis logs, for ``parse_scene_scores`` and ``parse_silences``."""
    return _whole(spark, path).select("path", F.posexplode(F.split("payload", r"\r?\n")).alias("n", "line"))

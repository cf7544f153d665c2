"""Line deduplication by content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.session import materialize


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column whose value is not moved into what uses it, where a lambda would evaluate it for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def chunked(docs: DataFrame, divisor: int, min_lines: int = 2) -> DataFrame:
    """Add ``chunks``, an array of (n, body): the text cut after each line where the rolling hash says so.

    The rolling hash at a line is its own hash plus 31 times that of the line before; a line is marked where it divides
    by ``divisor``. A cut falls after a marked line when none of the ``min_lines - 1`` lines before it is marked and
    ``min_lines`` lines or more are on either side, so no chunk of a longer text is shorter. Cuts depend on the hashes of
    ``min_lines + 1`` lines only, but at a text's end, so an insertion moves no later cut.
    """
    with_lines = _once(docs, "lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    hashed = _once(with_lines, "hashes", F.transform("lines", _line_hash))
    at = lambda i: F.element_at("hashes", i)
    last = F.size("lines")
    mark = lambda i: (i > 1) & ((at(i) + 31 * at(F.greatest(i - 1, F.lit(1)))) % divisor == 0)
    marked = _once(hashed, "marks", F.transform(F.sequence(F.lit(1), last), mark))

    def cut(i: Column) -> Column:
        alone = (i >= min_lines) & (i <= last - min_lines) & F.element_at("marks", i)
        for k in range(1, min_lines):
            alone = alone & ~F.element_at("marks", F.greatest(i - k, F.lit(1)))
        return (i == last) | alone

    ended = _once(marked, "ends", F.filter(F.sequence(F.lit(1), last), cut))
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest(k, F.lit(1))))
    body = lambda e, k: F.struct((e - start(k)).alias("n"), F.array_join(F.slice("lines", start(k) + 1, e - start(k)), "\n").alias("body"))
    return _once(ended, "chunks", F.transform("ends", body))


def line_dedup(
    docs: DataFrame,
    divisor: int = 3,
    min_lines: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs' columns with the text deduplicated, and n_lines, n_chunks, removed_chunks, removed_lines.

    Chunks of ``min_lines`` lines or more that occur again anywhere are removed but for their first occurrence (by id,
    then place). Chunks are grouped by hash and bytes together, so no collision removes anything; copies are summed
    before the shuffle, so a passage that many documents share leaves each map task once. The places to remove, slim
    rows, are joined back to the documents, whose remaining chunks are put together again; a document that loses
    nothing keeps its exact text. Every text of ``min_lines`` lines or more consists of chunks that are compared, so an
    exact copy of one loses all its lines.

    Lines end at a line feed. A null text counts as one empty line, and stays null. Rows equal in id and text are one
    document here: none is the other's repeat. Null ids come first. A text that loses all its chunks is empty. Columns
    of other names are kept; an empty table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns}
    made = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    if clash := taken & set(made):
        docs = docs.drop(*clash)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = chunked(slim.withColumn("sha", F.sha1(F.coalesce("text", F.lit("")))), divisor, min_lines).select("id", "sha", F.posexplode("chunks").alias("no", "chunk"))
    long = rows.where(F.col("chunk.n") >= min_lines).select("id", "sha", "no", F.col("chunk.body").alias("body"), F.md5("chunk.body").alias("fp"))
    place = F.struct("id", "sha", "no")
    repeated = (
        long.groupBy("fp", "body")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("NOT (first <=> last)")
        .select("fp", F.sha2("body", 256).alias("fp2"), "first")
    )
    later = long.select("id", "sha", "no", "fp", F.sha2("body", 256).alias("fp2")).join(repeated, ["fp", "fp2"]).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("id").alias("gid"), F.col("sha").alias("gsha")).agg(F.collect_set("no").alias("gone"))

    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = kept.withColumn("sha", F.sha1(F.coalesce("text", F.lit(""))))
    joined = kept.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("sha") == F.col("gsha")), "left").drop("gid", "gsha", "sha")
    cut = chunked(joined, divisor, min_lines)
    stay = _once(cut, "stay", F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), F.coalesce("gone", F.array().cast("array<int>"))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.element_at("chunks", i + 1)["body"]), "\n"))
    lost = F.size("lines") - F.aggregate("stay", F.lit(0), lambda s, i: s + F.element_at("chunks", i + 1)["n"])
    out = stay.withColumn("_text", text)
    return out.select(
        *[F.col("_text").alias(c) if c == text_col else F.col(n).alias(c) for c, n in names.items()],
        F.size("lines").cast("long").alias("n_lines"),
        F.size("chunks").cast("long").alias("n_chunks"),
        (F.size("chunks") - F.size("stay")).cast("long").alias("removed_chunks"),
        lost.cast("long").alias("removed_lines"),
    )


def run_dedup(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns with the text deduplicated, and n_lines, removed_lines.

    A line goes when it lies in a run of ``min_lines`` lines that occurs earlier (by id, then place) in any document. Runs
    start at every line, so no chunk edge keeps a repeated line: what ``line_dedup`` removes goes, and with it the ends of
    passages that it leaves. Each line that goes has an equal one at an earlier place, so
    one of each stays. Runs are compared by SHA-256, copies summed before the shuffle; the hashes are written, so that the
    join can split a run that many documents share.

    Left are repeated lines between two lines that are not repeated, and documents of fewer than ``min_lines`` lines.
    Lines, null texts, null ids and rows equal in id and text are taken as in ``line_dedup``.
    """
    taken = {c.lower() for c in docs.columns}
    if clash := taken & {"n_lines", "removed_lines"}:
        docs = docs.drop(*clash)
    whole = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("sha", F.sha1(whole))
    lined = _once(slim, "lines", F.split(whole, "\n")).where(F.size("lines") >= min_lines)
    run = lambda i: F.unhex(F.sha2(F.array_join(F.slice("lines", i, min_lines), "\n"), 256))
    starts = F.sequence(F.lit(1), F.size("lines") - min_lines + 1)
    rows = materialize(lined.select("id", "sha", F.posexplode(F.transform(starts, run)).alias("no", "fp")), "runs")
    place = F.struct("id", "sha", "no")
    repeated = rows.groupBy("fp").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("NOT (first <=> last)").select("fp", "first")
    later = rows.join(materialize(repeated, "repeated"), "fp").where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("id").alias("gid"), F.col("sha").alias("gsha")).agg(F.collect_set("no").alias("gone"))

    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("sha", F.sha1(whole))
    joined = kept.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("sha") == F.col("gsha")), "left").drop("gid", "gsha", "sha")
    cut = _once(joined, "lines", F.split(whole, "\n"))
    lost = F.flatten(F.transform("gone", lambda i: F.sequence(i + 1, i + min_lines)))
    stay = _once(cut, "stay", F.array_except(F.sequence(F.lit(1), F.size("lines")), F.coalesce(lost, F.array().cast("array<int>"))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.element_at("lines", i)), "\n"))
    return stay.withColumn("_text", text).select(
        *[F.col("_text").alias(c) if c == text_col else F.col(n).alias(c) for c, n in names.items()],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("removed_lines"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2("text", 256).alias("kept_sha256")
    )


SQL = {
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT *, list_transform(lines, lambda l: CAST('0x' || substr(md5(l), 1, 7) AS BIGINT)) AS hs FROM d),
m AS (SELECT *, list_transform(range(1, len(lines) + 1), lambda i: i > 1 AND (hs[i] + 31 * hs[i - 1]) % 3 = 0) AS marks FROM h),
e AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR (i BETWEEN 2 AND len(lines) - 2 AND marks[i] AND NOT marks[i - 1])) AS ends FROM m),
c AS (SELECT doc_id, no, CAST(ends[no] - s AS BIGINT) AS n, array_to_string(lines[s + 1:ends[no]], chr(10)) AS body
      FROM (SELECT doc_id, lines, ends, no, CASE WHEN no = 1 THEN 0 ELSE ends[no - 1] END AS s FROM e, unnest(range(1, len(ends) + 1)) AS u(no))),
k AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY n >= 2, body ORDER BY doc_id, no) > 1 AS gone FROM c),
t AS (SELECT doc_id, sum(n) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS removed_chunks,
        coalesce(sum(n) FILTER (gone), 0) AS removed_lines, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') AS body
      FROM k GROUP BY doc_id)
SELECT t.doc_id, CAST(n_lines AS BIGINT) AS n_lines, n_chunks, removed_chunks, CAST(removed_lines AS BIGINT) AS removed_lines,
  CASE WHEN d.text IS NOT NULL OR removed_chunks > 0 THEN sha256(t.body) END AS kept_sha256
FROM t JOIN d ON d.doc_id = t.doc_id
""",
}
QUERIES = {"op10_line_dedup": op10_line_dedup}

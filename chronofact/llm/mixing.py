"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.columns import aside
from chronofact.session import ROW, global_rank, keyed, materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets of (source, source_size): weights repeat over the sources by code point, null last.

    The targets share the total by weight, none above ``most`` times its source's size; the excess is shared again.
    That is a water level: target = least(most * size, weight * level), where the targets sum to the total. With the
    sources ordered by most * size / weight, capping the first k gives a level for the rest; it rises while the next
    source is too small for it and falls after that, so the level is the greatest of these.
    One row per source, so the windows here are over metadata.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = (most * F.col("source_size") / F.col("_w")).alias("ratio")
    ranked = sizes.withColumn("_i", (F.row_number().over(by_name) - 1) % len(weights)).withColumn(
        "_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_i") + 1)
    )
    up = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = (
        ranked.withColumn("_left", F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_wleft", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left").cast("double") / F.col("_wleft").cast("double"))
    )
    level = F.max("_level").over(every)
    return levels.select("source", "source_size", F.least(most * F.col("source_size"), F.col("_w") * level).alias("target"))


def whole_copies(sizes: Column, rate: Column, most: float) -> Column:
    """How often each of ``sizes``, long documents in descending order, is taken: the floor or the ceiling of rate.

    Whichever keeps the words taken so far closest to rate times the words so far, so that the misses of long documents
    do not add up. sizes has a bounded length.
    """
    least, cap = F.floor(rate), F.least(F.ceil(rate), F.lit(int(most)))
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("copies"))

    def step(s: Column, x: Column) -> Column:
        size = s["size"] + x
        fair = F.floor((rate * size - s["taken"]) / x + 0.5)
        n = F.greatest(least, F.least(cap, fair)).cast("long")
        return F.struct(size.alias("size"), (s["taken"] + n * x).alias("taken"), F.concat(s["copies"], F.array(n)).alias("copies"))

    return F.aggregate(sizes, start, step)


def systematic_sample(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: str = "mix",
    long_share: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key_col: str | None = None,
) -> DataFrame:
    """Copies of each document in the mix: id_col, source, size, source_size, target, rate, copies, taken.

    Inside its source, each document expects some copies: they are summed along the documents' order of size, one
    offset drawn from the seed and the source is added, and a document is emitted once for each integer its stretch
    crosses. Documents expect target / source_size copies, but for the long ones, of over 1 / ``long_share`` of their
    source's words and so fewer than ``long_share``: chance would let each of these miss by its whole length, so each
    expects a whole number, next below or above (``whole_copies``), and the others, whose rate makes up for the
    difference, share one rate. Taken words then miss the target by under 1 / ``long_share`` of the source's words,
    wherever the other documents can make up for the long ones within 0 to ``most`` copies. The order is (size, id), so
    reruns agree; rows equal in both are interchangeable. A column ``key_col``, where given, is carried along. The
    prefix sum is rate * rank, with ranks from a range partitioning, so a source with a third of all rows is cut over
    many tasks.

    Null and empty texts have size 0 and take no words; null ids and repeated rows are rows like others; null sources
    are one source, the last. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.col(key_col)] if key_col else []))
    slim = materialize(slim, "sizes")
    ranked = global_rank(slim, ["source"], ["size", "doc_id", *([key_col] if key_col else [])])
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "_source")
    targets = targets.join(sizes.select(F.col("source").alias("_own"), "rows"), F.col("_source").eqNullSafe(F.col("_own"))).drop("_own")
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    long = slim.join(targets.select("_source", "source_size"), F.col("source").eqNullSafe(F.col("_source"))).where(F.col("size") * long_share > F.col("source_size"))
    long = long.groupBy(F.col("source").alias("_long")).agg(F.sort_array(F.collect_list("size"), asc=False).alias("sizes"))
    name = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    none = F.array().cast("array<long>")
    t = targets.join(long, F.col("_source").eqNullSafe(F.col("_long")), "left").withColumn("w", whole_copies(F.coalesce("sizes", none), F.col("rate"), most))
    rest = F.greatest(F.lit(0.0), F.least(F.lit(most), (F.col("target") - F.col("w.taken")) / (F.col("source_size") - F.col("w.size"))))
    t = materialize(
        t.select(
            "_source", "source_size", "target", "rate", offset.alias("offset"), F.col("w.copies").alias("whole"), (F.col("rows") - F.size("w.copies")).alias("short"),
            F.when(F.col("source_size") > F.col("w.size"), rest).otherwise(0.0).alias("rest"),
        ),
        "targets",
    )
    crossed = F.floor((F.col("rank") + 1) * F.col("rest") + F.col("offset")) - F.floor(F.col("rank") * F.col("rest") + F.col("offset"))
    whole = F.element_at("whole", (F.col("short") + F.size("whole") - F.col("rank")).cast("int"))
    return (
        ranked.join(t, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", F.when(F.col("rank") < F.col("short"), crossed).otherwise(whole).cast("long"))
        .select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([key_col] if key_col else []))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows themselves, with docs' columns, of whatever names: each row as often as the sample takes it.

    Rows get keys of their own, written before use, so null and repeated ids are rows like others. An empty table gives
    an empty result.
    """
    held, back = aside(docs, id_col, text_col, source_col)
    rows = keyed(held)
    taken = systematic_sample(rows, id_col=id_col, text_col=text_col, source_col=source_col, key_col=ROW, **options).where("copies > 0")
    taken = taken.select(F.col(ROW).alias("_row"), F.col("copies").cast("int").alias("_copies"))
    return back(rows.join(taken, F.col(ROW) == F.col("_row")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return systematic_sample(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op4_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
l AS (
  SELECT *,
    CAST(sum(source_size) OVER () - 3.0 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE)
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY CAST(3.0 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(3.0 * source_size AS DOUBLE), w * max(level) OVER ()) AS target,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce('=' || source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, d.size * 100 > t.source_size AS long,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS up, row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id DESC) AS down
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT source, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS n FROM t
  UNION ALL
  SELECT source, i, size, taken + n * x, n FROM (
    SELECT f.source, f.i + 1 AS i, f.size + r.size AS size, f.taken, r.size AS x,
      CAST(greatest(floor(r.rate), least(least(ceil(r.rate), 3), floor((r.rate * (f.size + r.size) - f.taken) / r.size + 0.5))) AS BIGINT) AS n
    FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source AND r.long AND r.down = f.i + 1)
), e AS (
  SELECT t.source, CASE WHEN t.source_size > w.size THEN greatest(0.0, least(3.0, (t.target - w.taken) / (t.source_size - w.size))) ELSE 0.0 END AS rest
  FROM t JOIN (SELECT source, max(size) AS size, max(taken) AS taken FROM f GROUP BY source) w ON w.source IS NOT DISTINCT FROM t.source
)
SELECT r.doc_id, r.size, r.source_size, r.target,
  CASE WHEN r.long THEN f.n ELSE CAST(floor(r.up * e.rest + r.u) - floor((r.up - 1) * e.rest + r.u) AS BIGINT) END * r.size AS taken
FROM r JOIN e ON e.source IS NOT DISTINCT FROM r.source LEFT JOIN f ON r.long AND f.source IS NOT DISTINCT FROM r.source AND f.i = r.down
""",
}
QUERIES = {"op4_mixing": op4_mixing}

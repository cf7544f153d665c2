"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.session import materialize

#: Fixed value: the white space that separates words in every text contract of this package.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fingerprint: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of white space has become one space. The group key is the
    fingerprint *and* the bytes, so two texts that collide in the fingerprint stay apart; the aggregation is partial
    before its shuffle, so a group that holds a third of all rows leaves each map task as one row. Members then find
    their group by fingerprint and SHA-256, in a join of slim rows without texts. Normalised texts and hashes are
    written once, so that neither is computed again for the members.

    Null texts count as empty; empty texts form a group like any other. Of rows with equal ids and texts each is
    returned, all as kept where the id is the group's smallest (a null id is smallest of all only in a group of
    null ids). Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    hashed = materialize(slim.withColumns({"_fp": fingerprint(F.col("_norm")), "text_sha256": F.sha2("_norm", 256)}), "hashed")
    groups = (
        hashed.groupBy("_fp", "text_sha256", "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_fp", "text_sha256", "keep_id", "group_size")
    )
    members = hashed.select("_id", "_fp", "text_sha256")
    return members.join(groups, ["_fp", "text_sha256"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
""",
}
QUERIES = {"op5_exact_dedup": op5_exact_dedup}

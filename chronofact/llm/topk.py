"""Exact top-k inner products with MaxScore pruning, in blocks of queries and shards of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.session import materialize, partitions

HITS = "query_id long, vec_id long, score long"


def max_score(queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best candidates of each query, ties to smaller ids, own[q] left out.

    A term is a dimension; its postings are its row of ``columns``, those with a sign that helps the query. Its bound
    is the most any candidate of the shard can gain from it. Terms stand in descending order of bound. Those at the
    end whose bounds sum to less than the k-th best score so far are non-essential: a candidate that no essential term
    helps cannot enter, as what it gains is at most that sum. The candidates that essential terms help are scored over
    the essential terms, then the other terms are probed, in blocks, for those whose score plus the bounds left can
    still reach the k-th.
    """
    top, low = columns.max(axis=1), columns.min(axis=1)
    weights = queries.astype(np.int64)
    gains = np.maximum(weights * top, weights * low)
    order = np.argsort(-gains, axis=1, kind="stable")
    for q in range(len(queries)):
        w, terms = weights[q], order[q]
        bound = np.maximum(gains[q][terms], 0)
        left = np.append(bound[::-1].cumsum()[::-1], 0)
        # A first threshold: exact scores of the candidates that the strongest term helps most.
        reach = min(len(ids), 4 * k)
        lead = columns[terms[0]] * w[terms[0]]
        seed = np.argpartition(-lead, reach - 1)[:reach]
        seed = seed[ids[seed] != own[q]]
        floor = -np.inf
        if len(seed) >= k:
            floor = np.partition(w @ columns[:, seed], len(seed) - k)[len(seed) - k]
        essential = max(1, int(np.searchsorted(-left, -floor, side="right"))) if floor > 0 else len(terms)
        main = terms[:essential]
        part = w[main] @ columns[main]
        if essential < len(terms):
            helped = np.zeros(len(ids), dtype=bool)
            for t in main:
                helped |= (columns[t] * w[t]) > 0
                if helped.all():
                    break
            alive = np.flatnonzero(helped & (part + left[essential] >= floor))
        else:
            alive = np.arange(len(ids))
        score = part[alive]
        for at in range(essential, len(terms), 16):
            probe = terms[at : at + 16]
            score = score + w[probe] @ columns[np.ix_(probe, alive)]
            stays = score + left[min(at + 16, len(terms))] >= floor
            alive, score = alive[stays], score[stays]
        other = ids[alive] != own[q]
        alive, score = alive[other], score[other]
        if len(alive) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            near = score >= edge
            alive, score = alive[near], score[near]
        best = np.lexsort((ids[alive], -score))[:k]
        yield q, ids[alive][best], score[best]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    most_rows: int = 65536,
    least_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row, every row but its own being one.

    Components become floor(scale * x); the score is the integer inner product; ties go to smaller ids. Rows are cut
    by hash into shards of candidates and blocks of queries, of at most about ``most_rows`` each; each (block, shard) is
    one group of bounded size, searched by ``max_score`` (64-bit integers, so scores are exact). Each shard returns at
    most k hits a query, and these are merged. Each pair of rows that meet is work; what is moved for it is one vector of
    each side for ``most_rows`` pairs: candidates once a block, queries once a shard, as they come (floats stay
    floats). While tasks would idle, shards are cut down to ``least_rows``.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with null ids. A query
    meets the candidates with as many components as it has; each length is cut into blocks and shards by its own rows. With fewer than k
    candidates all are returned. Repeated rows are candidates each; a query leaves out all rows of its own id, and
    of query rows with one id the smallest vector asks. Other columns are ignored.
    """
    spark = vectors.sparkSession
    good = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
        .where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
        .withColumn("dim", F.size("v"))
    )
    up = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    cuts = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("nq")).withColumn("blocks", up(F.col("nq"), most_rows))
    idle = F.least(F.floor(partitions(spark) / F.col("blocks")), F.ceil(F.col("n") / least_rows)).cast("int")
    cuts = materialize(cuts.select("dim", "blocks", F.greatest(up(F.col("n"), most_rows), idle).alias("shards")), "cuts")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    place = lambda m, *of: F.pmod(F.xxhash64(*of), F.col(m)).cast("int")
    candidates = good.select("id", "v", "dim").join(cuts, "dim").withColumn("shard", place("shards", "id", "v")).withColumn("block", every("blocks")).select("dim", "shard", "block", "id", "v")
    asks = good.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = asks.join(cuts, "dim").withColumn("block", place("blocks", "id")).withColumn("shard", every("shards"))
    asked = asked.select(*[F.col(c).alias(c) for c in ("dim", "shard", "block", "id", "v")])  # new columns, as both sides come from one table

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = right["id"].to_numpy(), left["id"].to_numpy()
        out = [(own[:0], own[:0], own[:0])]
        if len(ids) and len(own):
            dim = left["dim"][0].as_py()
            whole = lambda t: np.floor(scale * t["v"].combine_chunks().flatten().to_numpy().astype(np.float64)).astype(np.int64).reshape(-1, dim)
            columns = np.ascontiguousarray(whole(right).T)
            for q, found, score in max_score(whole(left), ids, columns, k, own):
                out.append((np.full(len(found), own[q]), found, score))
        return pa.table({name: np.concatenate([x[i] for x in out]).astype(np.int64) for i, name in enumerate(("query_id", "vec_id", "score"))})

    hits = asked.groupBy("dim", "shard", "block").cogroup(candidates.groupBy("dim", "shard", "block")).applyInArrow(search, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = {
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(len(q.v)), lambda i: q.v[i + 1] * c.v[i + 1])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
QUERIES = {"op7_topk": op7_topk}

"""Nearest vectors for a table of queries: exact cosines by blocks of both sides, cut by norm bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators.retrieval import RRF_K
from chronofact.session import materialize

#: Components multiplied before the bound is looked at, candidates looked at together, and the least norm.
LEAD, CHUNK, LEAST_NORM = 16, 8192, 1e-12
#: Bounds and cosines are sums of doubles; this much is left between them.
SLACK = 1e-9


def best_cosines(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, digits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, cosines) of each query's k rows of greatest rounded cosine, ties to smaller ids.

    Chunk by chunk, the first LEAD components of all rows are multiplied with all queries at once. What the others can
    add is at most the product of their norms; rows whose sum stays under a query's k-th cosine so far, less a
    rounding, cannot enter, and only the others are multiplied in full.
    """
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), LEAST_NORM)
    q, c = unit(queries), unit(rows)
    rest_q, rest_c = (np.sqrt((x[:, LEAD:] ** 2).sum(axis=1)) for x in (q, c))
    best = [(ids[:0], np.zeros(0)) for _ in range(len(q))]
    for at in range(0, len(c), CHUNK):
        part, mine = c[at : at + CHUNK], ids[at : at + CHUNK]
        bound = q[:, :LEAD] @ part[:, :LEAD].T + rest_q[:, None] * rest_c[None, at : at + CHUNK]
        for i in range(len(q)):
            known, scores = best[i]
            floor = scores[-1] - 10.0**-digits if len(scores) == k else -np.inf
            alive = np.flatnonzero(bound[i] + SLACK >= floor)
            found = np.append(scores, np.round(part[alive] @ q[i], digits))
            who = np.append(known, mine[alive])
            top = np.lexsort((who, -found))[:k]
            best[i] = (who[top], found[top])
    return best


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 5, block: int = 1024, shard: int = 65536, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score, rrf): for each row of queries its k vectors of greatest cosine, rounded, ties to smaller ids.

    Queries are cut into blocks and vectors into shards by hash; each block meets each shard in one group, where both
    are matrices (``best_cosines``), and k rows a query leave it. ``rrf`` is what a rank gives a fused list. A query meets
    vectors of its own length; a vector with its own id counts like others. Vectors that are null or empty, or hold null or
    non-finite components, and null ids take no part; of query rows with one id the smallest vector asks.
    """
    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
        return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))).withColumn("dim", F.size("v"))

    there, asked = usable(vectors), usable(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    up = lambda n: F.ceil(F.count(F.lit(1)) / n).cast("int")
    cuts = materialize(there.groupBy("dim").agg(up(shard).alias("shards")).join(asked.groupBy("dim").agg(up(block).alias("blocks")), "dim"), "cuts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    right = there.join(cuts, "dim").withColumn("shard", part("shards")).withColumn("block", every("blocks")).select("dim", "shard", "block", "id", "v")
    left = asked.join(cuts, "dim").withColumn("block", part("blocks")).withColumn("shard", every("shards"))
    left = left.select(*[F.col(c).alias(c) for c in ("dim", "shard", "block", "id", "v")])

    def search(asks: pa.Table, near: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]]
        if asks.num_rows and near.num_rows:
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            found = best_cosines(matrix(asks), matrix(near), near["id"].to_numpy(), k, digits)
            for who, (ids, scores) in zip(asks["id"].to_pylist(), found, strict=True):
                for col, x in zip(out, (np.full(len(ids), who), ids, scores), strict=True):
                    col.append(x)
        return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "id", "score"), out, strict=True)})

    keys = ["dim", "shard", "block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score", (1.0 / (RRF_K + F.col("rank"))).alias("rrf"))

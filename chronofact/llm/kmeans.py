"""Exact k-means over integer vectors, with Drake's adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.session import discard, materialize

#: Bounds are square roots of whole numbers, moved by sums of such; this much is left between two of them for rounding.
SLACK = 1e-9
#: Components of 64 up to here: squared distances fit 64 bits. Up to SMALL doubles hold them exactly, too.
LARGEST, SMALL = 1 << 27, 1 << 22


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each row of c, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * np.sqrt(max(1, x.shape[1]) / 64) <= SMALL:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return np.rint((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c, exact."""
    return ((x - c) ** 2).sum(axis=1)


@dataclass
class Bounds:
    """What is stored of each vector: ``near``, its centroid and the next ones at hand; ``bound``, an upper bound on the
    distance to the first, a lower one for each of the others, and last one for all the rest."""

    near: np.ndarray
    bound: np.ndarray

    @staticmethod
    def scanned(x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
        """From all distances: the nearest b + 1 centroids, ties to smaller numbers, and the next distance."""
        d = _distances(x, c)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        rest = root[:, b + 1] if len(c) > b + 1 else np.full(len(x), np.inf)
        return Bounds(order[:, : b + 1].astype(np.int32), np.column_stack([root[:, : b + 1], rest]))

    def fewer(self, b: int) -> Bounds:
        """The same with b centroids besides the nearest; the bounds of those that go join the rest's."""
        if b + 1 >= self.near.shape[1]:
            return self
        return Bounds(self.near[:, : b + 1], np.column_stack([self.bound[:, : b + 1], self.bound[:, b + 1 :].min(axis=1)]))

    def moved(self, x: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[Bounds, np.ndarray, int]:
        """After the centroids moved to c by drift: new bounds, how many of the others each vector needed, distances computed.

        A vector whose upper bound is under all lower ones stays. Else its own distance is computed, and if that is not
        under them, so are those of the others at hand, up to where the rest is certainly farther than the best one found;
        where no place certifies that, all centroids are scanned.
        """
        near, bound = self.near.copy(), self.bound.copy()
        b = near.shape[1] - 1
        step = drift * (1 + SLACK)
        bound[:, 0] = (bound[:, 0] + step[near[:, 0]]) * (1 + SLACK)
        bound[:, 1 : b + 1] = (bound[:, 1 : b + 1] - step[near[:, 1:]]) * (1 - SLACK)
        bound[:, b + 1] = (bound[:, b + 1] - step.max(initial=0)) * (1 - SLACK)
        used, cost = np.zeros(len(x), dtype=np.int32), 0
        open_ = np.flatnonzero(~(bound[:, 0] < bound[:, 1:].min(axis=1)))
        if len(open_):
            bound[open_, 0] = np.sqrt(_own_distances(x[open_], c[near[open_, 0]]).astype(np.float64))
            cost += len(open_)
            open_ = open_[~(bound[open_, 0] * (1 + SLACK) < bound[open_, 1:].min(axis=1))]
        if len(open_):
            # farther[:, z]: the least bound of what would be left after the first z others.
            farther = np.minimum.accumulate(bound[open_, 1:][:, ::-1], axis=1)[:, ::-1]
            sure = bound[open_, 0][:, None] * (1 + SLACK) < farther
            z = np.where(sure.any(axis=1), sure.argmax(axis=1), b + 1)
            for m in range(1, b + 1):
                rows = open_[z == m]
                if not len(rows):
                    continue
                ids = near[rows, : m + 1]
                d = np.stack([_own_distances(x[rows], c[ids[:, k]]) for k in range(m + 1)], axis=1)
                cost += m * len(rows)
                order = np.lexsort((ids, d), axis=1)
                near[rows, : m + 1] = np.take_along_axis(ids, order, axis=1)
                bound[rows, : m + 1] = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
                used[rows] = m
            rows = open_[z == b + 1]
            if len(rows):
                whole = Bounds.scanned(x[rows], c, b)
                near[rows], bound[rows], used[rows] = whole.near, whole.bound, b
                cost += len(c) * len(rows)
        return Bounds(near, bound), used, cost


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)[: len(rows) + 1]), pa.array(rows.ravel(), kind))


#: A vector with its state; ``used`` is how many others at hand it needed in its last round, ``cost`` a batch's distances (on its first row).
STATE = "id long, v array<int>, near array<int>, bound array<double>, used int, cost long"
#: After the last round: the exact squared distance is stored instead of bounds.
DONE = "id long, cluster int, distance long, cost long"


def _assign(vectors: DataFrame, centers: np.ndarray, drift: np.ndarray | None, b: int, dim: int, last: bool) -> DataFrame:
    """The state after a round of assignment: all centroids scanned without a drift, bounds moved by it otherwise."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column(1), dim)
            used, cost = np.zeros(len(x), dtype=np.int32), len(centers) * len(x)
            if drift is None:
                state = Bounds.scanned(x, centers, b)
            else:
                held = len(batch.column(2)[0])
                state = Bounds(_whole(batch.column(2), held).astype(np.int32), batch.column(3).flatten().to_numpy().reshape(len(x), -1))
                state, used, cost = state.fewer(b).moved(x, centers, drift)
            costs = pa.array(np.append(cost, np.zeros(len(x) - 1, dtype=np.int64)))
            if last:
                own = state.near[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(_own_distances(x, centers[own])), costs], names=["id", "cluster", "distance", "cost"])
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(state.near, pa.int32()), _lists(state.bound, pa.float64()), pa.array(used), costs],
                names=["id", "v", "near", "bound", "used", "cost"],
            )

    return vectors.mapInArrow(work, DONE if last else STATE)


def _sums(state: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, total): count and componentwise sums of each cluster, summed in each task before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column(0), dim)
            x = np.column_stack([x, np.ones(len(x), dtype=np.int64)])
            of = batch.column(1).to_numpy()
            for c in np.unique(of):
                total[int(c)] = total.get(int(c), 0) + x[of == c].sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _lists(np.stack(list(total.values())), pa.int64())], names=["cluster", "sums"])

    parts = state.select("v", F.get("near", F.lit(0)).alias("cluster")).mapInArrow(work, "cluster int, sums array<long>")
    added = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"))
    return added.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda p: p["s"]).alias("sums"))


@dataclass
class Clustering:
    """``rows`` (id, cluster, distance) of every vector; ``centers``; and of each assignment the distances computed."""

    rows: DataFrame
    centers: np.ndarray
    distances: list[int]


def cluster(vectors: DataFrame, seeds: Column, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """k-means of the vectors of ``dim`` components, as integers floor(scale * x), from the k rows of least ``seeds``.

    Each round assigns every vector to its nearest centroid (squared distance, ties to the smaller number), then moves each non-empty
    centroid to the exact floor of its vectors' mean; a last assignment follows. With each vector are stored its centroid with an upper bound
    and the next few with a lower bound each, and one bound for all others; centroids that moved loosen the bounds by how far they
    went, and distances are computed only where those no longer settle the order (``Bounds.moved``). Equal bounds settle nothing, so
    ties are decided by exact distances. The number kept starts at a quarter of k and falls to the most that any vector needed in a
    round, an eighth of k at least. Results are those of computing every distance.

    Each round is one pass over a written table, which the next one replaces, without a shuffle of vectors: what is shuffled is one row of
    sums for each cluster and task. Only centroids, k rows, pass the driver; vectors that are copies are rows like others.

    Vectors that are null, of another length, or hold null or non-finite components take no part. Rows with null ids are
    assigned, but start no centroid; repeated rows count each; ties between seeds go to the smaller vector. With fewer vectors than k
    there are as many centroids; an empty table gives none. Components beyond 2 ** 27 raise an error, as squared
    distances would leave 64 bits. Other columns are ignored.
    """
    limit = int(LARGEST * (64 / max(dim, 64)) ** 0.5)
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    beyond = F.exists("v", lambda x: F.abs(x.cast("double") * scale) > limit)
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), seeds.alias("seed")).where((F.size("v") == dim) & finite)
    kept = kept.select("id", F.when(beyond, F.raise_error(F.lit(f"a component is beyond {limit} / {scale}")).cast("array<int>")).otherwise(whole).alias("v"), "seed")
    first = kept.where("id IS NOT NULL AND seed IS NOT NULL").orderBy("seed", "v").limit(k).collect()
    centers = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dim)
    state, drift, distances = kept.select("id", "v"), None, []
    if not len(centers):
        return Clustering(state.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centers, [])
    b, least = (min(max(1, -(-k // part)), len(centers) - 1) for part in (4, 8))
    for at in range(rounds + 1):
        held = state
        state = materialize(_assign(held, centers, drift, b, dim, at == rounds), "bounds")
        discard(held)
        if at == rounds:
            distances.append(state.agg(F.sum("cost")).first()[0] or 0)
            break
        seen = state.agg(F.max("used").alias("used"), F.sum("cost").alias("cost")).first()
        distances.append(seen["cost"] or 0)
        b = min(b, max(least, seen["used"])) if at else b
        new = centers.copy()
        for r in _sums(state, dim).collect():
            new[r["cluster"]] = [s // r["sums"][-1] for s in r["sums"][:-1]]
        drift, centers = np.sqrt(_own_distances(new, centers).astype(np.float64)), new
    return Clustering(state.select("id", "cluster", "distance"), centers, distances)


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    """The clusters of ``embeddings``; a row for each of its 16 clusters joins their sums and centroids."""
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    sums = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, found.centers[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    named = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.withColumnRenamed("id", "vec_id").join(F.broadcast(named), "cluster")


def _sql(k: int = 16, rounds: int = 3) -> str:
    """Every distance computed, each round a few named tables."""
    steps = [
        """v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INT) AS c, v AS m FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, v, arg_min(c, d * {k} + c) AS c, min(d) AS d
  FROM (SELECT rid, vec_id, v, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS BIGINT) AS d
        FROM (SELECT *, row_number() OVER () AS rid FROM v) CROSS JOIN c{r})
  GROUP BY rid, vec_id, v
)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
c{r + 1} AS (
  SELECT c{r}.c, coalesce(f.m, c{r}.m) AS m
  FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY c) f ON f.c = c{r}.c
)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a{rounds}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""


SQL = {"op12_clusters": _sql()}
QUERIES = {"op12_clusters": op12_clusters}

"""MinHash near-duplicate detection with an LSH forest: sorted signature orders, longest-prefix neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.components import components, joined
from chronofact.llm.shingles import mixed, shingle_set, word_hashes
from chronofact.session import materialize, partitions

LEVELS = 8


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tree_keys(shingles: np.ndarray, trees: int) -> np.ndarray:
    """One 64-bit key a tree: eight MinHash values, eight bits of each, the first in the highest byte."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 32, trees * LEVELS, dtype=np.uint32)[:, None] | np.uint32(1)
    b = rng.integers(0, 1 << 32, trees * LEVELS, dtype=np.uint32)[:, None]
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(trees * LEVELS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        least = np.minimum(least, (x[None, at : at + 1024] * a + b).min(axis=1))
    level = np.arange(trees * LEVELS, dtype=np.uint64)
    byte = mixed(least.astype(np.uint64) + (level << np.uint64(32))).astype(np.uint8)
    return byte.reshape(trees, LEVELS).view(">u8").ravel()


def _set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """(id, row, n, key, sig) of (id, row, text): set size, 128-bit hash of the set, tree keys as big-endian bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for words in word_hashes(_texts(batch.column(2))):
                s = shingle_set(words, width)
                n.append(len(s))
                key.append(_set_key(s))
                sig.append(tree_keys(s, trees).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["id", "row", "n", "key", "sig"])

    return docs.mapInArrow(task, "id long, row long, n long, key binary, sig binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(key, s) of (id, row, text): the 128-bit hash of the set, and the whole sorted set of 64-bit shingle hashes as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(w, width) for w in word_hashes(_texts(part.column(2)))]
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "s"])

    return docs.mapInArrow(task, "key binary, s binary")


def forest_candidates(reps: DataFrame, trees: int, near: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, votes) with a < b, of (id, n, sig): neighbours in the sorted orders of the trees; and (tree, region, id)
    of the regions, runs of rows that agree in ``least`` levels, that hold more rows than neighbours pair in full.

    Each tree sorts all rows by its key. Rows up to ``near`` places apart are candidates when their keys agree in at
    least ``least`` leading levels; as neighbours have the longest common prefixes, a crowded region is cut at a
    deeper level than a sparse one, and a row never has more than 2 * near * trees candidates. The orders are range
    partitions with the id as last key, so a region of any size is cut over tasks; the rows at the ends of each
    partition are kept, and paired over the cuts.
    """
    spark = reps.sparkSession

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if rows:
                keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=">u8").astype(np.uint64)
                signed = (keys ^ np.uint64(1 << 63)).view(np.int64)  # keeps the order
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(trees, dtype=np.int32), rows)), pa.array(signed), pa.array(np.repeat(ids, trees)), pa.array(np.repeat(batch.column(1).to_numpy(), trees))],
                    ["tree", "key", "id", "n"],
                )

    def pairs(tree, key, ids, n) -> Iterator[tuple[np.ndarray, ...]]:
        word = key.view(np.uint64) ^ np.uint64(1 << 63)
        for d in range(1, near + 1):
            if len(ids) <= d:
                return
            differ = word[:-d] ^ word[d:]
            shared = sum((differ >> np.uint64(64 - 8 * level) == 0).astype(np.int64) for level in range(1, LEVELS)) + (differ == 0)
            x, y = ids[:-d], ids[d:]
            small, large = np.minimum(n[:-d], n[d:]), np.maximum(n[:-d], n[d:])
            good = (tree[:-d] == tree[d:]) & (shared >= least) & (10 * small >= 8 * large)
            yield np.minimum(x, y)[good], np.maximum(x, y)[good], shared[good]

    kinds = "kind int, part int, place int, tree int, key long, a long, b long, n long"
    names = [k.split()[0] for k in kinds.split(", ")]

    def rows(kind, part, place, tree, key, a, b, n) -> pa.RecordBatch:
        size = len(a)
        full = lambda x, t: np.full(size, x, dtype=t) if np.isscalar(x) else np.asarray(x).astype(t)
        return pa.RecordBatch.from_arrays(
            [pa.array(full(x, t)) for x, t in ((kind, np.int32), (part, np.int32), (place, np.int32), (tree, np.int32), (key, np.int64), (a, np.int64), (b, np.int64), (n, np.int64))], names
        )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        tree, key, ids, n = (np.concatenate(x) for x in zip(*got, strict=True))
        for a, b, shared in pairs(tree, key, ids, n):
            yield rows(0, 0, 0, 0, shared, a, b, 0)
        at = np.arange(len(ids))
        end = (at < near) | (at >= len(ids) - near)
        yield rows(1, part, at[end], tree[end], key[end], ids[end], 0, n[end])
        region = key >> np.int64(64 - 8 * least)
        fresh = np.append(True, (tree[1:] != tree[:-1]) | (region[1:] != region[:-1]))
        run = np.cumsum(fresh) - 1
        size = np.bincount(run)[run]
        # Regions that neighbours do not pair in full; the first and last may go on in the next partition.
        crowded = (size > near + 1) | (run == 0) | (run == run[-1])
        yield rows(2, part, 0, tree[crowded], region[crowded], ids[crowded], 0, n[crowded])

    order = ["tree", "key", "id"]
    found = materialize(
        reps.select("id", "n", "sig").mapInArrow(explode, "tree int, key long, id long, n long").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(neighbours, kinds),
        "neighbours",
    )
    # Ends of partitions, at most 2 * near rows of each: pairs over the cuts, in one order of partitions and places.
    ends = found.where("kind = 1")
    line = Window.orderBy("part", "place")
    cut = ends.select("part", "place", "tree", "key", F.col("a").alias("id"), "n")
    over = None
    for d in range(1, near + 1):
        ahead = cut.select("part", "tree", "key", "id", "n", F.lead(F.struct("part", "tree", "key", "id", "n"), d).over(line).alias("o")).where("o IS NOT NULL AND part <> o.part AND tree = o.tree")
        over = ahead if over is None else over.union(ahead)
    differ = F.col("key").bitwiseXOR(F.col("o.key"))
    shared = sum((F.shiftrightunsigned(differ, 64 - 8 * level) == 0).cast("long") for level in range(1, LEVELS)) + (differ == 0).cast("long")
    over = (
        over.withColumn("shared", shared)
        .where((F.col("shared") >= least) & (10 * F.least("n", "o.n") >= 8 * F.greatest("n", "o.n")))
        .select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"), "shared")
    )
    inner = found.where("kind = 0").select("a", "b", F.col("key").alias("shared"))
    crowded = found.where("kind = 2").select("tree", F.col("key").alias("region"), F.col("a").alias("id"))
    return inner.union(over).where("a < b").groupBy("a", "b").agg(F.sum("shared").alias("votes")), crowded


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet: 100 * intersection >= percent * union."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def open_regions(crowded: DataFrame, roots: DataFrame, near: int) -> DataFrame:
    """(tree, region, id, root, size) of the crowded regions whose rows the links so far leave in several components."""
    named = materialize(crowded.join(roots, F.col("id") == F.col("node"), "left").select("tree", "region", "id", F.coalesce("root", "id").alias("root")), "regions")
    several = named.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    several = materialize(several.where((F.col("size") > near + 1) & (F.col("lo") != F.col("hi"))).select("tree", "region", "size"), "open")
    return materialize(named.join(several, ["tree", "region"]), "open")


def pivot_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): in each open region, its most central row with each row of another component.

    Central is the row whose open regions hold the most rows over all trees: the common source of many copies keeps
    its prefix where each copy loses some.
    """
    weight = rows.groupBy("id").agg(F.sum("size").alias("w"))
    heads = rows.join(weight, "id").groupBy("tree", "region").agg(F.max(F.struct("w", "id", "root")).alias("p"))
    heads = materialize(heads.select("tree", "region", F.col("p.id").alias("pid"), F.col("p.root").alias("proot")), "pivots")
    apart = rows.join(heads, ["tree", "region"]).where("root <> proot")
    return apart.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct()


def remaining_links(rows: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, block: int = 256, block_bytes: int = 4 << 20) -> DataFrame:
    """(a, b): links between components inside what open regions connect, with nothing left out.

    Open regions that share rows form clusters. A link between components has an end outside the cluster's most
    frequent one: those rows are asked, against all rows. Sets that link differ in size by percent / 100 at most, so rows
    are classed by the logarithm of their size (n, of ``sizes``) to that base, and asked rows meet the rows of their
    own class and of the two beside it. Both are cut by hash into blocks of about ``block`` rows and ``block_bytes``
    bytes of sets, whichever is less, and each pair of blocks is one group, decided on full sets over an index of its
    shingles. Only links come out, no pairs.
    """
    at = components(rows.select(F.col("id").alias("a"), F.xxhash64("tree", "region").alias("b")))
    ids = rows.select("id", F.col("root").alias("own")).distinct().join(at, F.col("id") == F.col("node")).select("id", "own", F.col("root").alias("cluster"))
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    ids = materialize(ids.join(sizes.select("id", "n"), "id").select("id", "own", "cluster", "n", level.alias("level")), "clusters")
    main = ids.groupBy("cluster", "own").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "own"))["own"].alias("main"))
    named = materialize(ids.join(main, "cluster"), "clusters")
    near = F.explode(F.array(*[F.col("level") + d for d in (-1, 0, 1)]))
    # Three rows a row, of numbers only: which of them meet asked rows is known before any set is copied.
    targets = named.select("cluster", near.alias("level"), "id", "own", "n")
    asked = named.where("own <> main").select("cluster", "level", "id", "own", "n")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(8 * size / block_bytes)).cast("int")
    na = asked.groupBy("cluster", "level").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("na"))
    nt = targets.groupBy("cluster", "level").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("nt"))
    cells = materialize(na.join(nt, ["cluster", "level"]), "cells")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    target = targets.join(cells, ["cluster", "level"]).select("cluster", "level", part("nt", "t").alias("t"), every("na").alias("q"), "id", "own", F.lit(False).alias("asked"))
    asks = asked.join(cells, ["cluster", "level"]).select("cluster", "level", every("nt").alias("t"), part("na", "q").alias("q"), "id", "own", F.lit(True).alias("asked"))
    cells = target.unionByName(asks).join(sets, "id")

    def links(group: pa.Table) -> pa.Table:
        ids, own, asks = group["id"].to_numpy(), group["own"].to_numpy(), group["asked"].to_numpy()
        full = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["s"]]
        at = np.flatnonzero(~asks)
        a, b = [], []
        if len(at) and asks.any():
            size = np.array([len(full[i]) for i in at])
            row = np.repeat(np.arange(len(at)), size)
            flat = np.concatenate([full[i] for i in at])
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            for x in np.flatnonzero(asks):
                first, last = np.searchsorted(flat, full[x], "left"), np.searchsorted(flat, full[x], "right")
                met = np.repeat(first - np.append(0, np.cumsum(last - first)[:-1]), last - first) + np.arange(int((last - first).sum()))
                both = np.bincount(row[met], minlength=len(at))
                good = (100 * both >= percent * (size + len(full[x]) - both)) & (own[at] != own[x])
                for y in at[np.flatnonzero(good)]:
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("cluster", "level", "t", "q").applyInArrow(links, "a long, b long").distinct()


def near_dedup(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    trees: int = 32,
    near: int = 2,
    least: int = 5,
    first: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Documents are linked when their sets of ``width``-word shingles have a Jaccard similarity of percent / 100 or
    more. Equal sets are collapsed first, by a 128-bit hash of the set, so exact copies cost one row. The others meet
    in an LSH forest (``forest_candidates``): at similarity 0.8 a pair shares ``least`` = 5 levels of a tree with
    probability 0.33, and misses all of 32 trees with probability 3e-6. Every candidate is decided on full sets of
    64-bit shingle hashes, in rounds: each document's ``first`` candidates with the most votes; those neighbours whose
    documents the links so far leave in different components (a pair inside one component cannot change the result);
    then, as neighbours alone do not pair a crowded region in full, the most central row of each crowded region with
    its other components; and last all that remains between components in such regions (``remaining_links``).

    Words are runs of other than white space, A-Z folded. Null and empty texts have no shingles, form a component
    each and are kept; of fewer words than ``width`` the whole sequence is one shingle. Each different set is one node, under
    a key of its own, so rows equal in id link by their own texts each, and rows with null ids link like others.
    component_id is the smallest id reachable; where all are null it is null, and all of the component's rows count as
    kept. Empty tables give empty results; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    signed = materialize(signatures(slim, width, trees), "signatures")
    least_row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("at")
    nodes = signed.where("key IS NOT NULL").groupBy("key").agg(least_row, F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = materialize(nodes.select("key", F.monotonically_increasing_id().alias("id"), F.col("at.id").alias("doc"), F.col("at.row").alias("row"), "n", "sig"), "reps")
    pairs, crowded = forest_candidates(reps, trees, near, least)
    pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowded.select("id")).distinct()
    # One row of each node is read again; the rest of a row's key is a hash, so its set's own key decides whose set it is.
    rows = reps.join(ends, "id", "left_semi").select("row").distinct()
    found = shingle_sets(slim.join(rows.hint("merge"), "row", "left_semi").select("id", "row", "text"), width)
    sets = materialize(found.groupBy("key").agg(F.first("s").alias("s")).join(reps.select("key", "id"), "key").select("id", "s"), "sets")

    best = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("votes"), "a", "b"))
    ranked = materialize(pairs.withColumn("ra", best("a")).withColumn("rb", best("b")).withColumn("early", (F.col("ra") <= first) | (F.col("rb") <= first)), "ranked")
    links = materialize(confirm(ranked.where("early"), sets, percent), "links")
    roots = components(links)
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ta")), roots.select(F.col("node").alias("b"), F.col("root").alias("tb"))
    apart = ranked.where("NOT early").join(ra, "a", "left").join(rb, "b", "left").where("NOT (coalesce(ta, a) <=> coalesce(tb, b))").select("a", "b")
    roots = joined(roots, confirm(apart, sets, percent))
    pivots = pivot_pairs(open_regions(crowded, roots, near)).join(pairs, ["a", "b"], "left_anti")
    roots = joined(roots, confirm(pivots, sets, percent))
    roots = joined(roots, remaining_links(open_regions(crowded, roots, near), reps, sets, percent))

    whole = reps.select("key", "id", "doc").join(roots, F.col("id") == F.col("node"), "left").select("key", "doc", F.coalesce("root", "id").alias("root"))
    # Written, so that both sides of the join are shuffled for it alone and a large component's rows can be split.
    whole = materialize(whole, "roots")
    least_id = materialize(whole.groupBy("root").agg(F.min("doc").alias("component")), "least")
    named = materialize(whole.join(least_id, "root").select("key", "component"), "named")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return signed.join(named, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


SQL = {
    "op2_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
""",
}
QUERIES = {"op2_near_dedup": op2_near_dedup}

"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); nodes of one component have one root.

    Each round every node moves to the neighbour (or itself) first in a random order, and twice more along those
    moves; links are renamed and made distinct, and the next round works on what is left, smaller by a constant
    factor on average whatever the shape. The moves of all rounds are then composed. All tables stay distributed and
    each round is written to the shared folder.
    """
    left = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = left.select("a", "b").union(left.select("b", "a"))
        best = both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["id"].alias("to")).withColumnRenamed("a", "node")
        step = materialize(best, "moves")
        onward = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        best = step.join(onward, "to").select("node", F.col("far").alias("to")).join(onward, "to").select("node", F.col("far").alias("to"))
        best = materialize(best, "moves")
        moves.append(best)
        a, b = best.select(F.col("node").alias("a"), F.col("to").alias("ta")), best.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = materialize(left.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0]
    for m in moves[1:]:
        later = m.select(F.col("node").alias("to"), F.col("to").alias("far"))
        out = out.join(later, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
    return materialize(out.select("node", F.col("to").alias("root")), "roots")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after more links: only the links between different components are worked on."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    named = materialize(links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")), "links")
    apart = named.where("ra <> rb")
    if apart.isEmpty():
        return roots
    moved = components(apart.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
    fresh = apart.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("rb").alias("root")))).alias("x")).select("x.*")
    every = roots.select("node", "root").union(fresh).distinct()
    return materialize(every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")

"""Interval predicates and joins. Each predicate has a name of its own, as they differ in their treatment of ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def strict(s1: Column, e1: Column, s2: Column, e2: Column, tol: float = 0.0) -> Column:
    """The open intervals, widened by tol, meet: instants never meet what starts at them."""
    return (s1 < e2 + tol) & (s2 < e1 + tol)


def closed(s1: Column, e1: Column, lo: Column, hi: Column) -> Column:
    """The closed intervals meet; a null bound is open."""
    return F.coalesce(e1 >= lo, F.lit(True)) & F.coalesce(s1 <= hi, F.lit(True))


def contains(s: Column, e: Column, t: Column) -> Column:
    """The half-open interval holds t; an instant holds itself."""
    return ((s <= t) & (t < e)) | (t == s)


def relations(a1: Column, a2: Column, b1: Column, b2: Column, tolerance: float = 1.0, near: float = 5.0) -> Column:
    """The names of all relations of [a1, a2] to [b1, b2]. OVERLAPS, PRECEDES and FOLLOWS are exact, others tolerant."""
    overlap = (a1 < b2 - EPS) & (b1 < a2 - EPS)
    gap = F.greatest(F.lit(0.0), F.greatest(a1, b1) - F.least(a2, b2))
    tests = [
        ("BEFORE", a2 <= b1 + tolerance),
        ("AFTER", a1 >= b2 - tolerance),
        ("DURING", (b1 - tolerance <= a1) & (a2 <= b2 + tolerance)),
        ("CONTAINS", (a1 - tolerance <= b1) & (b2 <= a2 + tolerance)),
        ("OVERLAPS", overlap),
        ("PRECEDES", a2 <= b1 + EPS),
        ("FOLLOWS", a1 >= b2 - EPS),
        ("NEAR", gap <= near),
        ("CO_OCCURS", overlap | (gap <= tolerance)),
        ("STARTS_WITHIN", (b1 - tolerance <= a1) & (a1 <= b2 + tolerance)),
        ("ENDS_WITHIN", (b1 - tolerance <= a2) & (a2 <= b2 + tolerance)),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda x: x.isNotNull())


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, tol: float = 0.0, kind: str = "strict", left_cols=("start", "end"), right_cols=("start", "end")) -> DataFrame:
    """Pairs of rows with equal keys whose intervals meet: columns l_* and r_*.

    Both sides are cut into buckets of ``width`` seconds, joined by key and bucket, an equi-join that Spark can hash,
    sort and split, and tested. A pair is emitted in the later of its two first buckets only, so there is nothing to
    deduplicate. Choose a width near the typical length; longer intervals repeat in more buckets.
    """
    def bucketed(df: DataFrame, cols, p: str, widen: float) -> DataFrame:
        s, e = F.col(cols[0]) - widen, F.col(cols[1]) + widen
        first, last = F.floor(s / width), F.floor(e / width)
        out = df.select(*[F.col(c).alias(p + c) for c in df.columns], first.alias(p + "_first"), F.explode(F.sequence(first, F.greatest(first, last))).alias(p + "_bucket"))
        return out

    a, b = bucketed(left, left_cols, "l_", tol), bucketed(right, right_cols, "r_", 0.0)
    on = [F.col("l_" + k) == F.col("r_" + k) for k in keys] + [F.col("l__bucket") == F.col("r__bucket")]
    ls, le = F.col("l_" + left_cols[0]), F.col("l_" + left_cols[1])
    rs, re = F.col("r_" + right_cols[0]), F.col("r_" + right_cols[1])
    test = strict(ls, le, rs, re, tol) if kind == "strict" else (le + tol >= rs) & (ls - tol <= re)
    once = F.col("l__bucket") == F.greatest("l__first", "r__first")
    return a.join(b, on).where(test & once).drop("l__bucket", "r__bucket", "l__first", "r__first")


def islands(df: DataFrame, keys: list[str], gap: float, order: tuple[str, ...] = ("start", "end"), start: str = "start", end: str = "end", running: bool = True, name: str = "island") -> DataFrame:
    """Number the runs of each key's rows: a row begins a run when it starts more than ``gap`` after what came before.

    running=True measures from the greatest end so far (merging), False from the previous row's end (sessions).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag(end).over(w)
    fresh = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge_windows(df: DataFrame, keys: list[str], gap: float = EPS) -> DataFrame:
    """The union of each key's windows, touching ones joined: keys, start, end."""
    return islands(df, keys, gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def window_around(start: Column, end: Column, radius: float, duration: Column | None = None) -> tuple[Column, Column]:
    """[start - radius, end + radius] cut to the recording."""
    hi = end + radius
    return F.greatest(F.lit(0.0), start - radius), hi if duration is None else F.least(hi, duration)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, id_cols: list[str], tie: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it (or none): left columns and r_* columns.

    One union sorted by key and time, and the last right row seen so far: a single shuffle, no pair is formed.
    """
    cols = [F.col(c) for c in left.columns]
    r = F.struct(*[F.col(c) for c in right.columns])
    lefts = left.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_l"), F.lit(None).cast(right.select(r.alias("r")).schema["r"].dataType).alias("_r"), *[F.lit(None).cast(right.schema[t].dataType).alias("_t_" + t) for t in tie])
    rights = right.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_l"].dataType).alias("_l"), r.alias("_r"), *[F.col(t).alias("_t_" + t) for t in tie])
    w = Window.partitionBy(*["_k_" + k for k in keys]).orderBy("_at", "_side", *["_t_" + t for t in tie]).rowsBetween(Window.unboundedPreceding, 0)
    seen = lefts.unionByName(rights).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_l.*", *[F.col("_last")[c].alias("r_" + c) for c in right.columns])

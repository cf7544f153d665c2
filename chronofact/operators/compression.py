"""Visual states from described moments, and intervals between interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators.intervals import interval_join


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def visual_states(moments: DataFrame, least: float = 0.7) -> DataFrame:
    """States of (video_id, start, end, description, entities, actions): a new one where likeness to the moment before
    falls under ``least``; likeness is 0.6 of the entities' Jaccard and 0.4 of the actions', 1 for one description."""
    w = Window.partitionBy("video_id").orderBy("start", "end")
    alike = F.when(F.col("description") == F.lag("description").over(w), F.lit(1.0)).otherwise(
        0.6 * jaccard(F.col("entities"), F.lag("entities").over(w)) + 0.4 * jaccard(F.col("actions"), F.lag("actions").over(w))
    )
    fresh = F.when(F.lag("start").over(w).isNull() | (alike < least), 1).otherwise(0)
    rows = moments.withColumn("_f", fresh).withColumn("state", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entities = F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities"))))
    return rows.groupBy("video_id", "state").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("moments"), entities.alias("entities"))


def state_changes(states: DataFrame) -> DataFrame:
    """appeared and disappeared events between neighbouring states: (video_id, ts, change, entity)."""
    w = Window.partitionBy("video_id").orderBy("state")
    rows = states.withColumn("before", F.lag("entities").over(w)).where("before IS NOT NULL")
    change = lambda name, a, b: F.transform(F.array_except(a, b), lambda x: F.struct(F.lit(name).alias("change"), x.alias("entity")))
    both = F.concat(change("appeared", "entities", "before"), change("disappeared", "before", "entities"))
    return rows.select("video_id", F.col("start").alias("ts"), F.explode(both).alias("x")).select("video_id", "ts", "x.*")


def persistent_elements(elements: DataFrame, frames: DataFrame, share: float = 0.8) -> DataFrame:
    """Elements (video_id, state, ts, element) seen in at least ``share`` of their state's frames (video_id, state, ts)."""
    total = frames.groupBy("video_id", "state").agg(F.count_distinct("ts").alias("frames"))
    seen = elements.groupBy("video_id", "state", "element").agg(F.count_distinct("ts").alias("n"))
    return seen.join(total, ["video_id", "state"]).where(F.col("n") >= share * F.col("frames")).select("video_id", "state", "element", "n")


def interaction_intervals(events: DataFrame, notes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Intervals between boundary events of the kinds, each with the number of notes that lie in it."""
    w = Window.partitionBy("video_id").orderBy("start", "fact_id")
    edges = events.where(F.col("kind").isin(*kinds)).select("video_id", F.col("fact_id").alias("from_id"), "start", F.lead("start").over(w).alias("end"))
    spans = edges.where("end IS NOT NULL AND end > start")
    inside = interval_join(spans, notes, ["video_id"], 30.0, 0.0, "closed").where("l_start <= r_start AND r_end <= l_end")
    counts = inside.groupBy(F.col("l_from_id").alias("from_id")).agg(F.count(F.lit(1)).alias("notes"))
    return spans.join(counts, "from_id", "left").select("video_id", "from_id", "start", "end", F.coalesce("notes", F.lit(0)).alias("notes"))

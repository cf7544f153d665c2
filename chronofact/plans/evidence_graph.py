"""The whole evidence graph of recordings: a node table and an edge table, from facts and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators import entities as E
from chronofact.operators import graph as G
from chronofact.operators import temporal as T
from chronofact.operators.evidence_search import fact_edges


def shown_scenes(facts: DataFrame, durations: DataFrame) -> DataFrame:
    """Scenes where none are known: a recording is cut where a screen text begins."""
    cuts = facts.where("modality = 'ocr'").select("video_id", "start").distinct().join(durations, "video_id")
    return cuts.select("video_id", "start", F.coalesce(F.lead("start").over(Window.partitionBy("video_id").orderBy("start")), F.col("duration")).alias("end"))


def nodes_of(rows: DataFrame, kind: str, name: Column, start: Column, end: Column, label: Column, observed: bool = False) -> DataFrame:
    return rows.select(F.concat("video_id", F.lit("/"), name).alias("id"), "video_id", F.lit(kind).alias("node_kind"), start.alias("start"), end.alias("end"), F.substring(label, 1, 160).alias("label"), F.lit(observed).alias("observed"))


def whole_graph(facts: DataFrame, durations: DataFrame, scenes: DataFrame | None = None, chapter_seconds: float = 300.0, most_nodes: int | None = None, most_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, video_id, node_kind, start, end, label, observed) and edges (src, dst, relation, confidence).

    Edges are those between facts and those of derived nodes; every edge's ends are nodes. With ``most_nodes`` a
    recording keeps its first nodes, observed ones first, in order of time, and the edges between these; with
    ``most_edges`` its first edges in order of their ends.
    """
    scenes = shown_scenes(facts, durations) if scenes is None else scenes
    m = E.mentions(facts)
    regions = scenes.withColumn("region", F.row_number().over(Window.partitionBy("video_id").orderBy("start", "end")) - 1)
    changes, chapters = T.change_points(regions, facts), T.cut_chapters(scenes, durations, chapter_seconds)
    states = T.states(facts.where(F.col("modality").isin("ocr", "transcript") & (F.col("end") > F.col("start"))))
    ruled = T.rule_events(facts.where("modality = 'ocr'"), scenes)
    edges = G.build_edges(fact_edges(facts), G.entity_edges(m), G.derived_edges(changes, states, chapters, scenes, facts, ruled))
    s, e, text = F.col("start"), F.col("end"), lambda c: F.col(c).cast("string")
    names = m.groupBy("video_id", "name").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    derived = [
        nodes_of(names, "entity", F.concat(F.lit("entity/"), "name"), s, e, F.col("name")),
        nodes_of(m.select("video_id", "name", "fact_id", "start", "end").distinct(), "occurrence", F.concat(F.lit("entity/"), "name", F.lit("#"), "fact_id"), s, e, F.col("name")),
        nodes_of(changes, "change", F.concat(F.lit("change/"), text("ts")), F.col("ts"), F.col("ts"), F.col("change_type")),
        nodes_of(states, "state", F.concat(F.lit("state/"), text("state")), s, e, F.col("evidence_ids")),
        nodes_of(chapters, "chapter", F.concat(F.lit("chapter/"), text("chapter")), s, e, F.concat(F.lit("chapter "), text("chapter"))),
        nodes_of(scenes, "scene", F.concat(F.lit("scene/"), text("start")), s, e, F.lit("scene"), True),
        nodes_of(ruled.where("ref IS NOT NULL").groupBy("video_id", "type", "ref").agg(F.min("start").alias("start"), F.max("end").alias("end")), "rule", F.concat(F.lit("rule/"), "type", F.lit("/"), "ref"), s, e, F.col("type")),
    ]
    nodes = G.fact_nodes(facts)
    for more in derived:
        nodes = nodes.unionByName(more)
    if most_nodes is not None:
        nodes = G.capped(nodes.withColumn("_late", ~F.col("observed")), ["video_id"], most_nodes, ["_late", "start", "id"]).drop("_late")
        held = nodes.select("id")
        edges = edges.join(held.withColumnRenamed("id", "src"), "src", "left_semi").join(held.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if most_edges is not None:
        edges = G.capped(edges.withColumn("_video", F.split_part("src", F.lit("/"), F.lit(1))), ["_video"], most_edges, ["src", "dst", "relation"]).drop("_video")
    return nodes, edges.select("src", "dst", "relation", "confidence")

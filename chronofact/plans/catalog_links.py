"""Queries that tie facts, segments, entities and states together, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators import compression as C
from chronofact.operators import entities as E
from chronofact.operators import temporal as T
from chronofact.operators.intervals import asof_backward, interval_join
from chronofact.plans.catalog_entities import MENTIONS
from chronofact.plans.catalog_temporal import DUR, SCENES, scenes
from chronofact.session import table
from chronofact.sources.facts import FACTS_SQL, facts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


_SEGMENTS = """c AS (SELECT video_id, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE "start" END AS s, coalesce(lead("start") OVER w, "end") AS e FROM scenes WINDOW w AS (PARTITION BY video_id ORDER BY "start", "end")),
k AS (SELECT video_id, s, e, CAST(greatest(1, ceil((e - s) / 45)) AS INT) AS n FROM c WHERE e > s),
g AS (SELECT video_id, s + i * ((e - s) / n) AS a, CASE WHEN i + 1 = n THEN e ELSE s + (i + 1) * ((e - s) / n) END AS b FROM k, unnest(range(n)) t(i)),
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a) - 1 AS segment, max(b) OVER (PARTITION BY video_id) AS last FROM g),
members AS (SELECT z.video_id, segment, f.* EXCLUDE (video_id) FROM z JOIN facts f ON f.video_id = z.video_id AND
  CASE WHEN f."end" > f."start" THEN f."start" < b AND a < f."end" ELSE a <= f."start" AND (f."start" < b OR (f."start" = b AND b = last)) END)"""


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, {_SEGMENTS} SELECT fact_id, string_agg(CAST(segment AS VARCHAR), ',' ORDER BY segment) AS segments FROM members GROUP BY fact_id""")
def segment_map(spark, sf) -> DataFrame:
    """The segments of each fact, in order."""
    members = T.segment_members(T.plan_segments(scenes(spark, sf)), facts(spark, sf))
    return members.groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_list("segment")), ",").alias("segments"))


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, {_SEGMENTS} SELECT video_id, CAST(segment AS BIGINT) AS segment, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages, min(confidence) AS confidence FROM members GROUP BY ALL""")
def segment_languages(spark, sf) -> DataFrame:
    """Each segment's languages, and the least known confidence of its facts."""
    members = T.segment_members(T.plan_segments(scenes(spark, sf)), facts(spark, sf))
    return members.groupBy("video_id", F.col("segment").cast("long").alias("segment")).agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.min("confidence").alias("confidence"))


@query(f"""WITH {FACTS_SQL}, h AS (SELECT video_id, min("start") - 10 AS s, max("end") + 10 AS e FROM facts WHERE kind = 'signup' GROUP BY video_id)
SELECT f.fact_id FROM facts f JOIN h ON f.video_id = h.video_id AND f."start" < e AND s < f."end" """)
def surrounding_context(spark, sf) -> DataFrame:
    """Facts in one window around all of a recording's signups."""
    rows = facts(spark, sf)
    hull = rows.where("kind = 'signup'").groupBy(F.col("video_id").alias("v")).agg((F.min("start") - 10).alias("s"), (F.max("end") + 10).alias("e"))
    return rows.join(hull, F.col("video_id") == F.col("v")).where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))).select("fact_id")


@query(f"""WITH {FACTS_SQL}, e AS (SELECT video_id, fact_id, "start" FROM facts WHERE kind = 'error'), o AS (SELECT video_id, fact_id AS next_id, "start" FROM facts WHERE modality = 'ocr')
SELECT e.fact_id, o.next_id FROM e ASOF LEFT JOIN o ON e.video_id = o.video_id AND e."start" <= o."start" """)
def asof_next(spark, sf) -> DataFrame:
    """Each error with the screen text that begins next: the backward join on reversed time."""
    rows = facts(spark, sf)
    errors = rows.where("kind = 'error'").select("video_id", "fact_id", (-F.col("start")).alias("start"))
    shown = rows.where("modality = 'ocr'").select("video_id", (-F.col("start")).alias("start"), "fact_id")
    return asof_backward(errors, shown, ["video_id"], "start", "start", ["fact_id"], ["fact_id"]).select("fact_id", F.col("r_fact_id").alias("next_id"))


@query(f"""WITH {FACTS_SQL} SELECT c.fact_id AS change_id, s.fact_id AS state_id FROM facts c JOIN facts s ON c.video_id = s.video_id AND c.kind = 'purchase' AND s.modality = 'ocr' AND abs(c."start" - s."start") <= 2""")
def band_join(spark, sf) -> DataFrame:
    """Purchases and screen texts that start within two seconds of each other."""
    rows = facts(spark, sf)
    point = lambda df: df.select("video_id", "fact_id", "start", F.col("start").alias("end"))
    pairs = interval_join(point(rows.where("kind = 'purchase'")), point(rows.where("modality = 'ocr'")), ["video_id"], 30.0, 2.0, "closed")
    return pairs.select(F.col("l_fact_id").alias("change_id"), F.col("r_fact_id").alias("state_id"))


@query(f"""WITH {FACTS_SQL}, {MENTIONS} SELECT name, string_agg(DISTINCT video_id, ',' ORDER BY video_id) AS videos, count(*) AS n FROM mentions GROUP BY name HAVING count(DISTINCT video_id) BETWEEN 2 AND 5""")
def entity_links(spark, sf) -> DataFrame:
    """Names that two to five recordings share, and which."""
    m = E.mentions(facts(spark, sf))
    return m.groupBy("name").agg(F.array_sort(F.collect_set("video_id")).alias("v"), F.count(F.lit(1)).alias("n")).where(F.size("v").between(2, 5)).select("name", F.array_join("v", ",").alias("videos"), "n")


@query(f"""WITH {FACTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, kind ORDER BY "start", fact_id) AS r FROM facts WHERE modality = 'events') SELECT video_id, kind, fact_id FROM o WHERE r = 1""")
def distinct_first(spark, sf) -> DataFrame:
    """The first event of each kind in each recording: distinct with an order."""
    w = Window.partitionBy("video_id", "kind").orderBy("start", "fact_id")
    return facts(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("video_id", "kind", "fact_id")


_MOMENTS = """m AS (SELECT label AS video_id, vec_id, list_sort(list_distinct(list_transform(embedding[1:4], lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 4) AS BIGINT) AS VARCHAR)))) AS es FROM embeddings),
l AS (SELECT *, lag(es) OVER (PARTITION BY video_id ORDER BY vec_id) AS b FROM m),
j AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE 1.0 * len(list_intersect(es, b)) / len(list_distinct(list_concat(es, b))) END AS sim FROM l)"""


@query(f"""WITH {_MOMENTS}, s AS (SELECT *, sum(CASE WHEN b IS NULL OR sim < 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY vec_id) AS state FROM j)
SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(state AS BIGINT) AS state, count(*) AS moments, min(vec_id)::DOUBLE AS "start", max(vec_id)::DOUBLE AS "end" FROM s GROUP BY ALL""")
def visual_states(spark, sf) -> DataFrame:
    """States of a sequence of moments, whose entities are the first quantised components of each vector."""
    entities = F.array_distinct(F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x.cast("double") * 4).cast("string")))
    at = F.col("vec_id").cast("double")
    moments = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("video_id"), at.alias("start"), at.alias("end"), F.col("vec_id").cast("string").alias("description"), entities.alias("entities"), entities.alias("actions"))
    return C.visual_states(moments).select("video_id", F.col("state").cast("long").alias("state"), "moments", "start", "end")


@query(f"""WITH {FACTS_SQL}, b AS (SELECT video_id, fact_id AS from_id, "start" AS s, lead("start") OVER (PARTITION BY video_id ORDER BY "start", fact_id) AS e FROM facts WHERE kind IN ('signup', 'purchase'))
SELECT b.video_id, from_id, s AS "start", e AS "end", (SELECT count(*) FROM facts f WHERE f.video_id = b.video_id AND f.modality = 'transcript' AND s <= f."start" AND f."end" <= e) AS notes FROM b WHERE e > s""")
def interaction_intervals(spark, sf) -> DataFrame:
    """Intervals between signups and purchases with the utterances that lie in each."""
    rows = facts(spark, sf)
    return C.interaction_intervals(rows.where("modality = 'events'"), rows.where("modality = 'transcript'"), ("signup", "purchase"))


@query("""SELECT c_mktsegment, n_name, CAST(grouping(c_mktsegment) + 2 * grouping(n_name) AS INT) AS level, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_name)""")
def order_cube(spark, sf) -> DataFrame:
    """Joins and all grouping sets of the relational tables, which Spark gives for nothing."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    level = (F.grouping("c_mktsegment") + 2 * F.grouping("n_name")).cast("int").alias("level")
    return rows.cube("c_mktsegment", "n_name").agg(level, F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))

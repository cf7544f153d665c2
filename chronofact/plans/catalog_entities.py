"""Queries of entities, the evidence graph, packaging, validation and tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.functions.text import NAME_STOPWORDS
from chronofact.operators import entities as E
from chronofact.operators import graph as G
from chronofact.operators import packaging as P
from chronofact.operators.tracking import text_tracks
from chronofact.operators.validation import validate
from chronofact.plans.catalog_facts import _TC
from chronofact.plans.catalog_temporal import DUR, durations
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


# The SQL engine knows word borders of ASCII letters only, so other letters become underscores there.
_NAMES = ", ".join(f"'{w}'" for w in NAME_STOPWORDS)
MENTIONS = rf"""c AS (SELECT DISTINCT video_id, modality, fact_id, "start", "end", unnest(list_concat(regexp_extract_all(text, '"([^"]{{3,80}})"', 1), regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+){{0,3}})\b', 1))) AS s0
  FROM facts WHERE modality IN ('ocr', 'transcript')),
mn AS (SELECT DISTINCT video_id, modality, fact_id, "start", "end", trim(s0) AS surface, lower(trim(regexp_replace(regexp_replace(trim(s0), '[^\p{{L}}\p{{N}}_\s$.:/-]', '', 'g'), '\s+', ' ', 'g'))) AS name FROM c
  WHERE length(trim(s0)) >= 3 AND len(list_filter(regexp_split_to_array(trim(s0), '\s+'), lambda w: w NOT IN ({_NAMES}))) > 0),
mentions AS (SELECT * FROM mn WHERE name <> '')"""
ENTITIES = """r AS (SELECT video_id, name, count(*) AS occurrences, min("start") AS first_seen, max("end") AS last_seen, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modalities FROM mentions GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT DISTINCT a.video_id, a.name FROM mentions a JOIN mentions b ON a.video_id = b.video_id AND a.name = b.name AND a.modality = 'ocr' AND b.modality = 'transcript' AND a."start" < b."end" + 1 AND b."start" < a."end" + 1),
entities AS (SELECT r.*, CASE WHEN k.name IS NOT NULL THEN 0.85::DOUBLE WHEN occurrences >= 3 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence, k.name IS NULL AS ambiguous FROM r LEFT JOIN k ON k.video_id = r.video_id AND k.name = r.name)"""


@query(f"""WITH {FACTS_SQL}, {MENTIONS}, {ENTITIES} SELECT * FROM entities""")
def entities(spark, sf) -> DataFrame:
    return E.concepts(facts(spark, sf)).drop("display")


@query(f"""WITH {FACTS_SQL}, {MENTIONS}, {ENTITIES} SELECT video_id, name, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, first_seen DESC, name) AS rank FROM entities) WHERE rank <= 20""")
def entities_top(spark, sf) -> DataFrame:
    return E.top_entities(E.concepts(facts(spark, sf)), 20).select("video_id", "name", "rank")


@query(f"""WITH {FACTS_SQL}, {MENTIONS} SELECT name, count(DISTINCT video_id) AS videos, count(*) AS occurrences, min("start") AS first_seen, max("end") AS last_seen FROM mentions GROUP BY name HAVING count(DISTINCT video_id) > 1""")
def entity_rollup(spark, sf) -> DataFrame:
    m = E.mentions(facts(spark, sf))
    return m.groupBy("name").agg(F.count_distinct("video_id").alias("videos"), F.count(F.lit(1)).alias("occurrences"), F.min("start").alias("first_seen"), F.max("end").alias("last_seen")).where("videos > 1")


@query(f"""WITH {FACTS_SQL}, {MENTIONS} SELECT video_id, name, arg_min(fact_id, ("start", fact_id)) AS first_id, arg_max(fact_id, ("start", fact_id)) AS last_id FROM mentions GROUP BY ALL""")
def entity_first_last(spark, sf) -> DataFrame:
    at = F.struct("start", "fact_id")
    return E.mentions(facts(spark, sf)).groupBy("video_id", "name").agg(F.min(at)["fact_id"].alias("first_id"), F.max(at)["fact_id"].alias("last_id"))


@query(f"""WITH {FACTS_SQL}, {MENTIONS} SELECT video_id FROM mentions WHERE name IN ('les', 'die') GROUP BY video_id HAVING count(DISTINCT name) = 2""")
def videos_with_all(spark, sf) -> DataFrame:
    return E.videos_with_all(E.mentions(facts(spark, sf)), ["Les", "Die"])


@query(f"""WITH {FACTS_SQL}, {MENTIONS}, {ENTITIES}, a AS (SELECT * FROM entities WHERE video_id = 'v0'), b AS (SELECT * FROM entities WHERE video_id = 'v1')
SELECT coalesce(a.name, b.name) AS name, a.occurrences AS na, b.occurrences AS nb, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.ambiguous OR b.ambiguous THEN 'uncertain'
  WHEN greatest(a.occurrences, b.occurrences) >= 2 * least(a.occurrences, b.occurrences) OR a.modalities <> b.modalities THEN 'changed' ELSE 'shared' END AS status FROM a FULL JOIN b ON a.name = b.name""")
def compare(spark, sf) -> DataFrame:
    e = E.concepts(facts(spark, sf).where(F.col("video_id").isin("v0", "v1")))
    return E.compare(e.where("video_id = 'v0'"), e.where("video_id = 'v1'"))


@query()
def similar_names(spark, sf) -> DataFrame:
    return E.similar_names(E.concepts(facts(spark, sf)), 0.75, shared=False).select("video_id", "a", "b", F.round("ratio", 6).alias("ratio"))


@query()
def alike_merged(spark, sf) -> DataFrame:
    """Concepts after names were merged that share a word, or are alike in nine of ten characters, at one moment."""
    return E.rolled_up(E.merged(E.mentions(facts(spark, sf)), 0.9)).drop("display")


EDGES = """ev AS (SELECT *, lead(fact_id) OVER w AS nx, lead("start") OVER w AS ns, lead("end") OVER w AS ne FROM facts WHERE modality = 'events' WINDOW w AS (PARTITION BY video_id ORDER BY "start", "end", fact_id)),
edges AS (SELECT video_id || '/' || fact_id AS src, video_id || '/' || nx AS dst, CASE WHEN "start" < ne - 1e-6 AND ns < "end" - 1e-6 THEN 'OVERLAPS' WHEN "end" <= ns + 1e-6 THEN 'PRECEDES' ELSE 'NEAR' END AS relation, 1.0::DOUBLE AS confidence FROM ev WHERE nx IS NOT NULL AND ns - "end" <= 60
  UNION ALL SELECT f.video_id || '/' || f.fact_id, e.video_id || '/' || e.fact_id, 'SUPPORTS', 0.9::DOUBLE FROM facts f JOIN facts e ON f.video_id = e.video_id AND f.modality IN ('ocr', 'transcript') AND e.modality = 'events' AND f."end" >= e."start" AND f."start" <= e."end")"""


def _edges(spark, sf) -> DataFrame:
    rows = facts(spark, sf)
    events = rows.where("modality = 'events'")
    return G.build_edges(G.chain_edges(events), G.support_edges(events, rows.where("modality IN ('ocr', 'transcript')")))


@query(f"""WITH {FACTS_SQL}, {EDGES} SELECT * FROM edges""")
def graph_edges(spark, sf) -> DataFrame:
    return _edges(spark, sf)


@query(f"""WITH {FACTS_SQL}, {EDGES} SELECT relation, count(*) AS n FROM edges GROUP BY relation""")
def graph_stats(spark, sf) -> DataFrame:
    return _edges(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FACTS_SQL}, {EDGES} SELECT dst AS id FROM edges WHERE src = 'v0/evt_3' UNION SELECT src FROM edges WHERE dst = 'v0/evt_3'""")
def graph_neighbors(spark, sf) -> DataFrame:
    return G.neighbors(_edges(spark, sf), "v0/evt_3")


@query(f"""WITH RECURSIVE {FACTS_SQL}, {EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
r AS (SELECT 'v0/evt_3' AS id, 0 AS hops UNION SELECT u.b, hops + 1 FROM r JOIN u ON u.a = r.id WHERE hops < 3) SELECT 'v0/evt_3' AS origin, id, min(hops) AS hops FROM r GROUP BY id""")
def graph_reachable(spark, sf) -> DataFrame:
    start = spark.createDataFrame([("v0/evt_3", "v0/evt_3")], "origin string, id string")
    return G.reachable(_edges(spark, sf), start, 3)


@query(f"""WITH RECURSIVE {FACTS_SQL}, {EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
r AS (SELECT 'v0/evt_3' AS id, 0 AS hops UNION SELECT u.b, hops + 1 FROM r JOIN u ON u.a = r.id WHERE hops < 4) SELECT 'v0/evt_3' AS src, 'v0/evt_20' AS dst, min(hops) AS hops FROM r WHERE id = 'v0/evt_20'""")
def graph_path(spark, sf) -> DataFrame:
    return G.shortest_hops(_edges(spark, sf), "v0/evt_3", "v0/evt_20")


@query(f"""WITH RECURSIVE {FACTS_SQL}, {EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
r AS (SELECT 'v0/evt_3' AS id, ['v0/evt_3'] AS path UNION SELECT u.b, list_append(path, u.b) FROM r JOIN u ON u.a = r.id WHERE len(path) < 5 AND NOT list_contains(path, u.b) AND r.id <> 'v0/evt_20'),
p AS (SELECT path FROM r WHERE id = 'v0/evt_20' ORDER BY len(path), path LIMIT 1) SELECT CAST(i AS INT) AS hop, path[i] AS a, path[i + 1] AS b FROM p, unnest(range(1, len(path))) t(i)""")
def graph_path_steps(spark, sf) -> DataFrame:
    """The steps of the shortest path between two facts."""
    return G.shortest_path(_edges(spark, sf), "v0/evt_3", "v0/evt_20")


@query(f"""WITH {FACTS_SQL}, {MENTIONS}, {ENTITIES} SELECT video_id || '/entity/' || name AS src, nx || '/entity/' || name AS dst FROM (SELECT video_id, name, lead(video_id) OVER (PARTITION BY name ORDER BY video_id) AS nx FROM entities) WHERE nx IS NOT NULL""")
def same_concept(spark, sf) -> DataFrame:
    return G.same_concept_edges(E.concepts(facts(spark, sf))).select("src", "dst")


SPANS = """spans AS (SELECT video_id, modality, fact_id AS span_id, "start", "end", text, round(1 / (1 + "start") + length(text) % 7, 6) AS score FROM facts)"""


def _spans(spark, sf) -> DataFrame:
    return facts(spark, sf).select("video_id", "modality", F.col("fact_id").alias("span_id"), "start", "end", "text", F.round(1 / (1 + F.col("start")) + F.length("text") % 7, 6).alias("score"))


@query(f"""WITH {FACTS_SQL}, {SPANS} SELECT span_id FROM spans l WHERE NOT EXISTS (SELECT 1 FROM spans r WHERE r.video_id = l.video_id AND r.modality = l.modality AND r."start" <= l."start" AND l."end" <= r."end"
  AND (r.score > l.score OR (r.score = l.score AND r.span_id < l.span_id)))""")
def evidence_contained(spark, sf) -> DataFrame:
    return P.drop_contained(_spans(spark, sf)).select("span_id")


@query(f"""WITH {FACTS_SQL}, {SPANS}, m AS (SELECT *, row_number() OVER (PARTITION BY video_id, modality ORDER BY score DESC, span_id) AS m FROM spans)
SELECT span_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY m > 1, score DESC, span_id) AS r FROM m) WHERE r <= 8""")
def evidence_anchors(spark, sf) -> DataFrame:
    return P.anchors_first(_spans(spark, sf), 8).select("span_id", "rank")


@query()
def budget_skip(spark, sf) -> DataFrame:
    return P.seconds_budget(P.anchors_first(_spans(spark, sf), 30), 60.0).select("span_id", "rank", "kept")


@query()
def frame_spacing(spark, sf) -> DataFrame:
    return P.spaced(_spans(spark, sf).where("modality = 'events'").select("video_id", F.col("start").alias("ts"), "score"), 5.0, ["video_id"])


@query(f"""WITH {FACTS_SQL}, {SPANS}, m AS (SELECT *, row_number() OVER (PARTITION BY video_id, modality ORDER BY score DESC, span_id) AS m FROM spans),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY m > 1, score DESC, span_id) AS r FROM m) WHERE r <= 8)
SELECT video_id, CAST(sum(length(text) // 4 + 50) AS BIGINT) AS tokens, count(*) AS spans FROM t GROUP BY video_id""")
def package_tokens(spark, sf) -> DataFrame:
    top = P.anchors_first(_spans(spark, sf), 8)
    packed = P.package_json(top)
    return packed.select("video_id", F.get_json_object("package", "$.tokens").cast("long").alias("tokens"), F.size(F.from_json("package", "evidence array<struct<rank:int>>")["evidence"]).cast("long").alias("spans"))


TOP = """m AS (SELECT *, row_number() OVER (PARTITION BY video_id, modality ORDER BY score DESC, span_id) AS m FROM spans),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY m > 1, score DESC, span_id) AS r FROM m), t AS (SELECT * FROM r WHERE r <= 8)"""
_LABELS = f"""l AS (SELECT *, (SELECT {_TC} FROM (SELECT CAST(round("start" * 1000) AS BIGINT) AS ms)) AS a, (SELECT {_TC} FROM (SELECT CAST(round("end" * 1000) AS BIGINT) AS ms)) AS b FROM t),
lines AS (SELECT *, CASE WHEN "end" <= "start" THEN a ELSE a || ' → ' || b END AS label FROM l)"""


@query(f"""WITH {FACTS_SQL}, {SPANS}, {TOP}, {_LABELS}, left_out AS (SELECT video_id, count(*) AS n FROM r WHERE r > 8 GROUP BY video_id)
SELECT video_id, 'QUERY: what happened' || chr(10) || 'INTENT: timeline' || chr(10) || string_agg('[' || r || '] ' || label || ' (' || modality || '): ' || substr(text, 1, 200), chr(10) ORDER BY r)
  || coalesce(chr(10) || '[omitted ' || any_value(n) || ' spans — see package]', '') AS package FROM lines LEFT JOIN left_out USING (video_id) GROUP BY video_id""")
def package_text(spark, sf) -> DataFrame:
    spans = _spans(spark, sf)
    top = P.anchors_first(spans, 8)
    omitted = spans.groupBy("video_id").agg((F.count(F.lit(1)) - 8).alias("n"))
    return P.package_text(top, "what happened", "timeline", omitted)


@query(f"""WITH {FACTS_SQL}, {SPANS}, {DUR}, {TOP}, {_LABELS}, w AS (SELECT video_id, greatest(0, "start" - 5) AS s, least("end" + 5, duration) AS e FROM t JOIN dur USING (video_id)),
f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1e-6 THEN 0 ELSE 1 END AS f FROM w),
i AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f),
u AS (SELECT video_id, CAST(round(round(min(s), 3) * 1000) AS BIGINT) AS a, CAST(round(round(max(e), 3) * 1000) AS BIGINT) AS b FROM i GROUP BY video_id, g),
ranges AS (SELECT video_id, string_agg((SELECT {_TC} FROM (SELECT a AS ms)) || ' → ' || (SELECT {_TC} FROM (SELECT b AS ms)), ', ' ORDER BY a) AS x FROM u GROUP BY video_id)
SELECT video_id, '# Context: what happened' || chr(10) || chr(10) || '**Intent:** `timeline`' || chr(10) || '**Ranges:** ' || any_value(x) || chr(10) || chr(10) || '## Evidence' || chr(10)
  || string_agg(r || '. **' || label || '** (' || modality || ') — ' || substr(text, 1, 300), chr(10) ORDER BY r) AS package FROM lines JOIN ranges USING (video_id) GROUP BY video_id""")
def package_markdown(spark, sf) -> DataFrame:
    top = P.anchors_first(_spans(spark, sf), 8)
    return P.package_markdown(top, "what happened", "timeline", P.relevant_ranges(top, durations(spark, sf)))


@query(f"""WITH {FACTS_SQL}, w AS (SELECT video_id, "start" - 5 AS s, "end" + 5 AS e FROM facts WHERE kind = 'error') SELECT DISTINCT f.fact_id FROM facts f JOIN w ON f.video_id = w.video_id AND f."end" >= s AND f."start" <= e
WHERE f.kind <> 'error'""")
def expansion(spark, sf) -> DataFrame:
    rows = facts(spark, sf)
    seen = rows.where("kind = 'error'")
    return P.expand(seen, rows, 5.0, seen).select("fact_id")


@query(f"""WITH {FACTS_SQL}, {DUR}, b AS (SELECT video_id, fact_id, "start", CASE WHEN fact_id LIKE '%7' THEN "start" - 1 ELSE "end" END AS "end", confidence * 1.5 AS confidence FROM facts), j AS (SELECT b.*, duration FROM b JOIN dur USING (video_id)),
x AS (SELECT * FROM facts WHERE modality = 'transcript')
SELECT video_id, fact_id, 'bounds' AS rule FROM j WHERE "start" < 0 OR "end" > duration + 0.5 UNION ALL SELECT video_id, fact_id, 'ordering' FROM j WHERE "end" < "start"
UNION ALL SELECT video_id, fact_id, 'confidence' FROM j WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT video_id, fact_id, 'overlap' FROM (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY "start", "end") AS before FROM x) WHERE "start" < before - 1e-6
UNION ALL SELECT 'v0', 'nowhere', 'dangling_ref'""")
def validation_findings(spark, sf) -> DataFrame:
    """Findings on facts with injected faults: reversed ends, confidences over 1, a reference to nothing."""
    good = facts(spark, sf)
    bad = good.withColumn("end", F.when(F.col("fact_id").endswith("7"), F.col("start") - 1).otherwise(F.col("end"))).withColumn("confidence", F.col("confidence") * 1.5)
    refs = spark.createDataFrame([("v0", "nowhere"), ("v0", "ocr_0")], "video_id string, ref string")
    return validate(bad, durations(spark, sf), refs, facts(spark, sf, "transcript")).select("video_id", "fact_id", "rule")


@query()
def ocr_dedup(spark, sf) -> DataFrame:
    """Tracks of lines over frames, a document being a frame of its recording: near copies become one interval."""
    recording = F.concat(F.lit("v"), F.floor(F.col("doc_id") / 20))
    lines = table(spark, sf, "documents").select(recording.alias("video_id"), F.col("doc_id").cast("double").alias("ts"), F.explode(F.split("text", "\n")).alias("text")).where(F.trim("text") != "")
    none = F.lit(None).cast("double")
    seen = lines.select("video_id", "ts", "text", F.lit(0.9).alias("confidence"), none.alias("x1"), none.alias("y1"), none.alias("x2"), none.alias("y2"))
    ends = seen.groupBy("video_id").agg((F.max("ts") + 1).alias("duration"))
    return text_tracks(seen, seen.select("video_id", "ts"), ends)

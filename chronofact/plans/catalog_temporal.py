"""Queries over intervals and time order, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators import temporal as T
from chronofact.operators.intervals import asof_backward, interval_join, merge_windows, relations, window_around
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


def durations(spark, sf) -> DataFrame:
    return facts(spark, sf).groupBy("video_id").agg(F.max("end").alias("duration"))


DUR = 'dur AS (SELECT video_id, max("end") AS duration FROM facts GROUP BY video_id)'
#: Scenes of a recording: its screen texts' starts cut it, the first scene beginning at 0.
SCENES = """scenes AS (SELECT video_id, "start", coalesce(lead("start") OVER (PARTITION BY video_id ORDER BY "start"), duration) AS "end"
  FROM (SELECT DISTINCT f.video_id, f."start", duration FROM facts f JOIN dur USING (video_id) WHERE modality = 'ocr'))"""


def scenes(spark, sf) -> DataFrame:
    cuts = facts(spark, sf, "ocr").select("video_id", "start").distinct().join(durations(spark, sf), "video_id")
    w = Window.partitionBy("video_id").orderBy("start")
    return cuts.select("video_id", "start", F.coalesce(F.lead("start").over(w), F.col("duration")).alias("end"))


_REL = """CASE WHEN ae <= bs + 1 THEN 'BEFORE' END, CASE WHEN a >= be - 1 THEN 'AFTER' END, CASE WHEN bs - 1 <= a AND ae <= be + 1 THEN 'DURING' END,
  CASE WHEN a - 1 <= bs AND be <= ae + 1 THEN 'CONTAINS' END, CASE WHEN a < be - 1e-6 AND bs < ae - 1e-6 THEN 'OVERLAPS' END,
  CASE WHEN ae <= bs + 1e-6 THEN 'PRECEDES' END, CASE WHEN a >= be - 1e-6 THEN 'FOLLOWS' END, CASE WHEN greatest(0, greatest(a, bs) - least(ae, be)) <= 5 THEN 'NEAR' END,
  CASE WHEN (a < be - 1e-6 AND bs < ae - 1e-6) OR greatest(0, greatest(a, bs) - least(ae, be)) <= 1 THEN 'CO_OCCURS' END,
  CASE WHEN bs - 1 <= a AND a <= be + 1 THEN 'STARTS_WITHIN' END, CASE WHEN bs - 1 <= ae AND ae <= be + 1 THEN 'ENDS_WITHIN' END"""


@query(f"""WITH {FACTS_SQL}, p AS (SELECT l.fact_id AS a_id, r.fact_id AS b_id, l."start" AS a, l."end" AS ae, r."start" AS bs, r."end" AS be
  FROM facts l JOIN facts r ON l.video_id = r.video_id AND l.modality = 'transcript' AND r.modality = 'ocr' AND l."start" < r."end" + 5 AND r."start" < l."end" + 5)
SELECT a_id, b_id, concat_ws(',', {_REL}) AS relations FROM p""")
def interval_relations(spark, sf) -> DataFrame:
    pairs = interval_join(facts(spark, sf, "transcript"), facts(spark, sf, "ocr"), ["video_id"], 30.0, 5.0)
    rel = relations(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    return pairs.select(F.col("l_fact_id").alias("a_id"), F.col("r_fact_id").alias("b_id"), F.array_join(rel, ",").alias("relations"))


@query(f"""WITH {FACTS_SQL} SELECT l.fact_id AS a_id, r.fact_id AS b_id FROM facts l JOIN facts r
  ON l.video_id = r.video_id AND l.modality = 'ocr' AND r.modality = 'events' AND l."end" >= r."start" AND l."start" <= r."end" """)
def interval_join_closed(spark, sf) -> DataFrame:
    pairs = interval_join(facts(spark, sf, "ocr"), facts(spark, sf, "events"), ["video_id"], 30.0, 0.0, "closed")
    return pairs.select(F.col("l_fact_id").alias("a_id"), F.col("r_fact_id").alias("b_id"))


@query(f"""WITH {FACTS_SQL} SELECT l.fact_id FROM facts l WHERE l.modality = 'transcript' AND EXISTS (SELECT 1 FROM facts r WHERE r.video_id = l.video_id AND r.modality = 'events'
  AND l."start" < r."end" + 1 AND r."start" < l."end" + 1)""")
def interval_semi_join(spark, sf) -> DataFrame:
    pairs = interval_join(facts(spark, sf, "transcript"), facts(spark, sf, "events"), ["video_id"], 30.0, 1.0)
    return pairs.select(F.col("l_fact_id").alias("fact_id")).distinct()


@query(f"""WITH {FACTS_SQL} SELECT l.fact_id FROM facts l WHERE l.modality = 'transcript' AND NOT EXISTS (SELECT 1 FROM facts r WHERE r.video_id = l.video_id AND r.modality = 'events'
  AND l."start" < r."end" + 1 AND r."start" < l."end" + 1)""")
def interval_anti_join(spark, sf) -> DataFrame:
    return facts(spark, sf, "transcript").select("fact_id").join(interval_semi_join(spark, sf), "fact_id", "left_anti")


@query("""SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY""")
def date_band_join(spark, sf) -> DataFrame:
    o, l = table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    band = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return o.join(l, (F.col("o_orderkey") == F.col("l_orderkey")) & band).select("o_orderkey", "l_linenumber")


@query(f"""WITH {FACTS_SQL}, p AS (SELECT video_id, "start" AS ps, "end" AS pe FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "start", fact_id) AS r FROM facts WHERE kind = 'error') WHERE r = 1),
g AS (SELECT f.video_id, f.fact_id, CASE WHEN f."start" >= pe - 1e-6 THEN 'after' ELSE 'before' END AS side,
    CASE WHEN f."start" >= pe - 1e-6 THEN f."start" - pe ELSE ps - f."end" END AS gap FROM facts f JOIN p USING (video_id)
  WHERE f.kind <> 'error' AND (f."start" >= pe - 1e-6 OR f."end" <= ps + 1e-6))
SELECT video_id, fact_id, side, round(gap, 6) AS gap, round(1 / (1 + gap), 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY video_id, side ORDER BY gap, fact_id) AS INT) AS rank FROM g WHERE gap <= 60) WHERE rank <= 5""")
def before_after(spark, sf) -> DataFrame:
    """Facts nearest before and after each recording's first error, five a side, within a minute."""
    all_ = facts(spark, sf)
    pivot = all_.where("kind = 'error'").groupBy("video_id").agg(F.min(F.struct("start", "fact_id", "end")).alias("p")).select(F.col("video_id").alias("v"), F.col("p.start").alias("ps"), F.col("p.end").alias("pe"))
    rows = all_.where("kind <> 'error'").join(pivot, F.col("video_id") == F.col("v"))
    after, before = F.col("start") >= F.col("pe") - 1e-6, F.col("end") <= F.col("ps") + 1e-6
    gap = F.when(after, F.col("start") - F.col("pe")).otherwise(F.col("ps") - F.col("end"))
    rows = rows.where(after | before).withColumns({"side": F.when(after, "after").otherwise("before"), "gap": gap}).where("gap <= 60")
    rank = F.row_number().over(Window.partitionBy("video_id", "side").orderBy("gap", "fact_id"))
    return rows.withColumn("rank", rank).where("rank <= 5").select("video_id", "fact_id", "side", F.round("gap", 6).alias("gap"), F.round(1 / (1 + F.col("gap")), 6).alias("score"), "rank")


@query(f"""WITH {FACTS_SQL}, p AS (SELECT video_id, min("start") FILTER (kind = 'signup') AS a, max("start") FILTER (kind = 'purchase') AS b FROM facts WHERE modality = 'events' GROUP BY video_id)
SELECT f.video_id, f.fact_id FROM facts f JOIN p USING (video_id) WHERE f."end" >= least(a, b) AND f."start" <= greatest(a, b)""")
def between_anchors(spark, sf) -> DataFrame:
    """Facts between each recording's first signup and last purchase, whichever comes first."""
    ends = facts(spark, sf, "events").groupBy(F.col("video_id").alias("v")).agg(F.min(F.when(F.col("kind") == "signup", F.col("start"))).alias("a"), F.max(F.when(F.col("kind") == "purchase", F.col("start"))).alias("b"))
    inside = (F.col("end") >= F.least("a", "b")) & (F.col("start") <= F.greatest("a", "b"))
    return facts(spark, sf).join(ends, F.col("video_id") == F.col("v")).where(inside).select("video_id", "fact_id")


@query(f"""WITH {FACTS_SQL} SELECT video_id, kind, arg_min(fact_id, ("start", fact_id)) AS first_id, min("start") AS first_start, arg_max(fact_id, ("start", fact_id)) AS last_id, max("start") AS last_start
FROM facts WHERE modality = 'events' GROUP BY ALL""")
def first_last(spark, sf) -> DataFrame:
    at = F.struct("start", "fact_id")
    return facts(spark, sf, "events").groupBy("video_id", "kind").agg(F.min(at).alias("a"), F.max(at).alias("b")).select("video_id", "kind", F.col("a.fact_id").alias("first_id"), F.col("a.start").alias("first_start"), F.col("b.fact_id").alias("last_id"), F.col("b.start").alias("last_start"))


@query(f"""WITH {FACTS_SQL}, e AS (SELECT video_id, fact_id, "start" FROM facts WHERE kind = 'error'), o AS (SELECT video_id, fact_id AS state_id, "start" FROM facts WHERE modality = 'ocr')
SELECT e.fact_id, o.state_id FROM e ASOF LEFT JOIN o ON e.video_id = o.video_id AND e."start" >= o."start" """)
def asof_state(spark, sf) -> DataFrame:
    """Each error with the screen text that began last before it."""
    rows = facts(spark, sf)
    errors = rows.where("kind = 'error'").select("video_id", "fact_id", "start")
    shown = rows.where("modality = 'ocr'").select("video_id", "start", "fact_id")
    return asof_backward(errors, shown, ["video_id"], "start", "start", ["fact_id"], ["fact_id"]).select("fact_id", F.col("r_fact_id").alias("state_id"))


@query(f"""WITH {FACTS_SQL}, {DUR}, u AS (SELECT video_id, fact_id, "start", "end", duration, lag("end") OVER w AS b, lead("start") OVER w AS a FROM facts JOIN dur USING (video_id)
    WHERE modality = 'transcript' WINDOW w AS (PARTITION BY video_id ORDER BY "start", "end", fact_id)),
g AS (SELECT video_id, 0.0::DOUBLE AS "start", least("start", duration) AS "end" FROM u WHERE b IS NULL UNION ALL SELECT video_id, least(b, duration), least("start", duration) FROM u WHERE b IS NOT NULL
  UNION ALL SELECT video_id, least("end", duration), duration FROM u WHERE a IS NULL)
SELECT video_id, "start", "end", round("end" - "start", 3) AS duration_s FROM g WHERE "end" - "start" >= 2""")
def silence_gaps(spark, sf) -> DataFrame:
    return T.silence_gaps(facts(spark, sf, "transcript"), durations(spark, sf))


@query()
def speech_spans(spark, sf) -> DataFrame:
    d = durations(spark, sf)
    return T.speech_spans(T.silence_gaps(facts(spark, sf, "transcript"), d), d)


@query(f"""WITH {FACTS_SQL}, e AS (SELECT *, CASE WHEN "start" - lag("end") OVER w <= 20 THEN 0 ELSE 1 END AS f FROM facts WHERE modality = 'events' WINDOW w AS (PARTITION BY video_id ORDER BY "start", "end", fact_id)),
c AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY "start", "end", fact_id) AS chain FROM e)
SELECT video_id, CAST(chain AS BIGINT) AS chain, min("start") AS "start", max("end") AS "end", count(*) AS events, string_agg(kind, '>' ORDER BY "start", "end", fact_id) AS sequence
FROM c GROUP BY video_id, chain HAVING count(*) >= 2""")
def event_chains(spark, sf) -> DataFrame:
    return T.event_chains(facts(spark, sf, "events"), 20.0).withColumn("chain", F.col("chain").cast("long"))


@query(f"""WITH {FACTS_SQL}, {DUR}, w AS (SELECT f.video_id, greatest(0, "start" - 5) AS s, least("end" + 5, duration) AS e FROM facts f JOIN dur USING (video_id) WHERE kind = 'error'),
m AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1e-6 THEN 0 ELSE 1 END AS f FROM w),
i AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT video_id, round(min(s), 3) AS "start", round(max(e), 3) AS "end" FROM i GROUP BY video_id, g""")
def window_merge(spark, sf) -> DataFrame:
    rows = facts(spark, sf, "events").where("kind = 'error'").join(durations(spark, sf), "video_id")
    lo, hi = window_around(F.col("start"), F.col("end"), 5.0, F.col("duration"))
    merged = merge_windows(rows.select("video_id", lo.alias("start"), hi.alias("end")), ["video_id"])
    return merged.select("video_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query()
def change_detection(spark, sf) -> DataFrame:
    """Changes between neighbouring scenes."""
    regions = scenes(spark, sf).withColumn("region", F.row_number().over(Window.partitionBy("video_id").orderBy("start", "end")) - 1)
    return T.change_points(regions, facts(spark, sf)).drop("region_end")


@query(f"""WITH {FACTS_SQL}, {DUR}, n AS (SELECT video_id, duration, CAST(greatest(1, least(12, round_even(duration / 300, 0))) AS INT) AS n FROM dur WHERE duration > 0)
SELECT video_id, CAST(i AS INT) AS chapter, round(i * duration / n, 3) AS "start", CASE WHEN i + 1 = n THEN duration ELSE round((i + 1) * duration / n, 3) END AS "end" FROM n, unnest(range(n)) t(i)""")
def chapters_tiling(spark, sf) -> DataFrame:
    return T.tile_chapters(durations(spark, sf))


@query()
def chapters_titled(spark, sf) -> DataFrame:
    return T.chapter_titles(T.cut_chapters(scenes(spark, sf), durations(spark, sf), 120.0), facts(spark, sf))


@query(f"""WITH {FACTS_SQL}, l AS (SELECT video_id, fact_id, "start", "end" FROM facts WHERE modality IN ('ocr', 'transcript') AND "end" > "start"),
p AS (SELECT DISTINCT video_id, unnest(["start", "end"]) AS p FROM l), b AS (SELECT video_id, p AS s, lead(p) OVER (PARTITION BY video_id ORDER BY p) AS e FROM p),
a AS (SELECT b.video_id, s, e, string_agg(fact_id, ',' ORDER BY fact_id) AS ids FROM b JOIN l ON l.video_id = b.video_id AND l."start" <= s + 1e-6 AND l."end" >= e - 1e-6 WHERE e - s > 1e-6 GROUP BY ALL),
r AS (SELECT *, CASE WHEN lag(ids) OVER w = ids AND abs(lag(e) OVER w - s) <= 1e-6 THEN 0 ELSE 1 END AS f FROM a WINDOW w AS (PARTITION BY video_id ORDER BY s)),
q AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY s) AS run FROM r), w AS (SELECT video_id, run, min(s) AS s, max(e) AS e, any_value(ids) AS ids FROM q GROUP BY ALL),
h AS (SELECT *, CASE WHEN e - s >= 2 OR row_number() OVER (PARTITION BY video_id ORDER BY run) = 1 THEN 1 ELSE 0 END AS h FROM w),
k AS (SELECT *, sum(h) OVER (PARTITION BY video_id ORDER BY run) AS state FROM h)
SELECT video_id, CAST(state AS BIGINT) AS state, min(s) AS "start", max(e) AS "end", string_agg(ids, ',' ORDER BY run) AS evidence_ids FROM k GROUP BY video_id, state""")
def ui_states(spark, sf) -> DataFrame:
    rows = facts(spark, sf, "ocr", "transcript").where(F.col("end") > F.col("start"))
    return T.states(rows).withColumn("state", F.col("state").cast("long"))


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, c AS (SELECT video_id, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE "start" END AS s, coalesce(lead("start") OVER w, "end") AS e FROM scenes WINDOW w AS (PARTITION BY video_id ORDER BY "start", "end")),
k AS (SELECT video_id, s, e, CAST(greatest(1, ceil((e - s) / 45)) AS INT) AS n FROM c WHERE e > s),
g AS (SELECT video_id, s + i * ((e - s) / n) AS a, CASE WHEN i + 1 = n THEN e ELSE s + (i + 1) * ((e - s) / n) END AS b FROM k, unnest(range(n)) t(i)),
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a) - 1 AS segment, max(b) OVER (PARTITION BY video_id) AS last FROM g)
SELECT z.video_id, CAST(segment AS BIGINT) AS segment, f.fact_id FROM z JOIN facts f ON f.video_id = z.video_id AND
  CASE WHEN f."end" > f."start" THEN f."start" < b AND a < f."end" ELSE a <= f."start" AND (f."start" < b OR (f."start" = b AND b = last)) END""")
def segments_membership(spark, sf) -> DataFrame:
    members = T.segment_members(T.plan_segments(scenes(spark, sf)), facts(spark, sf))
    return members.select("video_id", F.col("segment").cast("long").alias("segment"), "fact_id")


@query()
def segment_text(spark, sf) -> DataFrame:
    return T.segment_text(T.segment_members(T.merge_short(T.plan_segments(scenes(spark, sf))), facts(spark, sf)))


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}
SELECT video_id, 'scene_changed' AS type, "start", "start" AS "end", NULL AS ref FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "start", "end") AS i FROM scenes) WHERE i > 1
UNION ALL SELECT video_id, 'text_appeared', "start", "start", fact_id FROM facts WHERE modality = 'ocr' UNION ALL SELECT video_id, 'text_disappeared', "end", "end", fact_id FROM facts WHERE modality = 'ocr'
UNION ALL SELECT video_id, 'command_entered', "start", "start", fact_id FROM facts WHERE modality = 'ocr' AND list_bool_or(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[$>%]\\s+\\S')))
UNION ALL SELECT video_id, 'error_shown', "start", "end", fact_id FROM facts WHERE modality = 'ocr' AND regexp_matches(text, '\\bTraceback\\b|\\b[45]\\d{{2}}\\s+[A-Z][a-z]+|\\b\\w*(?:Error|Exception)\\b|\\b(?:FAILED|FAIL|ERROR|Failed)\\b')""")
def rule_events(spark, sf) -> DataFrame:
    return T.rule_events(facts(spark, sf, "ocr"), scenes(spark, sf)).drop("detail")


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, w AS (SELECT video_id, "start" AS s, least("start" + 1.2, "end") AS e, 4.0 AS fps, 'boundary_burst' AS reason FROM scenes
  UNION ALL SELECT video_id, least("start" + 1.2, "end"), "end", CASE WHEN "end" - "start" > 8 THEN 0.2 ELSE 1.0 END, 'scene' FROM scenes)
SELECT video_id, s AS "start", e AS "end", round(CASE WHEN t > 60 THEN greatest(0.05, fps * 60 / t) ELSE fps END, 6) AS fps, reason FROM (SELECT *, sum((e - s) * fps) OVER (PARTITION BY video_id) AS t FROM w WHERE e > s)""")
def sampling_plan(spark, sf) -> DataFrame:
    return T.fit_budget(T.adaptive_plan(scenes(spark, sf)), 60).withColumn("fps", F.round("fps", 6))


@query(f"""WITH {FACTS_SQL}, w AS (SELECT video_id, "start" AS s, "end" + 10 AS e, CAST(CASE WHEN modality = 'ocr' THEN 2 ELSE 1 END AS DOUBLE) AS fps, modality AS reason FROM facts WHERE modality IN ('ocr', 'transcript')),
p AS (SELECT DISTINCT video_id, unnest([s, e]) AS p FROM w), b AS (SELECT video_id, p AS s, lead(p) OVER (PARTITION BY video_id ORDER BY p) AS e FROM p),
m AS (SELECT b.video_id, b.s, b.e, max((w.fps, w.reason)) AS m FROM b JOIN w ON w.video_id = b.video_id AND w.s < b.e AND b.s < w.e WHERE b.e IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CASE WHEN lag(m) OVER v = m AND lag(e) OVER v = s THEN 0 ELSE 1 END AS f FROM m WINDOW v AS (PARTITION BY video_id ORDER BY s)), q AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY s) AS run FROM r)
SELECT video_id, min(s) AS "start", max(e) AS "end", any_value(m[1]) AS fps, any_value(m[2]) AS reason FROM q GROUP BY video_id, run""")
def rate_flatten(spark, sf) -> DataFrame:
    rows = facts(spark, sf, "ocr", "transcript").select("video_id", "start", (F.col("end") + 10).alias("end"), F.when(F.col("modality") == "ocr", 2.0).otherwise(1.0).alias("fps"), F.col("modality").alias("reason"))
    return T.flatten_rates(rows)


@query()
def text_boundaries(spark, sf) -> DataFrame:
    return T.text_boundaries(scenes(spark, sf), facts(spark, sf, "ocr"), min_scene=0.0)


@query()
def frame_runs(spark, sf) -> DataFrame:
    frames = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.floor(F.col("vec_id") / 100)).alias("video_id"), F.col("vec_id").alias("ts"), F.transform("embedding", lambda x: x.cast("double")).alias("signature"))
    return T.frame_runs(frames, 0.5).select("video_id", "ts", "run")

"""Queries of merged entities, boundaries, segments, screens, context and the whole evidence graph, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.scalars import LANGUAGE_TAGS, language_tag, layout_signature
from chronofact.functions.text import STOPWORDS
from chronofact.operators import boundaries as B
from chronofact.operators import context as C
from chronofact.operators import entities as E
from chronofact.operators import graph as G
from chronofact.operators import retrieval as R
from chronofact.operators import temporal as T
from chronofact.plans import catalog_temporal as CT
from chronofact.plans.catalog_entities import ENTITIES, MENTIONS, SPANS
from chronofact.plans.catalog_retrieval import PHRASE, _rank_sql
from chronofact.plans.catalog_temporal import DUR, SCENES, durations, scenes
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


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_BARE = r"""list_transform(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g')), lambda w: length(w) >= 3), lambda w: lower(w))"""
CONTENT = rf"list_distinct(list_filter({_BARE}, lambda w: NOT list_contains([{_STOP}], w) AND NOT regexp_matches(w, '^\d+$')))"

CHANGES = f"""rg AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "start", "end") - 1 AS region FROM scenes),
fx AS (SELECT r.video_id, r.region, coalesce(flatten(list({CONTENT}) FILTER (modality = 'ocr')), []) AS words, bool_or(modality = 'transcript') AS speech
  FROM rg r JOIN facts f ON f.video_id = r.video_id AND f.modality IN ('ocr', 'transcript') AND r."start" < f."end" - 1e-6 AND f."start" < r."end" - 1e-6 GROUP BY ALL),
rw AS (SELECT r.video_id, r.region, r."start", r."end", coalesce(words, []) AS words, coalesce(speech, false) AS speech FROM rg r LEFT JOIN fx USING (video_id, region)),
lg AS (SELECT *, lag(words) OVER w AS pw, lag(speech) OVER w AS ps FROM rw WINDOW w AS (PARTITION BY video_id ORDER BY region)),
changes AS (SELECT video_id, "start" AS ts, "end" AS region_end, CASE WHEN len(words) > 0 AND len(pw) > 0 AND NOT list_has_any(words, pw) THEN 'text_changed' WHEN speech AND NOT ps THEN 'speech_started'
  WHEN NOT speech AND ps THEN 'speech_ended' ELSE 'scene_transition' END AS change_type FROM lg WHERE ps IS NOT NULL)"""
CHAPTERS = """c0 AS (SELECT video_id, list_reduce(list("start" ORDER BY "start"), lambda c, x: CASE WHEN x - c[-1] >= 120 AND len(c) < 12 THEN list_append(c, x) ELSE c END, [0.0::DOUBLE]) AS c FROM scenes GROUP BY video_id),
c1 AS (SELECT video_id, list_reduce(c[2:], lambda k, x: CASE WHEN x - k[-1] < 60 THEN k ELSE list_append(k, x) END, [0.0::DOUBLE]) AS k FROM c0),
c2 AS (SELECT video_id, duration, i - 1 AS chapter, k[i] AS "start", coalesce(k[i + 1], duration) AS "end" FROM c1 JOIN dur USING (video_id), unnest(range(1, len(k) + 1)) t(i)),
chapters AS (SELECT video_id, chapter, "start", "end" FROM c2 WHERE "end" - "start" > 1e-6)"""
STATES = CT.SQL["ui_states"].split(f"WITH {FACTS_SQL}, ", 1)[1].rsplit("\nSELECT", 1)[0].replace("\np AS", "\nsp AS").replace(" FROM p)", " FROM sp)").replace("h AS (SELECT", "hh AS (SELECT").replace("FROM h)", "FROM hh)") + """,
states AS (SELECT video_id, CAST(state AS BIGINT) AS state, min(s) AS "start", max(e) AS "end", string_agg(ids, ',' ORDER BY run) AS evidence_ids FROM k GROUP BY video_id, state)"""
RULES = CT.SQL["rule_events"].split(f"{SCENES}\n", 1)[1]


def regions(spark, sf) -> DataFrame:
    return scenes(spark, sf).withColumn("region", F.row_number().over(Window.partitionBy("video_id").orderBy("start", "end")) - 1)


def changes(spark, sf) -> DataFrame:
    return T.change_points(regions(spark, sf), facts(spark, sf))


def chapters(spark, sf) -> DataFrame:
    return T.cut_chapters(scenes(spark, sf), durations(spark, sf), 120.0)


# SQL for queries of the time catalogue that are folds.
CT.SQL["change_detection"] = f"WITH {FACTS_SQL}, {DUR}, {SCENES}, {CHANGES} SELECT video_id, ts, change_type FROM changes"
CT.SQL["chapters_titled"] = rf"""WITH {FACTS_SQL}, {DUR}, {SCENES}, {CHAPTERS}, tm AS (SELECT c.video_id, c.chapter, unnest(list_filter({_BARE}, lambda w: NOT list_contains([{_STOP}], w) AND regexp_matches(w, '\p{{L}}'))) AS term
  FROM chapters c JOIN facts f ON f.video_id = c.video_id AND f.modality IN ('ocr', 'transcript') AND c."start" < f."end" - 1e-6 AND f."start" < c."end" - 1e-6),
tc AS (SELECT video_id, chapter, term, count(*) AS n FROM tm GROUP BY ALL), tn AS (SELECT *, row_number() OVER (PARTITION BY video_id, chapter ORDER BY n DESC, term) AS r FROM tc),
tt AS (SELECT video_id, chapter, string_agg(upper(substr(term, 1, 1)) || substr(term, 2), ' · ' ORDER BY r) AS title FROM tn WHERE r <= 3 GROUP BY ALL)
SELECT c.video_id, CAST(chapter AS INT) AS chapter, "start", "end", coalesce(title, 'Part ' || (chapter + 1)) AS title FROM chapters c LEFT JOIN tt USING (video_id, chapter)"""
CT.SQL["speech_spans"] = CT.SQL["silence_gaps"].rsplit("\nSELECT", 1)[0] + """,
m AS (SELECT video_id, "start", "end" FROM g WHERE "end" - "start" >= 2 UNION ALL SELECT video_id, duration, duration FROM dur),
p AS (SELECT video_id, coalesce(max("end") OVER (PARTITION BY video_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS "start", "start" AS "end" FROM m)
SELECT * FROM p WHERE "end" - "start" >= 0.3"""
CT.SQL["segment_text"] = CT.SQL["segments_membership"].split("\nz AS", 1)[0].rstrip(",") + r""",
ms AS (SELECT video_id, list_reduce(l[2:], lambda k, x: CASE WHEN x.e - x.s < 4 OR k[-1].e - k[-1].s < 4 THEN list_append(k[:-2], {'s': k[-1].s, 'e': x.e}) ELSE list_append(k, x) END, l[1:1]) AS l
  FROM (SELECT video_id, list({'s': a, 'e': b} ORDER BY a, b) AS l FROM g GROUP BY video_id)),
z AS (SELECT video_id, i - 1 AS segment, l[i].s AS a, l[i].e AS b, l[-1].e AS last FROM ms, unnest(range(1, len(l) + 1)) t(i)),
x AS (SELECT z.video_id, segment, list(trim(regexp_replace(f.text, '\s+', ' ', 'g')) ORDER BY f."start", f."end", f.fact_id) AS lines FROM z JOIN facts f ON f.video_id = z.video_id AND
  CASE WHEN f."end" > f."start" THEN f."start" < b AND a < f."end" ELSE a <= f."start" AND (f."start" < b OR (f."start" = b AND b = last)) END GROUP BY ALL)
SELECT video_id, CAST(segment AS INT) AS segment, array_to_string(list_reduce(list_filter(lines, lambda x: x <> ''), lambda k, x: CASE WHEN list_contains(list_transform(k, lambda y: lower(y)), lower(x)) THEN k ELSE list_append(k, x) END, []::VARCHAR[]), chr(10)) AS text FROM x"""
CT.SQL["text_boundaries"] = f"""WITH {FACTS_SQL}, o AS (SELECT video_id, "start", "end", {CONTENT} AS words FROM facts WHERE modality = 'ocr'), st AS (SELECT DISTINCT video_id, "start" AS t FROM o),
w AS (SELECT st.video_id, t, coalesce(list_distinct(flatten(list(words) FILTER (o."start" <= t - 0.25 AND o."end" >= t - 0.25 AND t - 0.25 < greatest(o."end", o."start" + 1e-3)))), []) AS a,
  coalesce(list_distinct(flatten(list(words) FILTER (o."start" <= t + 0.25 AND o."end" >= t + 0.25 AND t + 0.25 < greatest(o."end", o."start" + 1e-3)))), []) AS b
  FROM st JOIN o ON o.video_id = st.video_id AND ((o."start" <= t - 0.25 AND o."end" >= t - 0.25 AND t - 0.25 < greatest(o."end", o."start" + 1e-3)) OR (o."start" <= t + 0.25 AND o."end" >= t + 0.25 AND t + 0.25 < greatest(o."end", o."start" + 1e-3))) GROUP BY ALL),
j AS (SELECT video_id, t, len(list_distinct(list_concat(a, b))) AS u, len(list_intersect(a, b)) AS i FROM w)
SELECT video_id, t AS ts, round(1 - CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / u END, 6) AS score FROM j WHERE CASE WHEN u = 0 THEN 1.0 ELSE i::DOUBLE / u END <= 0.35"""
CT.SQL["frame_runs"] = """WITH f AS (SELECT 'v' || (vec_id // 100) AS video_id, vec_id AS ts, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY ts) AS p FROM f),
d AS (SELECT *, CASE WHEN p IS NULL OR list_max(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - p[i]))) > 0.5 THEN 1 ELSE 0 END AS f FROM l)
SELECT video_id, ts, CAST(sum(f) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM d"""

_TOP30 = f"""WITH {FACTS_SQL}, {SPANS}, m AS (SELECT *, row_number() OVER (PARTITION BY video_id, modality ORDER BY score DESC, span_id) AS m FROM spans),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY m > 1, score DESC, span_id) AS r FROM m) WHERE r <= 30)"""
FOLDS = {
    "budget_skip": f"""{_TOP30}, f AS (SELECT video_id, list_reduce(list({{'used': "end" - "start", 'kept': [span_id]}} ORDER BY r), lambda a, x: CASE WHEN len(a.kept) = 0 OR a.used + x.used <= 60 THEN {{'used': a.used + x.used, 'kept': list_concat(a.kept, x.kept)}} ELSE a END,
  {{'used': 0.0::DOUBLE, 'kept': []::VARCHAR[]}}) AS f FROM t GROUP BY video_id) SELECT span_id, CAST(r AS INT) AS rank, list_contains(f.kept, span_id) AS kept FROM t JOIN f USING (video_id)""",
    "frame_spacing": f"""WITH {FACTS_SQL}, {SPANS}, f AS (SELECT video_id, list_reduce(list("start" ORDER BY -score, "start"), lambda k, x: CASE WHEN len(list_filter(k, lambda y: abs(y - x) < 5)) > 0 THEN k ELSE list_append(k, x) END, []::DOUBLE[]) AS k
  FROM spans WHERE modality = 'events' GROUP BY video_id) SELECT video_id, unnest(k) AS ts FROM f""",
}

GROUPS = """wd AS (SELECT DISTINCT video_id, name, "start", "end", unnest(list_filter(string_split(name, ' '), lambda w: length(w) >= 4)) AS word FROM mentions),
pr AS (SELECT DISTINCT a.video_id, a.name AS a, b.name AS b FROM wd a JOIN wd b ON a.video_id = b.video_id AND a.word = b.word AND a.name <> b.name AND a."start" < b."end" + 1 AND b."start" < a."end" + 1),
rc AS (SELECT video_id, a AS name, a AS root FROM pr UNION SELECT pr.video_id, pr.b, rc.root FROM rc JOIN pr ON pr.video_id = rc.video_id AND pr.a = rc.name WHERE rc.root < pr.b),
gr AS (SELECT video_id, name, min(root) AS least FROM (SELECT * FROM rc UNION ALL SELECT video_id, b, b FROM pr) GROUP BY ALL),
mm AS (SELECT m.* REPLACE (coalesce(gr.least, m.name) AS name) FROM mentions m LEFT JOIN gr ON gr.video_id = m.video_id AND gr.name = m.name)"""
MERGED = ENTITIES.replace("FROM mentions", "FROM mm").replace("JOIN mentions", "JOIN mm")


@query(f"""WITH RECURSIVE {FACTS_SQL}, {MENTIONS}, {GROUPS}, {MERGED} SELECT * FROM entities""")
def entities_merged(spark, sf) -> DataFrame:
    """Concepts after names that share a word and a moment were merged."""
    return E.rolled_up(E.merged(E.mentions(facts(spark, sf)))).drop("display")


_COMMAND = r"regexp_extract(trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[$>%]\s+\S') AND NOT regexp_matches(regexp_extract(trim(x), '^[$>%]\s+(\S.*)$', 1), '^\S*:(\s|$)'))[1]), '^[$>%]\s+(\S.*)$', 1)"
_ERROR = r"CASE WHEN regexp_matches(text, '\bTraceback\b') THEN 'traceback' WHEN regexp_matches(text, '\b[45]\d{2}\s+[A-Z][a-z]+') THEN 'http_status' WHEN regexp_matches(text, '\b\w*(?:Error|Exception)\b') THEN 'exception' WHEN regexp_matches(text, '\b(?:FAILED|FAIL|ERROR|Failed)\b') THEN 'failure' END"


@query(f"""WITH RECURSIVE {FACTS_SQL}, {MENTIONS}, {GROUPS}, {MERGED}, o AS (SELECT *, {_COMMAND} AS command, {_ERROR} AS error FROM facts WHERE modality = 'ocr'),
t AS (SELECT video_id, 'ERROR' AS type, error AS name, 1 AS occurrences, "start" AS first_seen, "end" AS last_seen, 0.7::DOUBLE AS confidence, false AS ambiguous FROM o WHERE error IS NOT NULL
  UNION ALL SELECT video_id, 'COMMAND', substr(command, 1, 80), 1, "start", "start", 0.85::DOUBLE, false FROM o WHERE command <> ''
  UNION ALL SELECT video_id, 'CONCEPT', name, occurrences, first_seen, last_seen, confidence, ambiguous FROM entities)
SELECT video_id, type, name, CAST(occurrences AS BIGINT) AS occurrences, first_seen, last_seen, confidence, ambiguous FROM t""")
def entities_typed(spark, sf) -> DataFrame:
    """Errors shown, commands entered and merged concepts."""
    return E.typed_entities(facts(spark, sf), T.rule_events(facts(spark, sf, "ocr"), scenes(spark, sf)))


_CUTS = """ct AS (SELECT DISTINCT video_id, "start" AS ts, CASE WHEN modality = 'ocr' THEN confidence ELSE 0.95::DOUBLE END AS score, modality AS signal FROM facts WHERE modality = 'ocr' OR kind IN ('error', 'signup')),
bd AS (SELECT *, greatest(1, CAST(round_even(duration / 60.0 * 4, 0) AS INT)) - sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS room, row_number() OVER (PARTITION BY video_id ORDER BY score >= 0.5, score DESC, ts, signal) AS place FROM ct JOIN dur USING (video_id)),
bl AS (SELECT video_id, duration, list({'ts': ts, 'score': score, 'signals': [signal]} ORDER BY ts, score, signal) AS c FROM bd WHERE score >= 0.5 OR place <= room GROUP BY ALL),
bj AS (SELECT video_id, duration, list_reduce(c[2:], lambda k, x: CASE WHEN x.ts - k[-1].ts <= 0.05 THEN list_append(k[:-2], {'ts': k[-1].ts, 'score': greatest(k[-1].score, x.score), 'signals': list_concat(k[-1].signals, list_filter(x.signals, lambda s: NOT list_contains(k[-1].signals, s)))}) ELSE list_append(k, x) END, c[1:1]) AS c FROM bl),
bf AS (SELECT video_id, duration, list_filter(c, lambda x: x.ts > 0 AND x.ts < duration) AS c FROM bj),
bk AS (SELECT video_id, duration, list_reduce(c[2:], lambda k, x: CASE WHEN x.ts - k[-1].ts >= 1.5 THEN list_append(k, x)
  WHEN k[-1].score >= 0.9 AND x.score >= 0.9 THEN list_append(k[:-2], {'ts': x.ts, 'score': x.score, 'signals': list_concat(list_concat(x.signals, list_filter(k[-1].signals, lambda s: NOT list_contains(x.signals, s))), CASE WHEN list_contains(x.signals, 'flash') OR list_contains(k[-1].signals, 'flash') THEN [] ELSE ['flash'] END)})
  WHEN len(x.signals) > len(k[-1].signals) OR (len(x.signals) = len(k[-1].signals) AND x.score > k[-1].score) THEN list_append(k[:-2], x) ELSE k END, c[1:1]) AS c FROM bf),
bs AS (SELECT video_id, duration, list_concat([{'ts': 0.0::DOUBLE, 'score': NULL::DOUBLE, 'signals': ['start']}], c) AS c FROM bk),
bp AS (SELECT video_id, c[i].ts AS s, coalesce(c[i + 1].ts, duration) AS e, c[i].score AS score, array_to_string(c[i].signals, '+') AS signals FROM bs, unnest(range(1, len(c) + 1)) t(i))"""


@query(f"""WITH {FACTS_SQL}, {DUR}, {_CUTS} SELECT video_id, round(s, 3) AS "start", round(e, 3) AS "end", score, signals, round(s + least(0.5, (e - s) / 2), 3) AS keyframe FROM bp WHERE e - s > 1e-3""")
def scene_boundaries(spark, sf) -> DataFrame:
    """Scenes from two kinds of cuts, screen texts and marked events, under a density budget and a least length."""
    score = F.when(F.col("modality") == "ocr", F.col("confidence")).otherwise(0.95)
    cuts = facts(spark, sf).where("modality = 'ocr' OR kind IN ('error', 'signup')").select("video_id", F.col("start").alias("ts"), score.alias("score"), F.col("modality").alias("signal")).distinct()
    return B.boundary_spans(B.arbitrated(B.budgeted(cuts, durations(spark, sf))))


@query(f"""WITH {FACTS_SQL}, w AS (SELECT video_id, "start" AS s, "end" + 4 AS e, CAST(CASE WHEN modality = 'ocr' THEN 2 ELSE 1 END AS DOUBLE) AS fps, kind AS reason FROM facts WHERE modality IN ('ocr', 'transcript')),
b AS (SELECT *, CASE WHEN abs(fps - lag(fps) OVER v) < 1e-9 THEN 0 ELSE 1 END AS f FROM w WINDOW v AS (PARTITION BY video_id ORDER BY s, e, fps, reason)),
k AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY s, e, fps, reason ROWS UNBOUNDED PRECEDING) AS block FROM b),
i AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY video_id, block ORDER BY s, e, reason ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS g FROM k),
n AS (SELECT *, sum(g) OVER (PARTITION BY video_id, block ORDER BY s, e, reason ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT video_id, min(s) AS "start", max(e) AS "end", any_value(fps) AS fps, CASE WHEN min(reason) = max(reason) THEN min(reason) ELSE 'mixed' END AS reason FROM n GROUP BY video_id, block, island""")
def rate_windows(spark, sf) -> DataFrame:
    rows = facts(spark, sf, "ocr", "transcript").select("video_id", "start", (F.col("end") + 4).alias("end"), F.when(F.col("modality") == "ocr", 2.0).otherwise(1.0).alias("fps"), F.col("kind").alias("reason"))
    return B.same_rate_windows(rows)


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, c AS (SELECT video_id, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE "start" END AS s, coalesce(lead("start") OVER w, "end") AS e FROM scenes WINDOW w AS (PARTITION BY video_id ORDER BY "start", "end")),
u AS (SELECT video_id, lag("end") OVER (PARTITION BY video_id ORDER BY "start", "end", fact_id) AS a, "start" AS b FROM facts WHERE modality = 'transcript'), gp AS (SELECT video_id, (a + b) / 2 AS g FROM u WHERE b > a),
k AS (SELECT video_id, s, e, CAST(greatest(1, ceil((e - s) / 8)) AS INT) AS n FROM c WHERE e > s), q AS (SELECT video_id, s, e, s + i * ((e - s) / n) AS c FROM k, unnest(range(1, n)) t(i)),
z AS (SELECT q.video_id, s, e, c, arg_min(g, (abs(g - c), g)) AS g FROM q LEFT JOIN gp ON gp.video_id = q.video_id GROUP BY ALL), y AS (SELECT video_id, s, e, CASE WHEN abs(g - c) <= 3 THEN g ELSE c END AS x FROM z),
p AS (SELECT video_id, s, e, s AS x FROM k UNION ALL SELECT video_id, s, e, x FROM y WHERE x > s AND x < e), r AS (SELECT video_id, x AS "start", coalesce(lead(x) OVER (PARTITION BY video_id, s, e ORDER BY x), e) AS "end" FROM p)
SELECT * FROM r WHERE "end" - "start" > 1e-6""")
def segments_snapped(spark, sf) -> DataFrame:
    """Segments of eight seconds at most, cut in silences where one is near."""
    return B.snapped_segments(scenes(spark, sf), facts(spark, sf, "transcript"), 8.0)


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, {CHANGES}, {STATES}, x AS (SELECT video_id, "start" AS ts, 'state' AS kind, array_to_string(string_split(evidence_ids, ',')[1:2], ' + ') AS label FROM states UNION ALL SELECT video_id, ts, 'change', change_type FROM changes)
SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ts, kind, label) AS INT) AS place FROM x""")
def screen_timeline(spark, sf) -> DataFrame:
    return T.screen_timeline(T.states(facts(spark, sf, "ocr", "transcript").where(F.col("end") > F.col("start"))), changes(spark, sf))


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, {CHANGES}, {STATES}, {CHAPTERS}, x AS (SELECT video_id, 'chapters' AS o FROM chapters UNION ALL SELECT video_id, 'changes' FROM changes UNION ALL SELECT video_id, 'states' FROM states)
SELECT video_id, count(*) FILTER (o = 'chapters') AS chapters, count(*) FILTER (o = 'changes') AS changes, count(*) FILTER (o = 'states') AS states FROM x GROUP BY video_id""")
def structure_counts(spark, sf) -> DataFrame:
    return T.structure(chapters(spark, sf), changes(spark, sf), T.states(facts(spark, sf, "ocr", "transcript").where(F.col("end") > F.col("start"))))


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, w AS (SELECT video_id, "start" AS s, least("start" + 1.2, "end") AS e, 4.0 AS fps FROM scenes UNION ALL SELECT video_id, least("start" + 1.2, "end"), "end", CASE WHEN "end" - "start" > 8 THEN 0.2 ELSE 1.0 END FROM scenes),
p AS (SELECT video_id, sum(ceil((e - s) * fps)) AS p FROM w WHERE e > s GROUP BY video_id), n AS (SELECT video_id, count(DISTINCT "start") AS n FROM facts WHERE modality = 'events' GROUP BY video_id),
t AS (SELECT video_id, duration, CAST(count(*) AS DOUBLE) / 7.0 AS seconds FROM facts JOIN dur USING (video_id) GROUP BY ALL), r AS (SELECT *, seconds / duration AS raw FROM t)
SELECT video_id, CASE WHEN duration > 0 THEN round(raw * power(10.0, 3 - floor(log10(raw)))) / power(10.0, 3 - floor(log10(raw))) END AS realtime_factor, coalesce(n, 0) AS frames_sampled, CAST(greatest(0, coalesce(p, 0) - coalesce(n, 0)) AS BIGINT) AS frames_skipped
FROM r LEFT JOIN p USING (video_id) LEFT JOIN n USING (video_id)""")
def run_metrics(spark, sf) -> DataFrame:
    """Metrics of each recording's run, a seventh of a second's work for a fact, its events being the frames taken."""
    times = facts(spark, sf).groupBy("video_id").agg(F.max("end").alias("duration"), (F.count(F.lit(1)).cast("double") / 7.0).alias("seconds"))
    return T.run_metrics(facts(spark, sf, "events").select("video_id", F.col("start").alias("ts")), T.adaptive_plan(scenes(spark, sf)), times)


_TAGS = ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGE_TAGS.items())


@query(rf"""WITH m AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN [lang, 'osd'] WHEN 1 THEN ['chi_sim_vert'] WHEN 2 THEN ['deu_frak', ' EQU '] WHEN 3 THEN ['eng', 'hin'] ELSE ['fra'] END AS codes FROM documents),
u AS (SELECT doc_id, list_filter(list_transform(codes, lambda c: lower(trim(c))), lambda c: c <> '' AND c NOT IN ('osd', 'equ')) AS u FROM m), c AS (SELECT doc_id, len(u) AS n, regexp_replace(regexp_replace(u[1], '_vert$', ''), '_frak$', '') AS c FROM u)
SELECT doc_id, CASE WHEN n = 1 THEN coalesce(MAP {{{_TAGS}}}[c], c) END AS tag FROM c""")
def language_tags(spark, sf) -> DataFrame:
    """Tags of each document's recogniser models."""
    a = lambda *x: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    n = F.col("doc_id") % 5
    codes = F.when(n == 0, a(F.col("lang"), "osd")).when(n == 1, a("chi_sim_vert")).when(n == 2, a("deu_frak", " EQU ")).when(n == 3, a("eng", "hin")).otherwise(a("fra"))
    return table(spark, sf, "documents").select("doc_id", language_tag(codes).alias("tag"))


@query("""WITH e AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'L' || least(9, CAST(l_quantity AS INT) * 5 // 20)
  ELSE CAST(least(2, CAST(trunc((l_discount + (l_discount * 9 + 0.1)) / 2 / (CASE WHEN l_linenumber % 3 = 1 THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE END / CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 1000 END) * 3) AS INT)) AS VARCHAR) || CAST(least(2, CAST(trunc((l_tax + (l_tax * 9 + 0.1)) / 2 * 3) AS INT)) AS VARCHAR) END AS cell FROM lineitem)
SELECT l_orderkey, count(*) || ':' || string_agg(cell, ',' ORDER BY cell) AS layout FROM e GROUP BY l_orderkey""")
def layout_signatures(spark, sf) -> DataFrame:
    """Layouts of screens, an order being one and its lines what is on it, every third of them without a box."""
    boxed = F.col("l_linenumber") % 3 != 0
    place = lambda c: F.when(boxed, c)
    text = F.repeat(F.lit("x"), F.col("l_quantity").cast("int") * 5)
    e = F.struct(place(F.col("l_discount")).alias("x1"), place(F.col("l_tax")).alias("y1"), place(F.col("l_discount") * 9 + 0.1).alias("x2"), place(F.col("l_tax") * 9 + 0.1).alias("y2"), text.alias("text"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(e).alias("e")).select("l_orderkey", layout_signature(F.col("e")).alias("layout"))


_REASON = "CASE e.kind WHEN 'click' THEN 7 WHEN 'view' THEN 6 WHEN 'purchase' THEN 10 WHEN 'signup' THEN 8 ELSE 5 END"
FRAMES = f"""fs AS (SELECT e.video_id, e.fact_id AS frame_id, e."start" AS ts, {_REASON} + 2 * max(CASE WHEN o.fact_id IS NULL THEN 0 ELSE 1 END) + 2 * max(CASE WHEN contains(lower(o.text), 'the') THEN 1 ELSE 0 END) + 2 * max(CASE WHEN contains(lower(o.text), 'error') THEN 1 ELSE 0 END) AS score
  FROM facts e LEFT JOIN facts o ON o.video_id = e.video_id AND o.modality = 'ocr' AND e."start" >= o."start" AND e."start" <= o."end" WHERE e.modality = 'events' GROUP BY e.video_id, e.fact_id, e."start", e.kind),
fl AS (SELECT video_id, list_reduce(list({{'neg': -score, 'ts': ts, 'frame_id': frame_id}} ORDER BY -score, ts, frame_id), lambda k, x: CASE WHEN len(k) < 10 AND len(list_filter(k, lambda y: abs(y.ts - x.ts) < 5)) = 0 THEN list_append(k, x) ELSE k END, list({{'neg': -score, 'ts': ts, 'frame_id': frame_id}})[1:0]) AS k FROM fs GROUP BY video_id),
frames AS (SELECT video_id, k[i].frame_id AS frame_id, k[i].ts AS ts, -k[i].neg AS score, i AS rank FROM fl, unnest(range(1, len(k) + 1)) t(i))"""


def frames_taken(spark, sf) -> DataFrame:
    kind = F.col("kind")
    reason = F.when(kind == "click", "event").when(kind == "view", "keyframe").when(kind == "purchase", "scene_change").when(kind == "signup", "boundary_burst").otherwise("motion")
    taken = facts(spark, sf, "events").select("video_id", F.col("fact_id").alias("frame_id"), F.col("start").alias("ts"), reason.alias("reason"))
    return C.representative_frames(C.frame_scores(taken, facts(spark, sf, "ocr"), PHRASE))


@query(f"""WITH {FACTS_SQL}, {FRAMES} SELECT video_id, frame_id, ts, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM frames""")
def frame_selection(spark, sf) -> DataFrame:
    """Ten frames of each recording, by reason and what is on screen, five seconds apart; events stand for frames taken."""
    return frames_taken(spark, sf)


WHOLE = f"""ef AS (SELECT video_id, name, arg_min(fact_id, ("start", "end", fact_id)) AS a, arg_max(fact_id, ("start", "end", fact_id)) AS b FROM mentions GROUP BY ALL),
ru AS ({RULES}),
whole AS (SELECT DISTINCT video_id || '/entity/' || name AS src, video_id || '/entity/' || name || '#' || fact_id AS dst, 'CONTAINS' AS relation, 1.0::DOUBLE AS confidence FROM mentions
  UNION SELECT video_id || '/entity/' || name || '#' || fact_id, video_id || '/' || fact_id, 'OBSERVED_IN', 1.0::DOUBLE FROM mentions
  UNION SELECT video_id || '/entity/' || name, video_id || '/' || a, 'APPEARS_IN', 0.9::DOUBLE FROM ef UNION SELECT video_id || '/entity/' || name, video_id || '/' || b, 'DISAPPEARS_IN', 0.9::DOUBLE FROM ef WHERE a <> b
  UNION SELECT c.video_id || '/change/' || ts, f.video_id || '/' || f.fact_id, 'SUPPORTS', 1.0::DOUBLE FROM changes c JOIN facts f ON f.video_id = c.video_id AND c.ts < f."end" - 1e-6 AND f."start" < c.region_end - 1e-6
  UNION SELECT video_id || '/state/' || state, video_id || '/' || unnest(string_split(evidence_ids, ',')), 'SUPPORTS', 1.0::DOUBLE FROM states
  UNION SELECT c.video_id || '/chapter/' || c.chapter, s.video_id || '/scene/' || s."start", 'SUPPORTS', 0.9::DOUBLE FROM chapters c JOIN scenes s ON s.video_id = c.video_id AND c."start" < s."end" AND s."start" < c."end"
  UNION SELECT c.video_id || '/change/' || ts, s.video_id || '/state/' || s.state, 'CHANGES_INTO', 0.6::DOUBLE FROM changes c JOIN states s ON s.video_id = c.video_id AND abs(s."start" - ts) <= 2
  UNION SELECT video_id || '/rule/' || type || '/' || ref, video_id || '/' || ref, 'DERIVED_FROM', 1.0::DOUBLE FROM ru WHERE ref IS NOT NULL)"""
_WHOLE = f"{FACTS_SQL}, {DUR}, {SCENES}, {MENTIONS}, {CHANGES}, {STATES}, {CHAPTERS}, {WHOLE}"


def _derived(spark, sf) -> tuple[DataFrame, ...]:
    states = T.states(facts(spark, sf, "ocr", "transcript").where(F.col("end") > F.col("start")))
    return changes(spark, sf), states, chapters(spark, sf), scenes(spark, sf), facts(spark, sf), T.rule_events(facts(spark, sf, "ocr"), scenes(spark, sf))


def _whole(spark, sf) -> DataFrame:
    return G.build_edges(G.entity_edges(E.mentions(facts(spark, sf))), G.derived_edges(*_derived(spark, sf)))


@query(f"""WITH {_WHOLE} SELECT * FROM whole""")
def graph_whole(spark, sf) -> DataFrame:
    """Edges of entities, changes, states, chapters and rule events."""
    return _whole(spark, sf)


@query(f"""WITH RECURSIVE {_WHOLE}, pf AS (SELECT src AS a, dst AS b FROM whole WHERE relation IN ('DERIVED_FROM', 'CONTAINS', 'OBSERVED_IN', 'SUPPORTS')), st AS (SELECT a, b FROM pf UNION SELECT b, a FROM pf),
ds AS (SELECT a, b, regexp_matches(a, '^[^/]+/(entity|change|state|chapter|rule)/') AS da, regexp_matches(b, '^[^/]+/(entity|change|state|chapter|rule)/') AS db FROM st),
wk AS (SELECT a AS origin, a AS id, 0 AS hops, true AS d FROM ds WHERE da UNION SELECT wk.origin, ds.b, hops + 1, ds.db FROM wk JOIN ds ON ds.a = wk.id WHERE wk.d AND hops < 3)
SELECT DISTINCT origin, id FROM wk WHERE NOT d""")
def supporting_evidence(spark, sf) -> DataFrame:
    """The observed nodes behind every derived node of every recording, three steps away at most."""
    return G.proofs(E.mentions(facts(spark, sf)), *_derived(spark, sf))

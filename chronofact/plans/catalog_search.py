"""Queries of graph search, paths and neighbours for tables of nodes, and the contents of a context, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.scalars import rational, significant
from chronofact.functions.text import tokens
from chronofact.operators import boundaries as B
from chronofact.operators import context as C
from chronofact.operators import entities as E
from chronofact.operators import evidence_search as X
from chronofact.operators import graph as G
from chronofact.operators import packaging as P
from chronofact.operators import retrieval as R
from chronofact.operators import temporal as T
from chronofact.operators import tracking as K
from chronofact.operators import validation as D
from chronofact.operators import vectors as V
from chronofact.operators.compression import persistent_elements
from chronofact.operators.intervals import window_around
from chronofact.plans.catalog_entities import EDGES, ENTITIES, MENTIONS
from chronofact.plans.catalog_more import FRAMES, frames_taken
from chronofact.plans.catalog_more import SQL as MORE
from chronofact.plans.catalog_retrieval import PHRASE, _rank_sql
from chronofact.plans.catalog_temporal import DUR, SCENES, durations, scenes
from chronofact.session import materialize, table
from chronofact.sources.facts import FACTS_SQL, descriptions, facts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


_UNDIRECTED = "un AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


@query(f"""WITH RECURSIVE {_rank_sql('video_id')}, {MENTIONS}, {ENTITIES}, {EDGES}, {_UNDIRECTED},
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, coverage DESC, "start", modality) AS place FROM spans) WHERE place <= 10),
base AS (SELECT video_id, 0 AS stage, place, modality, "start", "end", score, ref_ids FROM sp),
asked AS (SELECT * FROM (SELECT video_id, name, confidence, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, first_seen DESC, name) AS place FROM entities
  WHERE contains('{PHRASE}', name) OR contains(name, '{PHRASE}')) WHERE place <= 5),
oc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, name ORDER BY "start", "end", fact_id) AS n
  FROM (SELECT DISTINCT m.video_id, m.name, m.fact_id, m."start", m."end", a.place, a.confidence FROM mentions m JOIN asked a ON a.video_id = m.video_id AND a.name = m.name)) WHERE n <= 10),
ob AS (SELECT video_id, fact_id, min({{'place': place, 'n': n, 'name': name, 'score': confidence}}) AS b FROM oc GROUP BY ALL),
named AS (SELECT ob.video_id, 1 AS stage, b.place * 1000 + b.n AS place, f.modality, f."start", f."end", b.score AS score, f.fact_id AS ref_ids FROM ob JOIN facts f ON f.video_id = ob.video_id AND f.fact_id = ob.fact_id),
sd AS (SELECT DISTINCT video_id, video_id || '/' || unnest(string_split(ref_ids, ',')) AS id FROM sp WHERE place <= 5),
wk AS (SELECT video_id, id, 0 AS hops FROM sd UNION SELECT wk.video_id, un.b, hops + 1 FROM wk JOIN un ON un.a = wk.id WHERE hops < 2),
rc AS (SELECT video_id, id, min(hops) AS hops FROM wk GROUP BY ALL HAVING min(hops) > 0),
rp AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY hops, id) AS n FROM rc),
near AS (SELECT rp.video_id, 2 AS stage, n AS place, f.modality, f."start", f."end", power(0.5, hops) AS score, f.fact_id AS ref_ids FROM rp JOIN facts f ON f.video_id || '/' || f.fact_id = rp.id WHERE n <= 20),
every AS (SELECT * FROM base UNION ALL SELECT * FROM named UNION ALL SELECT * FROM near),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, ref_ids ORDER BY stage, place) AS n FROM every) WHERE n = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY stage, place) AS rank FROM once)
SELECT video_id, CAST(rank AS INT) AS rank, ['lexical', 'entity', 'graph'][stage + 1] AS stage, modality, "start", "end", round(score, 8) AS score, ref_ids, rank <= 10 AS kept, CASE WHEN rank > 10 THEN 'rank cutoff' END AS why
FROM placed WHERE rank <= 20""")
def graph_search(spark, sf) -> DataFrame:
    """Every recording's evidence for a phrase by text, names and two steps in the graph, with what was left out."""
    found = X.search_graph(facts(spark, sf), PHRASE, hops=2)
    return found.withColumn("ref_ids", F.array_join("ref_ids", ",")).drop("text", "confidence", "reason")


_PAIRS = """pairs AS (SELECT a.video_id || '/' || a.fact_id AS src, a.video_id || '/' || b.fact_id AS dst FROM ev a JOIN (SELECT video_id, fact_id, lag(fact_id, 3) OVER (PARTITION BY video_id ORDER BY "start", "end", fact_id) AS third FROM ev) b
  ON b.video_id = a.video_id AND b.third = a.fact_id WHERE CAST(split_part(a.fact_id, '_', 2) AS BIGINT) % 5 = 0)"""


def _graph(spark, sf) -> DataFrame:
    return X.fact_edges(facts(spark, sf))


@query(f"""WITH RECURSIVE {FACTS_SQL}, {EDGES}, {_PAIRS}, ed AS (SELECT src AS a, dst AS b, src || ' ' || relation || ' ' || dst AS edge FROM edges),
un AS (SELECT a, b, min(edge) AS edge FROM (SELECT * FROM ed UNION ALL SELECT b, a, edge FROM ed) GROUP BY ALL),
w AS (SELECT src, dst, src AS node, [src] AS seen, []::VARCHAR[] AS way FROM pairs UNION ALL SELECT w.src, w.dst, un.b, list_append(seen, un.b), list_append(way, un.edge) FROM w JOIN un ON un.a = w.node WHERE len(way) < 4 AND node <> dst AND NOT list_contains(seen, un.b)),
p AS (SELECT src, dst, way, seen FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY len(way), way, seen) AS n FROM w WHERE node = dst) WHERE n = 1)
SELECT src, dst, CAST(i AS INT) AS hop, way[i] AS edge, seen[i] AS a, seen[i + 1] AS b FROM p, unnest(range(1, len(way) + 1)) t(i)""")
def edge_paths(spark, sf) -> DataFrame:
    """The edges of the shortest path from every fifth event to the third one after it."""
    events = facts(spark, sf, "events")
    third = F.lead("fact_id", 3).over(Window.partitionBy("video_id").orderBy("start", "end", "fact_id"))
    rows = events.select("video_id", "fact_id", third.alias("third")).where(F.col("third").isNotNull() & (F.split_part("fact_id", F.lit("_"), F.lit(2)).cast("long") % 5 == 0))
    pairs = rows.select(F.concat("video_id", F.lit("/"), "fact_id").alias("src"), F.concat("video_id", F.lit("/"), "third").alias("dst"))
    return G.edge_paths(_graph(spark, sf), pairs)


@query(f"""WITH {FACTS_SQL}, n AS (SELECT video_id, video_id || '/' || fact_id AS id, "start" AS s, fact_id FROM facts),
p AS (SELECT a.id, b.id AS neighbor, abs(b.s - a.s) AS gap FROM n a JOIN n b ON a.video_id = b.video_id AND a.id <> b.id AND abs(b.s - a.s) <= 30 WHERE a.fact_id LIKE 'ocr\\_%' ESCAPE '\\'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, neighbor) AS place FROM p) SELECT id, neighbor, gap, CAST(place AS INT) AS place FROM r WHERE place <= 5""")
def near_nodes(spark, sf) -> DataFrame:
    """The five facts that start nearest to each screen text, within half a minute."""
    nodes = facts(spark, sf).select("video_id", F.concat("video_id", F.lit("/"), "fact_id").alias("id"), "start", "modality")
    return G.temporal_neighbors(nodes, nodes.where("modality = 'ocr'"), 30.0, 5)


_HELD = """sm AS (SELECT video_id, concat_ws(', ', count(*) FILTER (modality = 'transcript') || ' transcript', count(*) FILTER (modality = 'ocr') || ' ocr', count(*) FILTER (modality = 'events') || ' events') AS one_line,
  coalesce(string_agg(text, ' ' ORDER BY "start", fact_id) FILTER (modality = 'transcript'), '') AS said FROM facts GROUP BY video_id),
st3 AS (SELECT video_id, one_line, substr(said, 1, 200) AS short, substr(said, 1, 2000) AS detailed FROM sm)"""
_PLAN = f"""sx AS (SELECT video_id, round(max(boosted), 8) AS score, max(coverage) AS coverage, min("start") AS "start", modality, string_agg(text, ' ' ORDER BY "start", fact_id) AS text FROM isl GROUP BY video_id, modality, island),
sr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, coverage DESC, "start", modality) AS r, length(text) // 4 + 50 AS t FROM sx), {_HELD},
e AS (SELECT video_id, count(*) AS n, sum(t) AS t, coalesce(sum(t) FILTER (r <= 3), 0) AS t3 FROM sr WHERE r <= 10 GROUP BY video_id), m AS (SELECT video_id, count(*) AS m FROM frames GROUP BY video_id),
a AS (SELECT video_id, coalesce(n, 0) AS n, coalesce(t, 0) AS t, coalesce(t3, 0) AS t3, coalesce(m, 0) AS m FROM e FULL JOIN m USING (video_id)),
q AS (SELECT a.*, one_line, short, detailed, coalesce(length(one_line) // 4, 0) AS x1, coalesce(length(short) // 4, 0) AS x2, coalesce(length(detailed) // 4, 0) AS x3 FROM a LEFT JOIN st3 ON st3.video_id = a.video_id),
b AS (SELECT *, t + 200 * m + x1 + x2 + x3 > 4000 AND n > 3 AS cut FROM q), c2 AS (SELECT *, CASE WHEN cut THEN 3 ELSE n END AS s, CASE WHEN cut THEN t3 ELSE t END AS u FROM b),
d AS (SELECT *, CASE WHEN u + 200 * m + x1 + x2 + x3 > 4000 AND m > 3 THEN 3 ELSE m END AS f FROM c2),
k3 AS (SELECT *, u + 200 * f + x1 + x2 + x3 <= 4000 AS h3 FROM d), k2 AS (SELECT *, u + 200 * f + x1 + x2 + CASE WHEN h3 THEN x3 ELSE 0 END <= 4000 AS h2 FROM k3),
k1 AS (SELECT *, x1 + CASE WHEN h2 THEN x2 ELSE 0 END + CASE WHEN h3 THEN x3 ELSE 0 END AS x FROM k2),
g AS (SELECT *, CASE WHEN u + 200 * f + x > 4000 THEN 0 ELSE f END AS f2 FROM k1), plan AS (SELECT *, CASE WHEN u + 200 * f2 + x > 4000 THEN 0 ELSE s END AS s2 FROM g)"""


def _contents(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    spans = R.search(facts(spark, sf), PHRASE, top_k=0, per_video=True)
    ranked = C.first_ranks(spans, [F.desc("score"), F.desc("coverage"), F.asc("start"), F.asc("modality")], 10)
    return ranked, frames_taken(spark, sf), C.summaries(facts(spark, sf))


@query(f"""WITH {_rank_sql('video_id')}, {FRAMES}, {_PLAN}
SELECT video_id, CAST(s2 AS BIGINT) AS spans, CAST(f2 AS BIGINT) AS frames, concat_ws(',', CASE WHEN one_line IS NOT NULL THEN 'one_line' END, CASE WHEN h2 AND short IS NOT NULL THEN 'short' END, CASE WHEN h3 AND detailed IS NOT NULL THEN 'detailed' END) AS summaries,
  concat_ws('; ', CASE WHEN s2 < n THEN 'spans ' || n || ' to ' || s2 END, CASE WHEN f2 < m THEN 'frames ' || m || ' to ' || f2 END) AS notes FROM plan""")
def context_selection(spark, sf) -> DataFrame:
    """What of each recording's ten best spans, ten frames and summaries a budget of 4000 tokens holds."""
    spans, frames, texts = _contents(spark, sf)
    return C.select_context(spans, frames, 4000, texts)


@query(f"""WITH {_rank_sql('video_id')}, {FRAMES}, {_PLAN}
SELECT p.video_id, 'span' AS kind, CAST(r AS INT) AS rank, sr.text, CAST(sr.t AS BIGINT) AS tokens FROM sr JOIN plan p ON p.video_id = sr.video_id WHERE r <= s2
UNION ALL SELECT p.video_id, 'frame', CAST(rank AS INT), frame_id, 200 FROM frames JOIN plan p ON p.video_id = frames.video_id WHERE rank <= f2
UNION ALL SELECT video_id, 'summary', i, x, length(x) // 4 FROM (SELECT video_id, unnest([1, 2, 3]) AS i, unnest([one_line, CASE WHEN h2 THEN short END, CASE WHEN h3 THEN detailed END]) AS x FROM plan) WHERE x IS NOT NULL""")
def context_items(spark, sf) -> DataFrame:
    """The spans, frames and summaries of each recording's context themselves."""
    spans, frames, texts = _contents(spark, sf)
    return C.context_items(spans, frames, 4000, texts)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT *, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.e, c.e) / (q.n * c.n), 5) AS score FROM n q JOIN n c ON q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s) SELECT query_id, rank, id, score, round(1.0::DOUBLE / (60 + rank), 8) AS rrf FROM r WHERE rank <= 20""")
def vector_lists(spark, sf) -> DataFrame:
    """The twenty nearest vectors of every fiftieth one, with what their ranks give a fused list."""
    rows = table(spark, sf, "embeddings")
    return V.nearest_vectors(rows, rows.where("vec_id % 50 = 0"), 20).withColumn("rrf", F.round("rrf", 8))


_CELLS = ", ".join(f"[{', '.join(str((2 * r + i) * 8 + 2 * c + j + 1) for i in (0, 1) for j in (0, 1))}]" for r in range(4) for c in range(4))
_RUNS = f"""f AS (SELECT 'v' || (vec_id // 100) AS video_id, CAST(vec_id AS DOUBLE) AS ts, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY ts) AS p FROM f),
d AS (SELECT *, CASE WHEN p IS NULL OR list_max(list_transform([{_CELLS}], lambda t: list_avg(list_transform(t, lambda i: abs(e[i] - p[i]))))) > 0.24 THEN 1 ELSE 0 END AS b FROM l),
runs AS (SELECT video_id, ts, CAST(sum(b) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM d)"""


def _pictures(spark, sf) -> DataFrame:
    """Vectors as pictures of 8 by 8 points, a hundred a recording."""
    return table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.floor(F.col("vec_id") / 100)).alias("video_id"), F.col("vec_id").cast("double").alias("ts"), F.col("embedding").alias("pixels"), "label")


@query(f"WITH {_RUNS} SELECT * FROM runs")
def tile_runs(spark, sf) -> DataFrame:
    """Runs of pictures none of whose 16 tiles differs much from the one before."""
    return K.tile_runs(_pictures(spark, sf), 0.24, 4)


@query(f"""WITH {_RUNS}, h AS (SELECT video_id, run, min(ts) AS read_at FROM runs GROUP BY ALL)
SELECT r.video_id, r.ts, r.run, h.read_at, e.label FROM runs r JOIN h ON h.video_id = r.video_id AND h.run = r.run JOIN embeddings e ON e.vec_id = h.read_at""")
def run_replay(spark, sf) -> DataFrame:
    """What was read from the first picture of each run, here its label, on all pictures of the run."""
    pictures = _pictures(spark, sf)
    runs = materialize(K.tile_runs(pictures, 0.24, 4), "runs")
    first = runs.groupBy("video_id", "run").agg(F.min("ts").alias("ts")).select("video_id", "ts")
    return K.replayed(runs, pictures.select("video_id", "ts", "label").join(first, ["video_id", "ts"]))


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, d AS (SELECT video_id, CASE WHEN CAST(substr(video_id, 2) AS BIGINT) % 5 = 0 THEN ' ' ELSE '1.0' END AS version FROM dur),
s AS (SELECT video_id, kind AS name FROM facts WHERE modality = 'events' AND "start" < 30 AND CAST(substr(video_id, 2) AS BIGINT) % 3 > 0),
o AS (SELECT video_id, CASE WHEN CAST(substr(video_id, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE 2 END AS frame_count FROM facts WHERE modality = 'ocr')
SELECT video_id, NULL AS fact_id, 'version' AS rule, 'error' AS severity FROM d WHERE trim(version) = ''
UNION ALL SELECT video_id, name, 'stages', 'error' FROM s GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT video_id, NULL, 'provenance', 'warning' FROM scenes WHERE video_id NOT IN (SELECT video_id FROM s)
UNION ALL SELECT video_id, NULL, 'ocr_dedup', 'warning' FROM o GROUP BY video_id HAVING count(*) > 10 AND max(frame_count) <= 1""")
def document_findings(spark, sf) -> DataFrame:
    """Findings on documents with injected faults: no version, repeated stages, segments without stages, texts of one frame each."""
    number = F.substring("video_id", 2, 20).cast("long")
    documents = durations(spark, sf).select("video_id", F.when(number % 5 == 0, " ").otherwise("1.0").alias("version"))
    stages = facts(spark, sf, "events").where((F.col("start") < 30) & (number % 3 > 0)).select("video_id", F.col("kind").alias("name"))
    texts = facts(spark, sf, "ocr").select("video_id", F.when(number % 2 == 0, 1).otherwise(2).alias("frame_count"))
    return D.document_rules(documents, stages, scenes(spark, sf), texts, 10)


@query(f"""WITH {FACTS_SQL}, {DUR}, {SCENES}, w AS (SELECT 'fixed' AS sampler, video_id, 0.0::DOUBLE AS s, duration AS e, 0.5::DOUBLE AS fps, 'fixed' AS reason FROM dur WHERE duration > 0
  UNION ALL SELECT 'scene', video_id, "start", "end", 0.2, 'long_scene' FROM scenes WHERE "end" - "start" > 8
  UNION ALL SELECT 'scene', video_id, 0, duration, 0.2, 'no_scenes' FROM dur WHERE duration > 0 AND video_id NOT IN (SELECT video_id FROM scenes)),
f AS (SELECT *, sum((e - s) * fps) OVER (PARTITION BY sampler, video_id) AS f FROM w)
SELECT sampler, video_id, s AS "start", e AS "end", round(CASE WHEN f > 100 THEN greatest(0.05, fps * 100 / f) ELSE fps END, 9) AS fps, reason FROM f
UNION ALL SELECT 'scene', video_id, round(least("start", greatest("start", "end" - 0.05)), 3), NULL, NULL, 'scene_keyframe' FROM scenes""")
def sampling_plans(spark, sf) -> DataFrame:
    """What a fixed rate and scenes would sample of each recording, a hundred frames at most; a keyframe has no end."""
    d = durations(spark, sf)
    windows, frames = T.scene_plan(d, scenes(spark, sf))
    fit = lambda rows, name: T.fit_budget(rows, 100).select(F.lit(name).alias("sampler"), "video_id", "start", "end", F.round("fps", 9).alias("fps"), "reason")
    none = F.lit(None).cast("double")
    keys = frames.select(F.lit("scene").alias("sampler"), "video_id", F.col("ts").alias("start"), none.alias("end"), none.alias("fps"), "reason")
    return fit(T.fixed_plan(d, 0.5), "fixed").unionByName(fit(windows, "scene")).unionByName(keys)


@query(f"""{MORE["segments_snapped"].rsplit("SELECT * FROM r", 1)[0].rstrip().rstrip(",")},
sg AS (SELECT * FROM r WHERE "end" - "start" > 1e-6), ls AS (SELECT video_id, list({{'s': "start", 'e': "end"}} ORDER BY "start", "end") AS l FROM sg GROUP BY video_id),
ms AS (SELECT video_id, list_reduce(l[2:], lambda k, x: CASE WHEN x.e - x.s < 4 OR k[-1].e - k[-1].s < 4 THEN list_append(k[:-2], {{'s': k[-1].s, 'e': x.e}}) ELSE list_append(k, x) END, l[1:1]) AS l FROM ls)
SELECT video_id, CAST(i - 1 AS INT) AS segment, l[i].s AS "start", l[i].e AS "end" FROM ms, unnest(range(1, len(l) + 1)) t(i)""")
def segments_merged(spark, sf) -> DataFrame:
    """Segments cut in silences, those under four seconds joined to the one before."""
    return T.merge_short(B.snapped_segments(scenes(spark, sf), facts(spark, sf, "transcript"), 8.0))


@query(f"""WITH {FACTS_SQL}, {DUR} SELECT fact_id, greatest(0.0, "start" - 7) AS lo, least("end" + 7, duration) AS hi FROM facts JOIN dur USING (video_id)""")
def window_clamp(spark, sf) -> DataFrame:
    """Seven seconds around each fact, cut to its recording."""
    lo, hi = window_around(F.col("start"), F.col("end"), 7.0, F.col("duration"))
    return facts(spark, sf).join(durations(spark, sf), "video_id").select("fact_id", lo.alias("lo"), hi.alias("hi"))


@query(rf"""WITH {FACTS_SQL}, w AS (SELECT video_id, greatest(0.0, "start" - 5) AS s, least("end" + 5, duration) AS e FROM facts JOIN (SELECT video_id, max("end") AS duration FROM facts GROUP BY ALL) USING (video_id) WHERE kind = 'error'),
i AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1e-6 THEN 0 ELSE 1 END AS f FROM w),
n AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i) SELECT video_id, round(min(s), 3) AS "start", round(max(e), 3) AS "end" FROM n GROUP BY video_id, island""")
def ranges_merged(spark, sf) -> DataFrame:
    """The merged ranges around each recording's errors."""
    return P.relevant_ranges(facts(spark, sf).where("kind = 'error'"), durations(spark, sf))


@query(rf"""WITH {FACTS_SQL}, {DUR}, u AS (SELECT video_id, CASE WHEN fact_id LIKE '%3' THEN "end" + 9 ELSE "start" - 2 END AS a, "end" + 3 AS b, text FROM facts WHERE modality = 'transcript'),
n AS (SELECT video_id, least(greatest(least(a, b), 0.0), duration) AS s, least(greatest(greatest(a, b), 0.0), duration) AS e, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM u JOIN dur USING (video_id))
SELECT video_id, s AS "start", e AS "end", text, format('utt_{{:04d}}', row_number() OVER (PARTITION BY video_id ORDER BY s, e, text) - 1) AS id FROM n WHERE text <> ''""")
def utterances_normal(spark, sf) -> DataFrame:
    """Utterances with injected faults, reversed or beyond their recording, made fit to store."""
    rows = facts(spark, sf, "transcript")
    faulty = rows.select("video_id", F.when(F.col("fact_id").endswith("3"), F.col("end") + 9).otherwise(F.col("start") - 2).alias("start"), (F.col("end") + 3).alias("end"), "text")
    return T.normal_utterances(faulty, durations(spark, sf))


@query(rf"""WITH {FACTS_SQL}, f AS (SELECT video_id, CAST(floor("start" / 120) AS BIGINT) AS state, "start" AS ts, text FROM facts WHERE modality = 'ocr'), n AS (SELECT video_id, state, count(DISTINCT ts) AS frames FROM f GROUP BY ALL),
e AS (SELECT video_id, state, element, count(DISTINCT ts) AS n FROM (SELECT video_id, state, ts, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'))) AS element FROM f) GROUP BY ALL)
SELECT e.* FROM e JOIN n ON n.video_id = e.video_id AND n.state = e.state WHERE n >= 0.8 * frames""")
def persistent_words(spark, sf) -> DataFrame:
    """Words on screen in four of five frames of two minutes."""
    shown = facts(spark, sf, "ocr").select("video_id", F.floor(F.col("start") / 120).alias("state"), F.col("start").alias("ts"), "text")
    words = shown.select("video_id", "state", "ts", F.explode(F.array_distinct(tokens(F.col("text")))).alias("element"))
    return persistent_elements(words, shown)


@query(f"""WITH {FACTS_SQL}, {MENTIONS.replace("mentions AS (SELECT * FROM mn", "m0 AS (SELECT * FROM mn")}, a AS (SELECT * FROM (VALUES ('der', 'german article'), ('die', 'german article'), ('les', 'french article')) v(alias, canonical)),
mentions AS (SELECT m0.* REPLACE (coalesce(canonical, name) AS name) FROM m0 LEFT JOIN a ON alias = name), {ENTITIES}
SELECT video_id, name, occurrences, first_seen, last_seen, modalities, CASE WHEN name IN ('german article', 'french article') THEN 0.95::DOUBLE ELSE confidence END AS confidence, ambiguous AND name NOT IN ('german article', 'french article') AS ambiguous FROM entities
UNION ALL SELECT video_id, name, count(*), min("start"), max("end"), max(modality), 0.95, false FROM mentions WHERE name IN ('german article', 'french article') GROUP BY video_id, name HAVING count(*) = 1""")
def aliased_entities(spark, sf) -> DataFrame:
    """Entities under the names that a user's aliases give them."""
    known = spark.createDataFrame([("Der", "German article"), ("Die", "German article"), ("Les", "French article")], "alias string, canonical string")
    return E.aliased_entities(E.mentions(facts(spark, sf)), known).drop("display")


@query(f"""WITH {_rank_sql('video_id')} SELECT video_id, modality, "start", "end", score FROM spans WHERE score >= 0.018""")
def floored_spans(spark, sf) -> DataFrame:
    """Spans whose score, after merging, keeps a floor."""
    return R.search(facts(spark, sf), PHRASE, top_k=0, per_video=True, min_score=0.018).select("video_id", "modality", "start", "end", "score")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, CAST(l_quantity AS INT) || '/' || (l_linenumber - 1) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN x = 0 THEN 0 ELSE round(x * power(10.0, 3 - floor(log10(abs(x))))) / power(10.0, 3 - floor(log10(abs(x)))) END AS digits,
  CASE WHEN split_part(r, '/', 2) <> '0' THEN CAST(split_part(r, '/', 1) AS DOUBLE) / CAST(split_part(r, '/', 2) AS DOUBLE) END AS rate FROM v""")
def rates_and_digits(spark, sf) -> DataFrame:
    """Four digits of each line's price, and its quantity over its number as a rate."""
    rate = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/"), (F.col("l_linenumber") - 1).cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", significant(F.col("l_extendedprice")).alias("digits"), rational(rate).alias("rate"))


@query(rf"""WITH {FACTS_SQL}, p AS (SELECT page_id, page_id // 20 AS v, page_id % 20 AS k, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>([^<]*)</title', 1)) AS title, url FROM pages),
d AS (SELECT 'v' || v AS video_id, 'vis_' || page_id AS fact_id, k * 30.0::DOUBLE AS s, k * 30.0::DOUBLE + 20 AS e, CASE WHEN title <> '' THEN title ELSE coalesce(url, '') END AS text, list_transform(range(0, 5), lambda i: 'evt_' || (v * 100 + k * 5 + i)) AS frame_ids FROM p),
f AS (SELECT video_id, fact_id AS frame_id, "start" AS ts FROM facts WHERE modality = 'events'),
o AS (SELECT f.video_id, frame_id, string_agg(DISTINCT x.fact_id, ',' ORDER BY x.fact_id) AS ids FROM f JOIN facts x ON x.video_id = f.video_id AND x.modality = 'ocr' AND ts >= x."start" AND ts <= x."end" GROUP BY ALL),
v AS (SELECT f.video_id, frame_id, string_agg(DISTINCT d.fact_id, ',' ORDER BY d.fact_id) AS ids, max(length(text)) AS longest FROM f JOIN d ON d.video_id = f.video_id AND ((ts >= s AND ts <= e) OR list_contains(frame_ids, frame_id)) GROUP BY ALL)
SELECT f.video_id, f.frame_id, coalesce(o.ids, '') AS shown_ids, coalesce(v.ids, '') AS described_ids FROM f LEFT JOIN o ON o.video_id = f.video_id AND o.frame_id = f.frame_id LEFT JOIN v ON v.video_id = f.video_id AND v.frame_id = f.frame_id""")
def frame_descriptions(spark, sf) -> DataFrame:
    """For each event, as a frame, the screen texts and the page descriptions that hold it, by time or as one of their frames."""
    frames = facts(spark, sf, "events").select("video_id", F.col("fact_id").alias("frame_id"), F.col("start").alias("ts"))
    found = C.frame_context(frames, facts(spark, sf, "ocr"), descriptions(table(spark, sf, "pages")))
    return found.select("video_id", "frame_id", F.array_join("shown_ids", ",").alias("shown_ids"), F.array_join("described_ids", ",").alias("described_ids"))


@query(rf"""WITH p AS (SELECT page_id, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>([^<]*)</title', 1)) AS title, url FROM pages)
SELECT 'v' || page_id // 20 AS video_id, 'vis_' || page_id AS fact_id, (page_id % 20) * 30.0::DOUBLE AS "start", (page_id % 20) * 30.0::DOUBLE + 20 AS "end", CASE WHEN title <> '' THEN title ELSE coalesce(url, '') END AS text, 5 AS frames FROM p""")
def vision_facts(spark, sf) -> DataFrame:
    rows = descriptions(table(spark, sf, "pages"))
    return rows.select("video_id", "fact_id", "start", "end", "text", F.size("frame_ids").alias("frames"))

"""Queries of question understanding, profiles and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.operators.profiles import CONCEPT_SIGNS, key_concepts, keyword_profile, keyword_sentences, user_flows
from chronofact.operators.profiles import profile_lists as sentence_lists
from chronofact.plans import cues
from chronofact.plans.catalog_retrieval import PHRASE, _rank_sql
from chronofact.plans.questions import plan_table, read_questions
from chronofact.plans.questions import sql as question_sql
from chronofact.plans.understanding import app_hint, classify_tasks, run_temporal
from chronofact.session import table
from chronofact.sources.facts import FACTS_SQL, facts
from chronofact.sources.readers import page_lines
from chronofact.streaming import facts as S
from chronofact.streaming.tracks import stream_tracks as stream_text_tracks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


_Q = lambda w: w.replace("'", "''")
_RULES = ", ".join(f"({i}, '{t}', [{', '.join(chr(39) + _Q(w) + chr(39) for w in words)}])" for i, (t, words) in enumerate(cues.TASKS))


@query(f"""WITH r AS (SELECT * FROM (VALUES {_RULES}) v(place, task, words)),
s AS (SELECT item_id, place, task, CAST(len(list_filter(words, lambda w: contains(lower(text), w))) AS BIGINT) AS hits FROM benchmark, r),
t AS (SELECT item_id, task, CAST(sum(hits) AS BIGINT) AS score, min(place) FILTER (hits > 0) AS first FROM s GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS n FROM t)
SELECT item_id, CASE WHEN score = 0 THEN 'global_understanding' ELSE task END AS task, CASE WHEN score = 0 THEN 0.3::DOUBLE ELSE least(1.0::DOUBLE, score / 5.0::DOUBLE) END AS confidence FROM b WHERE n = 1""")
def task_classify(spark, sf) -> DataFrame:
    return classify_tasks(table(spark, sf, "benchmark")).select("item_id", "task", "confidence")


QUESTIONS = (
    "what happened before the error", "what happened immediately after the login", "error between 01:30 and 02:00", "what changed between the login and the error", "first mention of revenue",
    "last occurrence of pricing", "what was said while the chart was shown", "compare both videos", "which videos mention pricing", "summarize the recording", "pricing at 12:20",
    "show me the evidence for the claim", "timeline of the outage", "what is visible on screen", "find the invoice", "from 0:10 to 0:50 what is shown", "what happened around the crash", "step by step setup",
)


_ASKED = ", ".join(f"({-i}, '{_Q(q)}')" for i, q in enumerate(QUESTIONS, 1))


@query(question_sql(f"(SELECT item_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES {_ASKED}) v(item_id, text))"))
def intent_table(spark, sf) -> DataFrame:
    """Intent, anchor, range and stages of every benchmark text and of the sample questions (ids below 0)."""
    samples = spark.createDataFrame([(-i, q) for i, q in enumerate(QUESTIONS, 1)], "item_id long, text string")
    asked = table(spark, sf, "benchmark").select("item_id", "text").unionByName(samples)
    return read_questions(asked).withColumnRenamed("text", "question")


_CASES = lambda table, rest: "CASE intent " + " ".join(f"WHEN '{k}' THEN '{_Q(', '.join(v) if isinstance(v, tuple) else v)}'" for k, v in table.items()) + f" ELSE {rest} END"
_NAMED = ", ".join(f"CASE WHEN len(list_filter([{', '.join(chr(39) + _Q(w) + chr(39) for w in words)}], lambda w: contains(lower(question), w))) > 0 THEN '{m}' END" for m, words in cues.MODALITIES.items())


@query(f"""WITH {FACTS_SQL}, q AS (SELECT * FROM ({question_sql(f"(SELECT item_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES {_ASKED}) v(item_id, text))")})),
n AS (SELECT item_id, question, intent, list_filter([{_NAMED}], lambda x: x IS NOT NULL) AS named FROM q),
m AS (SELECT *, list_filter(CASE WHEN len(named) > 0 THEN named ELSE string_split({_CASES(cues.INTENT_MODALITIES, "''")}, ', ') END, lambda x: x <> '') AS needed FROM n),
t AS (SELECT list(DISTINCT modality) AS there FROM facts)
SELECT item_id, question, intent, array_to_string(needed, ', ') AS modalities, {_CASES(cues.STRATEGIES, "NULL")} AS strategy, {_CASES(cues.GRAPH_OPERATIONS, "''")} AS operations,
  {_CASES(cues.FALLBACKS, f"'{cues.FALLBACK}'")} AS fallback, array_to_string(list_filter(needed, lambda x: NOT list_contains(there, x)), ', ') AS missing FROM m, t""")
def question_plans(spark, sf) -> DataFrame:
    """How each benchmark text and sample question would be answered, and which modalities it would lack."""
    samples = spark.createDataFrame([(-i, q) for i, q in enumerate(QUESTIONS, 1)], "item_id long, text string")
    asked = table(spark, sf, "benchmark").select("item_id", "text").unionByName(samples)
    return plan_table(asked, facts(spark, sf)).withColumnRenamed("text", "question")


@query(f"""WITH {_rank_sql('')}, p AS (SELECT video_id AS v, "end" AS e FROM spans ORDER BY score DESC, coverage DESC, "start", video_id, modality LIMIT 1)
SELECT video_id, modality, "start", "end", text, round(1 / (1 + greatest(0, "start" - e)), 9) AS score FROM facts JOIN p ON video_id = v WHERE "start" - e >= -1e-6 ORDER BY "start" - e, fact_id LIMIT 10""")
def temporal_question(spark, sf) -> DataFrame:
    """The ten facts that follow the best span of an anchor, nearest first."""
    rows = run_temporal(facts(spark, sf), f"what happened after {PHRASE}")[1]
    return rows.select("video_id", "modality", "start", "end", "text", F.round("score", 9).alias("score"))


_DIMS = {"style": cues.STYLE, "typography": cues.TYPOGRAPHY, "layout": cues.LAYOUT, "interaction": cues.INTERACTION, "motion": cues.MOTION}
_DIM = ", ".join(f"('{d}', '{n}', [{', '.join(chr(39) + _Q(w) + chr(39) for w in words)}])" for d, table_ in _DIMS.items() for n, words in table_.items())


@query(f"""WITH {FACTS_SQL}, d AS (SELECT * FROM (VALUES {_DIM}) v(dimension, label, words))
SELECT video_id, dimension, label, count(*) AS n, min("start") AS first_seen, max("end") AS last_seen FROM facts, d WHERE len(list_filter(words, lambda w: contains(lower(text), w))) > 0 GROUP BY ALL""")
def profile_keywords(spark, sf) -> DataFrame:
    return keyword_profile(facts(spark, sf))


_STEPS = "|".join(w.replace("-", "\\-") for w in cues.SENTENCES["step"])


@query(rf"""WITH {FACTS_SQL}, s AS (SELECT video_id, "start", trim(unnest(string_split(lower(text), '.'))) AS s FROM facts WHERE modality = 'transcript'),
f AS (SELECT video_id, substr(s, 1, 100) AS sentence, min("start") AS first_seen FROM s WHERE regexp_matches(s, '{_STEPS}') AND length(s) > 10 GROUP BY ALL)
SELECT video_id, sentence, first_seen, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first_seen, sentence) AS rank FROM f) WHERE rank <= 20""")
def profile_sentences(spark, sf) -> DataFrame:
    return keyword_sentences(facts(spark, sf, "transcript"), cues.SENTENCES["step"])


_KINDS = ", ".join(f"('{k}', [{', '.join(chr(39) + _Q(w) + chr(39) for w in words)}])" for k, words in cues.SENTENCES.items())


@query(rf"""WITH {FACTS_SQL}, s AS (SELECT video_id, "start", trim(unnest(string_split(lower(text), '.'))) AS s FROM facts),
k AS (SELECT * FROM (VALUES {_KINDS}) v(kind, words)),
f AS (SELECT video_id, kind, substr(s, 1, 100) AS sentence, min("start") AS first_seen FROM s, k WHERE length(s) > 10 AND len(list_filter(words, lambda w: contains(s, w))) > 0 GROUP BY ALL)
SELECT video_id, kind, sentence, first_seen, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, kind ORDER BY first_seen, sentence) AS rank FROM f) WHERE rank <= 20""")
def profile_lists(spark, sf) -> DataFrame:
    """Features, use cases, objectives and steps that a recording's texts tell of."""
    return sentence_lists(facts(spark, sf))


#: The texts' words are invented: these stand for signs of a concept.
SIGNS = (*CONCEPT_SIGNS, "heble", "oiré", "enpf", "rroie")
_SIGNS = ", ".join(f"'{w}'" for w in SIGNS)


@query(rf"""WITH {FACTS_SQL}, f AS (SELECT video_id, "start", unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1)) AS concept FROM facts WHERE len(list_filter([{_SIGNS}], lambda w: contains(lower(text), w))) > 0),
g AS (SELECT video_id, concept, min("start") AS first_seen FROM f WHERE length(concept) > 2 GROUP BY ALL)
SELECT video_id, concept, first_seen, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first_seen, concept) AS rank FROM g) WHERE rank <= 20""")
def profile_concepts(spark, sf) -> DataFrame:
    return key_concepts(facts(spark, sf), SIGNS)


_APPS = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in cues.APPS)


@query(f"""SELECT doc_id, CASE {_APPS} END AS app FROM documents""")
def app_hints(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", app_hint(F.col("text")).alias("app"))


@query(f"""WITH {FACTS_SQL}, e AS (SELECT *, CASE WHEN "start" - lag("end") OVER w <= 5 THEN 0 ELSE 1 END AS f FROM facts WHERE modality = 'events' WINDOW w AS (PARTITION BY video_id ORDER BY "start", "end", fact_id)),
c AS (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY "start", "end", fact_id) AS chain FROM e)
SELECT video_id, CAST(chain AS BIGINT) AS chain, count(*) AS events, min("start") AS "start", max("end") AS "end" FROM c GROUP BY video_id, chain""")
def user_flow_sessions(spark, sf) -> DataFrame:
    return user_flows(facts(spark, sf, "events"), 5.0).select("video_id", F.col("chain").cast("long").alias("chain"), "events", "start", "end")


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b[^\x00]*?</script\s*>', ' ', 'gi'), '<style\b[^\x00]*?</style\s*>', ' ', 'gi'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS x FROM b)
SELECT page_id, count(*) AS lines, sum(length(trim(regexp_replace(x, '\s+', ' ', 'g'))))::BIGINT AS chars FROM l WHERE trim(regexp_replace(x, '\s+', ' ', 'g')) <> '' GROUP BY page_id""")
def page_text(spark, sf) -> DataFrame:
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return page_lines(table(spark, sf, "pages")).where(flat != "").groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length(flat)).alias("chars"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_windows(spark, sf) -> DataFrame:
    """Hourly counts of a stream that has ended, in append mode: a window comes out, and leaves the state, when the watermark passes it."""
    events, end = S.ended(S.read_events(spark, sf))
    return S.run_available(S.windowed_counts(events), end).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events""")
def stream_dedup(spark, sf) -> DataFrame:
    rows = S.run_available(S.distinct_events(S.read_events(spark, sf), ["event_id"]))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f, event_id FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf) -> DataFrame:
    """Sessions of a stream that has ended, in append mode: a session comes out, and leaves the state, when the watermark passes it."""
    events, end = S.ended(S.read_events(spark, sf))
    found = S.run_available(S.sessions(events, "30 minutes"), end)
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


_WORD = r"regexp_extract(text, '^[^\x20\x09-\x0D]+')"


@query(rf"""WITH o AS (SELECT 'v' || (doc_id // 20) AS video_id, CAST((doc_id % 20) * 30 AS DOUBLE) AS ts, {_WORD} AS text, doc_id % 10 / 10.0::DOUBLE AS confidence FROM documents WHERE {_WORD} <> ''),
f AS (SELECT video_id, ts, lead(ts) OVER (PARTITION BY video_id ORDER BY ts) AS next FROM o), n AS (SELECT o.*, coalesce(next, -1) AS next, lower(text) AS norm FROM o JOIN f USING (video_id, ts)),
l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video_id, norm ORDER BY ts) <= 90 THEN 0 ELSE 1 END AS f FROM n), i AS (SELECT *, sum(f) OVER (PARTITION BY video_id, norm ORDER BY ts) AS island FROM l)
SELECT video_id, arg_max(text, {{'c': confidence, 'n': length(text), 't': -ts}}) AS text, min(ts) AS start, CASE WHEN arg_max(next, ts) < 0 THEN 600.0::DOUBLE ELSE (max(ts) + arg_max(next, ts)) / 2 END AS "end",
  max(ts) AS last_ts, count(*) AS frame_count, round(avg(confidence), 4) AS confidence FROM i GROUP BY video_id, norm, island""")
def stream_tracks(spark, sf) -> DataFrame:
    """Tracks of each document's first word, equal words being one text, over a stream of the documents with an end for each recording."""
    stream = S.read_table(spark, sf, "documents")
    word = F.regexp_extract("text", r"^[^\x20\x09-\x0D]+", 0)
    video, none = F.concat(F.lit("v"), F.floor(F.col("doc_id") / 20)), F.lit(None).cast("double")
    seen = stream.where(word != "").select(video.alias("video_id"), ((F.col("doc_id") % 20) * 30.0).alias("ts"), word.alias("text"), (F.col("doc_id") % 10 / 10.0).alias("confidence"))
    rows = seen.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("last"))
    # A day later, as a stream takes what happened at its clock's zero for late.
    at = F.when(F.col("last"), 600.0).otherwise(F.col("ts")) + 86400.0
    rows = rows.select("video_id", F.timestamp_seconds(at).alias("at"), at.alias("ts"), F.when(~F.col("last"), F.col("text")).alias("text"), "confidence", *[none.alias(c) for c in ("x1", "y1", "x2", "y2")], "last")
    rows, end = S.ended(rows, "at")
    found = S.run_available(stream_text_tracks(rows, least=1.0, max_gap=90.0), end)
    return found.select("video_id", "text", *[(F.col(c) - 86400.0).alias(c) for c in ("start", "end", "last_ts")], "frame_count", "confidence")


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 60 SECONDS""")
def stream_pairs(spark, sf) -> DataFrame:
    events = S.read_events(spark, sf)
    return S.run_available(S.near_pairs(events, events, 60))

"""Queries of ranked retrieval, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators import retrieval as R
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


PHRASE = "of the error"
WORDS = ["of", "the", "error"]


def _hits_sql(scope: str) -> str:
    """Common table expressions up to hits, with statistics per scope (a column list, empty for the collection)."""
    by, on = (f"PARTITION BY {scope}" if scope else ""), (f"{scope}," if scope else "")
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(WORDS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) OVER ({by}) AS df{i}" for i in range(len(WORDS)))
    idf = ", ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) AS w{i}" for i in range(len(WORDS)))
    score = " + ".join(f"w{i} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(tokens) / avgdl))" for i in range(len(WORDS)))
    matched = " + ".join(f"CASE WHEN tf{i} > 0 THEN w{i} ELSE 0 END" for i in range(len(WORDS)))
    return rf"""{FACTS_SQL}, tk AS (SELECT *, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+') AS tokens FROM facts),
tf AS (SELECT *, {tf} FROM tk),
st AS (SELECT *, count(*) OVER ({by}) AS n, greatest(1.0::DOUBLE, avg(len(tokens)) OVER (PARTITION BY {on} modality)) AS avgdl, {df} FROM tf),
wt AS (SELECT *, {idf} FROM st),
hits AS (SELECT video_id, modality, fact_id, "start", "end", confidence, text, round({score}, 6) AS score, round(({matched}) / ({' + '.join(f'w{i}' for i in range(len(WORDS)))}), 6) AS coverage,
  contains(' ' || array_to_string(tokens, ' ') || ' ', ' {' '.join(WORDS)} ') AS phrase FROM wt WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(WORDS)))})"""


def _rank_sql(scope: str) -> str:
    on = f"{scope}, " if scope else ""
    return f"""{_hits_sql(scope)}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {on}modality ORDER BY phrase DESC, coverage DESC, score DESC, "start", fact_id) AS INT) AS rank FROM hits),
boosted AS (SELECT r.*, 1.0::DOUBLE / (60 + rank) AS rrf, (1.0::DOUBLE / (60 + rank)) * CASE WHEN EXISTS (SELECT 1 FROM hits o WHERE o.video_id = r.video_id AND o.modality <> r.modality
  AND r."start" < o."end" + 1 AND o."start" < r."end" + 1) THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS boosted FROM ranked r),
isl AS (SELECT *, sum(f) OVER (PARTITION BY video_id, modality ORDER BY "start", "end", fact_id) AS island FROM (SELECT *, CASE WHEN "start" - max("end") OVER (PARTITION BY video_id, modality
  ORDER BY "start", "end", fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS f FROM boosted)),
spans AS (SELECT video_id, modality, min("start") AS "start", max("end") AS "end", round(max(boosted), 8) AS score, max(coverage) AS coverage, string_agg(fact_id, ',' ORDER BY "start", fact_id) AS ref_ids FROM isl GROUP BY video_id, modality, island)"""


def _hits(spark, sf, scope=None) -> DataFrame:
    return R.bm25(facts(spark, sf), WORDS, scope)


@query(rf"""WITH {FACTS_SQL}, t AS (SELECT DISTINCT fact_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')) AS term FROM facts)
SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM facts) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term""")
def idf_table(spark, sf) -> DataFrame:
    rows = R.indexed(facts(spark, sf))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return R.term_stats(rows, []).join(n).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"""WITH {_hits_sql('')} SELECT fact_id, score, coverage, phrase FROM hits""")
def bm25(spark, sf) -> DataFrame:
    return _hits(spark, sf).select("fact_id", "score", "coverage", "phrase")


@query(f"""WITH {_hits_sql('video_id')} SELECT fact_id, score, coverage, phrase FROM hits""")
def bm25_per_video(spark, sf) -> DataFrame:
    return _hits(spark, sf, ["video_id"]).select("fact_id", "score", "coverage", "phrase")


@query(f"""WITH {_rank_sql('')} SELECT fact_id, rank, round(rrf, 8) AS rrf FROM boosted""")
def rrf_fusion(spark, sf) -> DataFrame:
    return R.rrf(_hits(spark, sf)).select("fact_id", "rank", F.round("rrf", 8).alias("rrf"))


@query(f"""WITH {_rank_sql('')} SELECT fact_id, round(boosted, 8) AS boosted FROM boosted""")
def cooccurrence_boost(spark, sf) -> DataFrame:
    return R.boost_cooccurrence(R.rrf(_hits(spark, sf))).select("fact_id", F.round("boosted", 8).alias("boosted"))


@query(f"""WITH {_rank_sql('')} SELECT * FROM spans""")
def merge_adjacent(spark, sf) -> DataFrame:
    merged = R.merge_adjacent(R.boost_cooccurrence(R.rrf(_hits(spark, sf))))
    return merged.select("video_id", "modality", "start", "end", "score", "coverage", F.array_join("ref_ids", ",").alias("ref_ids"))


@query(f"""WITH {_rank_sql('')} SELECT * FROM spans ORDER BY score DESC, coverage DESC, "start", video_id, modality LIMIT 10""")
def search_topk(spark, sf) -> DataFrame:
    return R.search(facts(spark, sf), PHRASE).select("video_id", "modality", "start", "end", "score", "coverage", F.array_join("ref_ids", ",").alias("ref_ids"))


@query(f"""WITH {_rank_sql('video_id')} SELECT video_id, modality, "start", "end", score, coverage, ref_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, coverage DESC, "start", video_id, modality) AS r FROM spans) WHERE r <= 5""")
def collection_search(spark, sf) -> DataFrame:
    """The five best spans of every recording, statistics per recording."""
    found = R.search(facts(spark, sf), PHRASE, top_k=0, per_video=True, per_video_k=5)
    return found.select("video_id", "modality", "start", "end", "score", "coverage", F.array_join("ref_ids", ",").alias("ref_ids"))


_VEC = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0)"""


def _vectors(spark, sf):
    t = table(spark, sf, "embeddings")
    row = t.where("vec_id = 0").first()
    return t, [float(x) for x in row["embedding"]]


@query(f"""WITH {_VEC} SELECT vec_id, round(list_dot_product(e, qe) / (greatest(sqrt(list_dot_product(e, e)), 1e-12) * greatest(sqrt(list_dot_product(qe, qe)), 1e-12)), 5) AS score
FROM v, q ORDER BY score DESC, vec_id LIMIT 100""")
def vector_topk(spark, sf) -> DataFrame:
    return R.cosine_top_k(*_vectors(spark, sf))


@query(f"""WITH {_hits_sql('')}, {_VEC}, lx AS (SELECT CAST(split_part(fact_id, '_', 2) AS BIGINT) AS id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY phrase DESC, coverage DESC, score DESC, "start", fact_id)) AS rrf FROM hits WHERE modality = 'ocr'),
c AS (SELECT vec_id, round(list_dot_product(e, qe) / (greatest(sqrt(list_dot_product(e, e)), 1e-12) * greatest(sqrt(list_dot_product(qe, qe)), 1e-12)), 5) AS s FROM v, q ORDER BY s DESC, vec_id LIMIT 100),
vx AS (SELECT vec_id AS id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, vec_id)) AS rrf FROM c)
SELECT id, round(sum(rrf), 8) AS fused FROM (SELECT * FROM lx UNION ALL SELECT * FROM vx) GROUP BY id""")
def hybrid_rrf(spark, sf) -> DataFrame:
    """Lexical hits on documents and the nearest vectors of the same ids, in one fused list."""
    lexical = R.rrf(_hits(spark, sf).where("modality = 'ocr'")).select(F.split_part("fact_id", F.lit("_"), F.lit(2)).cast("long").alias("id"), "rrf")
    near = R.cosine_top_k(*_vectors(spark, sf)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))).select(F.col("vec_id").alias("id"), (1.0 / (60 + F.col("r"))).alias("rrf"))
    return R.fuse([lexical, near], "id")

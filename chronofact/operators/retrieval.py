"""Ranked lexical and vector retrieval with rank fusion, per recording or over a collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.text import tokens
from chronofact.operators.intervals import interval_join, islands
from chronofact.session import global_rank, materialize

#: BM25 saturation and length weights, fusion constant, co-occurrence tolerance and boost, merge gap.
K1, B, RRF_K, CO_TOLERANCE, CO_BOOST, MERGE_GAP = 1.2, 0.75, 60, 1.0, 0.25, 2.0

#: Up to so many spans their members are sent to all tasks; beyond, both sides are dealt by recording.
MOST_BROADCAST = 1000


def query_tokens(spark, query: str) -> list[str]:
    """A query's tokens, as facts are tokenised (on a one-row table: the same expression decides)."""
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def indexed(facts: DataFrame, extra: Column | None = None) -> DataFrame:
    """facts with their tokens; extra tokens (of attributes) are appended, repeats kept."""
    t = tokens(F.col("text"))
    return facts.withColumn("tokens", t if extra is None else F.concat(t, extra))


def term_stats(indexed_facts: DataFrame, scope: list[str], query: list[str] | None = None) -> DataFrame:
    """Document frequency of terms within scope columns (empty: the whole collection): scope, term, df.

    With a query only its terms are counted: tokens are filtered before the explode, so the shuffle holds those alone.
    """
    t = F.array_distinct("tokens")
    if query is not None:
        t = F.filter(t, lambda x: x.isin(*query))
    return indexed_facts.select(*scope, F.explode(t).alias("term")).groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))


def length_stats(indexed_facts: DataFrame, scope: list[str]) -> DataFrame:
    """scope, modality, modality's facts and mean tokens (at least 1)."""
    return indexed_facts.groupBy(*scope, "modality").agg(F.count(F.lit(1)).alias("n_modality"), F.greatest(F.lit(1.0), F.avg(F.size("tokens"))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(facts: DataFrame, query: list[str], scope: list[str] | None = None, text: Column | None = None) -> DataFrame:
    """Facts that hold a query term, with score, coverage, phrase and matched.

    Each text (``text``, by default the fact's own) is read once, into tokens; of those only the query's are kept, and a term's
    count is a column over these few. What is counted is written, with a fact's other columns for hits alone, and
    both the statistics, one row per scope, and the hits come from there. Statistics
    cover all facts of the scope; filter afterwards. coverage is the weight of the matched terms over that of all;
    phrase says that the whole query stands as a run.
    """
    scope = scope or []
    unique = list(dict.fromkeys(query))
    n = range(len(unique))
    read = facts.withColumn("_tokens", tokens(F.col("text") if text is None else text))
    mine = F.filter("_tokens", lambda x: x.isin(*unique)) if unique else F.array().cast("array<string>")
    read = read.withColumns({"_len": F.size("_tokens"), "_mine": mine, "_run": F.when(F.size(mine) > 0, F.col("_tokens")) if len(query) > 1 else F.lit(None)})
    times = lambda t: F.size(F.filter("_mine", lambda x: x == t))
    counts = read.withColumns({f"_tf{i}": times(t) for i, t in enumerate(unique)})
    found = F.size("_mine") > 0
    spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    phrase = F.coalesce(F.contains(spaced(F.col("_run")), F.lit(f" {' '.join(query)} ")), F.lit(False)) if len(query) > 1 else F.lit(False)
    whole = F.when(found, F.struct(*[F.col(c) for c in facts.columns])).alias("_fact")
    keys = list(dict.fromkeys([*scope, "modality"]))
    counted = materialize(counts.select(*[F.col(c).alias("_k_" + c) for c in keys], "_len", *[f"_tf{i}" for i in n], phrase.alias("phrase"), whole), "counted")
    some = [F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in n]
    per_modality = counted.groupBy(*["_k_" + c for c in keys]).agg(F.count(F.lit(1)).alias("_nm"), F.sum("_len").alias("_words"), *some)
    total = Window.partitionBy(*["_k_" + c for c in scope])
    stats = per_modality.select(
        *[F.col("_k_" + c).alias("_s_" + c) for c in keys],
        F.greatest(F.lit(1.0), F.col("_words") / F.col("_nm")).alias("_avgdl"),
        F.sum("_nm").over(total).alias("_n"),
        *[F.sum(f"_df{i}").over(total).alias(f"_df{i}") for i in n],
    )
    hit = counted.where("_fact IS NOT NULL").join(stats, reduce(lambda a, b: a & b, [F.col("_k_" + c) == F.col("_s_" + c) for c in keys]))
    weight = [idf(F.col("_n"), F.col(f"_df{i}")) for i in n]
    norm = K1 * (1 - B + B * F.col("_len") / F.col("_avgdl"))
    zero = F.lit(0.0)
    score = sum((weight[i] * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + norm) for i in n), zero)
    matched = sum((F.when(F.col(f"_tf{i}") > 0, weight[i]).otherwise(0.0) for i in n), zero)
    return hit.select(
        "_fact.*",
        F.round(score, 6).alias("score"),
        F.round(matched / sum(weight, zero), 6).alias("coverage"),
        "phrase",
        F.filter(F.array(*[F.when(F.col(f"_tf{i}") > 0, F.lit(t)) for i, t in enumerate(unique)]), lambda x: x.isNotNull()).alias("matched"),
    )


#: Hit order: phrase, coverage, score, then time and id.
def hit_order() -> list[Column]:
    return [F.desc("phrase"), F.desc("coverage"), F.desc("score"), F.asc("start"), F.asc("fact_id")]


def rrf(hits: DataFrame, scope: list[str] | None = None, k: int = RRF_K, order: list[Column] | None = None, weight: float = 1.0) -> DataFrame:
    """Hits with their rank in their modality's list and rrf = weight / (k + rank).

    Lists of a recording are bounded blocks; a collection's list may hold most facts, so its ranks come from a range
    partitioning.
    """
    order = order or hit_order()
    if scope:
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*scope, "modality").orderBy(*order)))
    else:
        ranked = global_rank(hits, ["modality"], order).withColumn("rank", (F.col("rank") + 1).cast("int"))
    return ranked.withColumn("rrf", F.lit(weight) / (k + F.col("rank")))


def fuse(lists: list[DataFrame], key: str = "fact_id") -> DataFrame:
    """The sum of rrf over several lists, by fact; absent means 0."""
    return reduce(lambda a, b: a.unionByName(b), [x.select(key, "rrf") for x in lists]).groupBy(key).agg(F.round(F.sum("rrf"), 8).alias("fused"))


def boost_cooccurrence(candidates: DataFrame, tol: float = CO_TOLERANCE, boost: float = CO_BOOST, width: float = 30.0) -> DataFrame:
    """Candidates (with rrf) times 1 + boost where one of another modality lies within tol; near_modalities says which."""
    slim = candidates.select("video_id", "fact_id", "modality", "start", "end")
    pairs = interval_join(slim, slim, ["video_id"], width, tol).where("l_modality <> r_modality")
    near = pairs.groupBy(F.col("l_fact_id").alias("_id")).agg(F.array_sort(F.collect_set("r_modality")).alias("near_modalities"))
    out = candidates.join(near, F.col("fact_id") == F.col("_id"), "left").drop("_id")
    return out.withColumn("boosted", F.col("rrf") * F.when(F.col("near_modalities").isNotNull(), 1 + boost).otherwise(1.0))


def merge_adjacent(candidates: DataFrame, gap: float = MERGE_GAP, score: str = "boosted") -> DataFrame:
    """Candidates of one recording and modality that follow within ``gap`` as one span: its times are those of its facts.

    Where candidates have a text, so have spans.
    """
    runs = islands(candidates, ["video_id", "modality"], gap, ("start", "end", "fact_id"))
    texts = ["text"] if "text" in candidates.columns else []
    members = F.array_sort(F.collect_list(F.struct("start", "fact_id", *texts, "matched")))
    return (
        runs.groupBy("video_id", "modality", "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max(score).alias("score"),
            F.max("coverage").alias("coverage"),
            F.min("confidence").alias("confidence"),
            members.alias("_m"),
        )
        .select(
            "video_id", "modality", "start", "end", F.round("score", 8).alias("score"), "coverage", "confidence",
            F.transform("_m", lambda x: x["fact_id"]).alias("ref_ids"),
            *[F.array_join(F.transform("_m", lambda x: x["text"]), " ").alias("text") for _ in texts],
            F.array_sort(F.array_distinct(F.flatten(F.transform("_m", lambda x: x["matched"])))).alias("matched"),
        )
    )


def search(facts: DataFrame, query: str, modalities: list[str] | None = None, start: float | None = None, end: float | None = None, top_k: int = 10, min_score: float = 0.0, per_video: bool = False, per_video_k: int | None = None) -> DataFrame:
    """Ranked spans: BM25 over whole-scope statistics, filters, fusion, boost, merge, floor, order, limit.

    Statistics are those of the recording with per_video, else of the collection; filters narrow what is returned,
    not what is counted. top_k of 0 or less returns all. Ranks, boosts and merging work on rows without texts; these join the
    spans that are left, which are written for it.
    """
    words = query_tokens(facts.sparkSession, query)
    if not words:
        return facts.sparkSession.createDataFrame([], "video_id string, modality string, start double, end double, score double, coverage double, confidence double, ref_ids array<string>, text string, matched array<string>")
    scope = ["video_id"] if per_video else []
    hits = bm25(facts, words, scope)
    if modalities is not None:
        hits = hits.where(F.col("modality").isin(*modalities))
    if start is not None:
        hits = hits.where(F.col("end") >= start)
    if end is not None:
        hits = hits.where(F.col("start") <= end)
    spans = merge_adjacent(boost_cooccurrence(rrf(hits.drop("text"), scope))).where(F.col("score") >= min_score)
    order = [F.desc("score"), F.desc("coverage"), F.asc("start"), F.asc("video_id"), F.asc("modality")]
    if per_video_k is not None:
        w = Window.partitionBy("video_id").orderBy(*order)
        spans = spans.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_video_k).drop("_r")
    left = materialize(spans.orderBy(*order).limit(top_k) if top_k > 0 else spans, "spans")
    key = ["video_id", "modality", "start"]  # spans of a recording and modality do not touch
    members = left.select(*key, F.posexplode("ref_ids").alias("_n", "fact_id"))
    # With a limit these are the facts of top_k spans, each within one recording.
    members = F.broadcast(members) if 0 < top_k <= MOST_BROADCAST else members
    said = hits.select(F.col("video_id").alias("_v"), F.col("fact_id").alias("_f"), "text")
    texts = said.join(members, (F.col("_v") == F.col("video_id")) & (F.col("_f") == F.col("fact_id"))).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_t"))
    out = left.join(texts, key).withColumn("text", F.array_join(F.transform("_t", lambda x: x["text"]), " "))
    return out.select("video_id", "modality", "start", "end", "score", "coverage", "confidence", "ref_ids", "text", "matched").orderBy(*order)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of greatest cosine with a query vector (norms of at least 1e-12), ties to smaller ids."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector_col)
    norm = lambda a: F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return vectors.select(F.col(id_col), F.round(dot(v, q) / (norm(v) * norm(q)), 5).alias("score")).orderBy(F.desc("score"), id_col).limit(k)

"""Entities of recordings: errors, commands and named concepts, their occurrences and timelines, and comparison."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.text import candidate_names, normal_name
from chronofact.operators.intervals import interval_join
from chronofact.session import materialize

#: Seconds between linked mentions, entities kept for a recording, confidences.
LINK_TOLERANCE, MAX_ENTITIES = 1.0, 200


def mentions(facts: DataFrame) -> DataFrame:
    """(video_id, name, surface, modality, fact_id, start, end) of each quoted or capitalised phrase said or shown."""
    rows = facts.where(F.col("modality").isin("ocr", "transcript"))
    out = rows.select("video_id", "modality", "fact_id", "start", "end", F.explode(F.array_distinct(candidate_names(F.col("text")))).alias("surface"))
    return out.withColumn("name", normal_name(F.col("surface"))).where("name <> ''")


def concepts(facts: DataFrame) -> DataFrame:
    """Concept entities: occurrences of one name; see ``rolled_up``."""
    return rolled_up(mentions(facts))


def rolled_up(m: DataFrame) -> DataFrame:
    """Entities of mentions: linked across modalities within a second 0.85, else three or more occurrences 0.6 and two
    0.5, both ambiguous; single mentions are none. The display is the longest surface."""
    slim = m.select("video_id", "name", "modality", "start", "end")
    names = slim.groupBy("video_id", "name").agg(F.count_distinct("modality").alias("k")).where("k > 1").select("video_id", "name")
    both = slim.join(names, ["video_id", "name"], "left_semi")
    linked = interval_join(both.where("modality = 'ocr'"), both.where("modality = 'transcript'"), ["video_id", "name"], 60.0, LINK_TOLERANCE)
    linked = linked.select(F.col("l_video_id").alias("video_id"), F.col("l_name").alias("name"), F.lit(True).alias("linked")).distinct()
    rolled = m.groupBy("video_id", "name").agg(
        F.max(F.struct(F.length("surface").alias("n"), F.col("surface").alias("s"))).alias("_s"),
        F.count(F.lit(1)).alias("occurrences"),
        F.min("start").alias("first_seen"),
        F.max("end").alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("modalities"),
    )
    e = rolled.where("occurrences > 1").join(linked, ["video_id", "name"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return e.select(
        "video_id", "name", F.substring("_s.s", 1, 80).alias("display"), "occurrences", "first_seen", "last_seen", "modalities",
        F.when(F.col("linked"), 0.85).when(F.col("occurrences") >= 3, 0.6).otherwise(0.5).alias("confidence"),
        (~F.col("linked")).alias("ambiguous"),
    )


def merged(m: DataFrame, similarity: float | None = None) -> DataFrame:
    """Mentions whose names name one thing, under the least of these names.

    Names of a recording merge when they share a word of four letters or, with ``similarity``, are that alike, and some of
    their mentions lie within a second of each other; merging carries over. Pairs are found by word, time and
    recording, so none is formed that does not share these.
    """
    slim = m.select("video_id", "name", "start", "end")
    words = slim.withColumn("word", F.explode(F.array_distinct(F.filter(F.split("name", " "), lambda w: F.length(w) >= 4)))).distinct()
    near = interval_join(words, words, ["video_id", "word"], 60.0, LINK_TOLERANCE).where("l_name < r_name")
    pairs = near.select(F.col("l_video_id").alias("video_id"), F.col("l_name").alias("a"), F.col("r_name").alias("b")).distinct()
    if similarity is not None:
        alike = similar_names(m.select("video_id", "name").distinct(), similarity, shared=False).select("video_id", "a", "b")
        sides = alike.join(slim.select("video_id", F.col("name").alias("a"), "start", "end"), ["video_id", "a"])
        close = interval_join(sides, slim, ["video_id"], 60.0, LINK_TOLERANCE).where("l_b = r_name")
        pairs = pairs.union(close.select(F.col("l_video_id").alias("video_id"), F.col("l_a").alias("a"), F.col("l_b").alias("b")).distinct()).distinct()
    return m.join(least_names(pairs), ["video_id", "name"], "left").withColumn("name", F.coalesce("least", "name")).drop("least")


def least_names(pairs: DataFrame) -> DataFrame:
    """(video_id, name, least): the least name that pairs (video_id, a, b) connect a name with, by repeated minima.

    Every round takes the least of the neighbours' and of what those point at, so chains halve; rounds are written.
    """
    both = materialize(pairs.select("video_id", "a", "b").union(pairs.select("video_id", "b", "a")), "pairs")
    now = materialize(both.groupBy("video_id", F.col("a").alias("name")).agg(F.least(F.min("a"), F.min("b")).alias("least")), "least")
    while True:
        far = both.join(now, (both["video_id"] == now["video_id"]) & (both["b"] == now["name"])).select(both["video_id"], F.col("a").alias("name"), "least")
        hop = now.alias("x").join(now.alias("y"), (F.col("x.video_id") == F.col("y.video_id")) & (F.col("x.least") == F.col("y.name"))).select("x.video_id", "x.name", "y.least")
        new = materialize(now.union(far).union(hop).groupBy("video_id", "name").agg(F.min("least").alias("least")), "least")
        if new.join(now, ["video_id", "name", "least"], "left_anti").isEmpty():
            return new
        now = new


def typed_entities(facts: DataFrame, rule_events: DataFrame, similarity: float | None = None) -> DataFrame:
    """(video_id, type, name, occurrences, first_seen, last_seen, confidence, ambiguous): an ERROR for each error shown, a
    COMMAND for each command entered, and the CONCEPTs of merged mentions."""
    kind = F.when(F.col("type") == "error_shown", "ERROR").when(F.col("type") == "command_entered", "COMMAND")
    events = rule_events.withColumn("kind", kind).where("kind IS NOT NULL AND detail IS NOT NULL").select(
        "video_id", F.col("kind").alias("type"), F.substring("detail", 1, 80).alias("name"), F.lit(1).cast("long").alias("occurrences"), F.col("start").alias("first_seen"), F.col("end").alias("last_seen"),
        F.when(F.col("kind") == "ERROR", 0.7).otherwise(0.85).alias("confidence"), F.lit(False).alias("ambiguous"),
    )
    named = rolled_up(merged(mentions(facts), similarity))
    return events.unionByName(named.select("video_id", F.lit("CONCEPT").alias("type"), "name", "occurrences", "first_seen", "last_seen", "confidence", "ambiguous"))


def top_entities(entities: DataFrame, most: int = MAX_ENTITIES) -> DataFrame:
    """The first ``most`` entities of each recording by confidence, then the latest first seen."""
    w = Window.partitionBy("video_id").orderBy(F.desc("confidence"), F.desc("first_seen"), "name")
    return entities.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: Fixed value: the confidence of entities that a user named.
ALIASED = 0.95


def with_aliases(m: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions renamed by (alias, canonical), user knowledge; names without an alias stay."""
    known = aliases.select(normal_name(F.col("alias")).alias("name"), normal_name(F.col("canonical")).alias("canonical"))
    return m.join(known, "name", "left").withColumn("name", F.coalesce("canonical", "name")).drop("canonical")


def aliased_entities(m: DataFrame, aliases: DataFrame) -> DataFrame:
    """Concepts of mentions under their canonical names: those a user named are sure (ALIASED) and never ambiguous, once mentioned or often."""
    own = aliases.select(normal_name(F.col("canonical")).alias("name")).distinct().withColumn("_own", F.lit(True))
    renamed = with_aliases(m, aliases)
    found = rolled_up(renamed).join(own, "name", "left")
    single = renamed.join(own, "name").groupBy("video_id", "name").agg(F.count(F.lit(1)).alias("occurrences"), F.max("surface").alias("s"), F.min("start").alias("first_seen"), F.max("end").alias("last_seen"), F.max("modality").alias("modalities")).where("occurrences = 1")
    once = single.select("video_id", "name", F.substring("s", 1, 80).alias("display"), "occurrences", "first_seen", "last_seen", "modalities", F.lit(ALIASED).alias("confidence"), F.lit(False).alias("ambiguous"))
    sure = F.coalesce("_own", F.lit(False))
    rows = found.withColumns({"confidence": F.when(sure, ALIASED).otherwise(F.col("confidence")), "ambiguous": F.col("ambiguous") & ~sure}).select(*once.columns)
    return rows.unionByName(once)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_names(entities: DataFrame, least: float = 0.88, shared: bool = True) -> DataFrame:
    """(video_id, a, b, ratio): pairs a < b of names of one recording whose Ratcliff-Obershelp ratio is >= least.

    With ``shared`` they share a word of four letters, too, and that word is the join key. Without, no pair is missed and
    few others are formed (``alike_candidates``). The ratio, which SQL lacks, runs on those pairs in Arrow batches.
    """
    if shared:
        keys = F.filter(F.split("name", " "), lambda w: F.length(w) >= 4)
        words = entities.select("video_id", "name", F.explode(F.array_distinct(keys)).alias("word"))
        pairs = words.alias("a").join(words.alias("b"), ["video_id", "word"]).where("a.name < b.name").select("video_id", F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()
    else:
        pairs = alike_candidates(entities.select("video_id", "name").distinct(), least)
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    ratio = F.pandas_udf(_ratio, "double")
    return pairs.where(short >= 0.5 * long).withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= least)


def alike_candidates(names: DataFrame, least: float) -> DataFrame:
    """(video_id, a, b), a < b: every pair of names (video_id, name) with a ratio of ``least`` (over 2/3) or more, and some others.

    The ratio is 2m / s, of m matched and s characters in all, and the matched ones are a common subsequence. So a
    name of n characters becomes the other by taking x out and putting y in, where x + y <= (1 - least) * s, that is (2 - least) * x +
    least * y <= 2n * (1 - least). Each character out breaks two of the name's pairs of neighbours, each one in one: k = 4n *
    (1 - least) / (2 - least) at most. Pairs of neighbours, numbered where they repeat, are put in one order for all names, the
    rarest first; the first k + 1 of a name hold one that the first ones of the other hold, too: this prefix is the
    join key. Names of few characters have no more than k pairs; they, and what is near them in length, meet by single
    characters likewise, of which x + 1 make the prefix. Pairs then need lengths that fit.
    """
    n, out = F.length("name"), 2 * (1 - least) / (2 - least)
    short = max((i for i in range(1, 500) if i - 1 <= int(2 * out * i + 1e-9)), default=0)
    reach = int(short * (2 - least) / least + 1e-9)
    chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("name", i, 1))
    twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("name", i, 2))).otherwise(F.array().cast("array<string>"))
    kinds = F.array(
        F.when(n <= reach, F.struct(chars.alias("g"), F.floor(out * n + 1e-9).cast("int").alias("k"))),
        F.when(n > short, F.struct(twos.alias("g"), F.floor(2 * out * n + 1e-9).cast("int").alias("k"))),
    )
    rows = names.where(n > 0).select("video_id", "name", F.explode(kinds).alias("x")).where(F.col("x").isNotNull()).select("video_id", "name", "x.g", "x.k")
    times = lambda i: F.size(F.filter(F.slice("g", 1, i), lambda x: x == F.get("g", i))).cast("string")
    marked = materialize(rows.withColumn("g", F.transform("g", lambda x, i: F.concat(x, F.when(i > 0, times(i)).otherwise("0")))), "grams")
    df = marked.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    each = marked.select("video_id", "name", "k", F.length(F.get("g", F.lit(0))).alias("kind"), F.explode("g").alias("gram")).join(df, "gram")
    ranked = each.groupBy("video_id", "name", "k", "kind").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("order"))
    keys = F.explode(F.slice(F.transform("order", lambda x: x["gram"]), 1, F.col("k") + 1))
    keyed = materialize(ranked.select("video_id", "name", "kind", keys.alias("key")), "keys")
    pairs = keyed.alias("x").join(keyed.alias("y"), ["video_id", "kind", "key"]).where("x.name < y.name")
    x, y = F.length("x.name"), F.length("y.name")
    return pairs.where(F.abs(x - y) <= F.floor((1 - least) * (x + y) + 1e-9)).select("video_id", F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()


def videos_with_all(m: DataFrame, names: list[str]) -> DataFrame:
    """Recordings that mention every one of the names (relational division)."""
    wanted = [n.lower() for n in dict.fromkeys(names)]
    return m.where(F.col("name").isin(*wanted)).groupBy("video_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(wanted)).select("video_id")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entities of two recordings by name: added, removed, uncertain, changed or shared.

    Uncertain if either is ambiguous; changed if the occurrences differ by a factor of two or the modalities differ.
    """
    x = a.select("name", F.col("occurrences").alias("na"), F.col("modalities").alias("ma"), F.col("ambiguous").alias("ua"))
    y = b.select("name", F.col("occurrences").alias("nb"), F.col("modalities").alias("mb"), F.col("ambiguous").alias("ub"))
    many, few = F.greatest("na", "nb"), F.least("na", "nb")
    kind = (
        F.when(F.col("na").isNull(), "added")
        .when(F.col("nb").isNull(), "removed")
        .when(F.col("ua") | F.col("ub"), "uncertain")
        .when((many >= 2 * few) | (F.col("ma") != F.col("mb")), "changed")
        .otherwise("shared")
    )
    return x.join(y, "name", "full_outer").select("name", "na", "nb", kind.alias("status"))

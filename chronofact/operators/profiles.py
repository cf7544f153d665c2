"""Profiles of recordings: keyword dimensions met with what is said, shown and described."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators.temporal import event_chains
from chronofact.plans import cues

DIMENSIONS = {"style": cues.STYLE, "typography": cues.TYPOGRAPHY, "layout": cues.LAYOUT, "interaction": cues.INTERACTION, "motion": cues.MOTION}


#: Words near which a tutorial's concepts stand, and how many of them a recording keeps.
CONCEPT_SIGNS = (
    "called", "named", "known as", "referred to as", "the key", "the main", "the important", "the core",
    "concept", "principle", "pattern", "technique", "method", "approach", "strategy", "best practice",
)
MOST_CONCEPTS = 20


def labelled(rows: DataFrame, labels: dict[str, tuple[str, ...]], text_col: str = "text") -> DataFrame:
    """rows with ``found``, the labels (in their order) one of whose words the text holds, case folded.

    All words of all labels are one automaton (Aho-Corasick), built once in a task and run over the text once, in Arrow
    batches: the time a text takes does not grow with the number of words. Null texts hold none.
    """
    names = list(labels)
    low = rows.withColumn("_low", F.lower(F.col(text_col)))
    schema = rows.withColumn("found", F.array().cast("array<string>")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, set[int]] = {}
        for i, name in enumerate(names):
            for word in labels[name]:
                of.setdefault(word.lower(), set()).add(i)
        words = ahocorasick.Automaton()
        for word, which in of.items():
            words.add_word(word, frozenset(which))
        words.make_automaton()
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                seen = set().union(*{which for _, which in words.iter(text)}) if text else set()
                found.append([names[i] for i in sorted(seen)])
            columns = [*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "found"])

    return low.mapInArrow(task, schema)


def keyword_profile(facts: DataFrame, dimensions: dict | None = None) -> DataFrame:
    """(video_id, dimension, label, n, first_seen, last_seen): labels found in a recording's facts, and when."""
    labels = {f"{k}/{label}": words for k, d in (dimensions or DIMENSIONS).items() for label, words in d.items()}
    rows = labelled(facts.select("video_id", "start", "end", "text"), labels).select("video_id", "start", "end", F.explode("found").alias("x"))
    found = rows.groupBy("video_id", "x").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_seen"), F.max("end").alias("last_seen"))
    return found.select("video_id", F.split_part("x", F.lit("/"), F.lit(1)).alias("dimension"), F.split_part("x", F.lit("/"), F.lit(2)).alias("label"), "n", "first_seen", "last_seen")


def profile_lists(facts: DataFrame, kinds: dict[str, tuple[str, ...]] | None = None, most: int = 20, longest: int = 100) -> DataFrame:
    """(video_id, kind, sentence, first_seen, rank): of each kind the distinct sentences over ten characters that hold one of
    its words, the first ``most`` of a recording by time, cut to ``longest`` characters: features, uses, objectives, steps."""
    sentences = facts.select("video_id", "start", F.explode(F.split(F.lower("text"), r"\.")).alias("text")).withColumn("text", F.trim("text")).where(F.length("text") > 10)
    found = labelled(sentences, kinds or cues.SENTENCES).select("video_id", F.explode("found").alias("kind"), F.substring("text", 1, longest).alias("sentence"), "start")
    first = found.groupBy("video_id", "kind", "sentence").agg(F.min("start").alias("first_seen"))
    w = Window.partitionBy("video_id", "kind").orderBy("first_seen", "sentence")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def keyword_sentences(facts: DataFrame, words: tuple[str, ...], most: int = 20, longest: int = 100) -> DataFrame:
    """``profile_lists`` of one kind."""
    return profile_lists(facts, {"kind": words}, most, longest).drop("kind")


def key_concepts(facts: DataFrame, signs: tuple[str, ...] = CONCEPT_SIGNS, most: int = MOST_CONCEPTS) -> DataFrame:
    """(video_id, concept, first_seen, rank): capitalised phrases in facts that hold a sign of one, the first of a recording by time."""
    rows = labelled(facts.select("video_id", "start", "text"), {"sign": signs}).where(F.size("found") > 0)
    phrases = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1)
    found = rows.select("video_id", "start", F.explode(F.array_distinct(phrases)).alias("concept")).where(F.length("concept") > 2)
    first = found.groupBy("video_id", "concept").agg(F.min("start").alias("first_seen"))
    w = Window.partitionBy("video_id").orderBy("first_seen", "concept")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def user_flows(events: DataFrame, gap: float = 30.0) -> DataFrame:
    """Runs of events of a recording, a new one after more than ``gap`` seconds."""
    return event_chains(events, gap, 1)


#: Profiles by name: a function of facts each. ``register_profile`` adds others.
PROFILES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ui_design": keyword_profile,
    "application": user_flows,
    "product_demo": lambda facts: profile_lists(facts, {k: cues.SENTENCES[k] for k in ("feature", "use_case")}),
    "tutorial": lambda facts: profile_lists(facts, {k: cues.SENTENCES[k] for k in ("objective", "step")}),
    "concepts": key_concepts,
}


def register_profile(name: str) -> Callable:
    """A decorator that puts a function of facts among the profiles; a name is taken once."""
    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in PROFILES:
            raise KeyError(f"there is a profile {name!r}")
        PROFILES[name] = f
        return f

    return put


def profile(name: str, facts: DataFrame) -> DataFrame:
    """A profile of each recording of facts, by its name."""
    if name not in PROFILES:
        raise KeyError(f"no profile {name!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[name](facts)

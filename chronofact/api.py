"""The library's front door: a collection of recordings, and one recording of it.

Every method returns a DataFrame (or a plan with one), so what is asked for is planned with what is done to it next.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from chronofact.functions.text import normal_name
from chronofact.operators import entities as E
from chronofact.operators import evidence_search as X
from chronofact.operators import packaging as P
from chronofact.operators import retrieval as R
from chronofact.operators import temporal as T
from chronofact.operators.intervals import closed
from chronofact.plans.cues import GRAPH_OPERATIONS, STRATEGIES
from chronofact.plans.evidence_graph import whole_graph
from chronofact.plans.understanding import Plan, build_plan, classify_tasks, plan_stages, run_temporal
from chronofact.plugins import Settings
from chronofact.sources.facts import MODALITIES


#: Intents that are answered from whatever there is.
ANY_EVIDENCE = ("fact_lookup", "general_summary")
QUOTED = "no model is configured: the answer is the evidence itself, quoted, not an interpretation"


@dataclass
class Answer:
    """What a question found: the ledger of its evidence, and which modalities it would need that there are not."""

    question: str
    plan: Plan
    ledger: DataFrame
    top_k: int
    min_score: float | None = None
    missing: tuple[str, ...] = ()

    @cached_property
    def spans(self) -> list[Row]:
        """The evidence, best first: at most ``top_k`` rows."""
        rows = self.ledger.where("kept")
        rows = rows if self.min_score is None else rows.where(F.col("score") >= self.min_score)
        return rows.orderBy("rank", F.desc("score"), "video_id").limit(self.top_k).collect()

    def confidence(self) -> float:
        """The mean of the evidence's confidences where known, 1 at most; 0.5 where none is, 0 without evidence."""
        known = [r["confidence"] for r in self.spans if r["confidence"] is not None]
        return min(1.0, sum(known) / len(known)) if known else 0.5 if self.spans else 0.0

    def outcome(self) -> str:
        return "extractive" if self.spans else "insufficient_coverage" if self.missing else "insufficient_evidence"

    def text(self, most: int = 5) -> str:
        """The evidence itself, numbered, with its times; or why there is none."""
        if not self.spans:
            return f"the facts lack {', '.join(self.missing)}" if self.missing else "no evidence met the question" + ("" if self.min_score is None else " at the least score")
        return "\n".join(f"[{i}] {r['start']:.1f}-{r['end']:.1f} ({r['modality']}): {r['text'][:200]}" for i, r in enumerate(self.spans[:most], 1))

    def trace(self) -> dict:
        """How the answer came about: plan, counts by stage, what the answer rests on, what was left out, and warnings."""
        counts = {r["stage"]: r["n"] for r in self.ledger.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).collect()}
        left = self.ledger.where("NOT kept").orderBy("video_id", "rank").limit(10).collect()
        warnings = [*self.plan.notes, *([f"missing modalities: {', '.join(self.missing)}"] if self.missing else []), *([QUOTED] if self.spans else [])]
        return {
            "query": self.question, "intent": self.plan.intent, "strategy": STRATEGIES[self.plan.intent], "operations": GRAPH_OPERATIONS.get(self.plan.intent, ()), "anchor": self.plan.temporal.anchor, "retrieved": counts, "support": [x for r in self.spans for x in r["ref_ids"]],
            "omitted": [{"ref_ids": r["ref_ids"], "why": r["why"]} for r in left], "budget": {"top_k": self.top_k, "min_score": self.min_score}, "outcome": self.outcome(), "warnings": warnings,
        }


@dataclass
class Collection:
    """Facts of many recordings; times stay local to each."""

    facts: DataFrame
    settings: Settings = Settings()

    def recording(self, video_id: str) -> Collection:
        return Collection(self.facts.where(F.col("video_id") == video_id), self.settings)

    def search(self, query: str, **options) -> DataFrame:
        return R.search(self.facts, query, **{"top_k": self.settings.top_k, **options})

    def ask(self, question: str, top_k: int = 5, modalities: list[str] | None = None, min_score: float | None = None) -> Answer:
        """Evidence for a question: temporal phrasing first, then ranked spans, names and the graph; no model is needed.

        Needed modalities that there are none of are named, and evidence is looked for all the same.
        """
        facts = self.facts if modalities is None else self.facts.where(F.col("modality").isin(*modalities))
        plan, base = build_plan(question), None
        if plan.temporal.is_temporal:
            plan, rows = run_temporal(facts, question, top_k)
            first = [F.asc("start")] if plan.temporal.first else [F.desc("start")] if plan.temporal.last else [F.desc("score"), F.asc("start")]
            w = Window.partitionBy("video_id").orderBy(*first, "modality", F.col("ref_ids"))
            base = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_k)
        there = {r["modality"] for r in facts.select("modality").distinct().collect()}
        missing = () if plan.intent in ANY_EVIDENCE else tuple(m for m in plan.modalities if m not in there)
        return Answer(question, plan, X.search_graph(facts, question, top_k=top_k, base=base), top_k, min_score, missing)

    def at(self, ts: float, window: float = 0.0) -> DataFrame:
        """Facts that cover an instant, modality order, then time."""
        rank = F.array_position(F.array(*map(F.lit, MODALITIES)), F.col("modality"))
        rows = self.facts.where((F.col("start") - window <= ts) & (F.lit(ts) <= F.col("end") + window))
        return rows.withColumn("score", F.lit(1.0)).orderBy(rank, "start", "fact_id")

    def timeline(self, start: float | None = None, end: float | None = None, modalities: list[str] | None = None) -> DataFrame:
        """Facts in a closed range in time order; an inverted range is empty."""
        lo, hi = F.lit(start).cast("double"), F.lit(end).cast("double")
        rows = self.facts.where(closed(F.col("start"), F.col("end"), lo, hi) & F.coalesce(lo <= hi, F.lit(True)))
        return (rows if modalities is None else rows.where(F.col("modality").isin(*modalities))).orderBy("video_id", "start", "fact_id")

    def durations(self) -> DataFrame:
        return self.facts.groupBy("video_id").agg(F.max("end").alias("duration"))

    def entities(self) -> DataFrame:
        return E.top_entities(E.concepts(self.facts))

    def entity_timeline(self, name: str) -> DataFrame:
        """Occurrences of a name in time order: exact ones, or those that contain it where there is none."""
        wanted = normal_name(F.lit(name))
        m = E.mentions(self.facts)
        exact = m.where(F.col("name") == wanted)
        return (m.where(F.col("name").contains(wanted)) if exact.isEmpty() else exact).orderBy("video_id", "start", "fact_id")

    def compare(self, a: str, b: str) -> DataFrame:
        e = E.concepts(self.facts.where(F.col("video_id").isin(a, b)))
        return E.compare(e.where(F.col("video_id") == a), e.where(F.col("video_id") == b))

    def silences(self) -> DataFrame:
        return T.silence_gaps(self.facts.where("modality = 'transcript'"), self.durations(), self.settings.min_silence)

    def chains(self) -> DataFrame:
        return T.event_chains(self.facts.where("modality = 'events'"), self.settings.chain_gap)

    def chapters(self, scenes: DataFrame | None = None) -> DataFrame:
        d = self.durations()
        cut = T.tile_chapters(d, self.settings.chapter_seconds) if scenes is None else T.cut_chapters(scenes, d, self.settings.chapter_seconds)
        return T.chapter_titles(cut, self.facts)

    def states(self) -> DataFrame:
        return T.states(self.facts.where("modality = 'ocr'"))

    def graph(self, scenes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the whole evidence graph: facts, entities and their occurrences, changes, states, chapters,
        scenes and rule events. Scenes are by default cut where screen texts begin."""
        return whole_graph(self.facts, self.durations(), scenes, self.settings.chapter_seconds)

    def search_graph(self, query: str, hops: int = 1, top_k: int = 10) -> DataFrame:
        """The ledger of each recording's evidence for a question, what was left out included."""
        return X.search_graph(self.facts, query, hops, top_k)

    def package(self, query: str, max_spans: int = 10, seconds: float = 600.0) -> DataFrame:
        """One JSON package for each recording: the query's spans within the budgets."""
        spans = self.search(query, top_k=0).withColumn("span_id", F.array_join("ref_ids", "+"))
        kept = P.seconds_budget(P.anchors_first(P.drop_contained(spans), max_spans), seconds).where("kept")
        return P.package_json(kept)

    def receipt(self) -> DataFrame:
        """How many facts of each modality each recording has, zeros included."""
        return self.facts.groupBy("video_id").agg(*[F.count_if(F.col("modality") == m).alias(m) for m in MODALITIES])

    @staticmethod
    def plan(question: str):
        return build_plan(question)

    @staticmethod
    def stages(task: str) -> list[tuple[str, str]]:
        return plan_stages(task)

    def classify(self, questions: DataFrame, text_col: str = "text") -> DataFrame:
        return classify_tasks(questions, text_col)

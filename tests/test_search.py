"""Graph search, paths, neighbours, contexts and answers, against plain Python and known values."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from chronofact.api import Collection
from chronofact.operators import context as C
from chronofact.operators import evidence_search as X
from chronofact.operators import graph as G
from chronofact.sources.facts import facts

FACT = "video_id string, modality string, fact_id string, start double, end double, text string, kind string, language string, confidence double"
#: A recording of a failed migration: what was said, shown and done, with confidences that are known.
BUG = [
    ("v", "transcript", "utt_0", 1.0, 6.0, "here is the login page of our app", "speaker", "en", 0.9),
    ("v", "transcript", "utt_1", 20.0, 25.0, "now I run the database migration", "speaker", "en", 0.8),
    ("v", "transcript", "utt_2", 41.0, 45.0, "let me retry the migration", "speaker", "en", 0.6),
    ("v", "ocr", "ocr_0", 0.0, 10.0, "Sign in", "app", "en", 0.95),
    ("v", "ocr", "ocr_2", 20.0, 40.0, "$ npm run migrate", "app", "en", 0.7),
    ("v", "ocr", "ocr_3", 30.0, 40.0, "ConnectionError: refused on port 5432", "app", "en", 0.5),
    ("v", "events", "evt_0", 20.0, 20.0, "command entered", "command_entered", None, None),
    ("v", "events", "evt_1", 30.0, 40.0, "error shown", "error_shown", None, None),
    ("v", "events", "evt_2", 44.0, 44.0, "command entered", "command_entered", None, None),
]


def test_edge_paths_equal_all_simple_paths(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(14)]
    rows = [(rng.choice(names), rng.choice(names), rng.choice("pq")) for _ in range(22)]
    edges = spark.createDataFrame(sorted(set(rows)), "src string, dst string, relation string")
    pairs = spark.createDataFrame([(a, b) for a, b in product(names, names)] + [("n0", "none")], "src string, dst string")
    near = {}
    for s, d, r in rows:
        for a, b in ((s, d), (d, s)):
            near.setdefault(a, {}).setdefault(b, []).append(f"{s} {r} {d}")

    def shortest(a, b, depth):
        best, front = None, [((), (a,))]
        for _ in range(depth):
            front = [((*way, min(near[at[-1]][n])), (*at, n)) for way, at in front for n in near.get(at[-1], ()) if n not in at]
            done = [x for x in front if x[1][-1] == b]
            if done:
                return list(min(done)[0])
        return best

    for depth in (1, 3, 4):
        got = {}
        for r in G.edge_paths(edges, pairs, depth).orderBy("src", "dst", "hop").collect():
            got.setdefault((r.src, r.dst), []).append(r)
        for a, b in product(names, names):
            want = shortest(a, b, depth) if a != b else None
            steps = got.get((a, b))
            assert (None if steps is None else [x.edge for x in steps]) == want, (a, b)
            if steps:
                assert steps[0].a == a and steps[-1].b == b and all(x.b == y.a for x, y in zip(steps, steps[1:]))
    assert G.edge_paths(edges.limit(0), pairs).count() == G.edge_paths(edges, pairs.limit(0)).count() == 0


@pytest.mark.parametrize("most_rows", [3, 65536])
def test_temporal_neighbors_equal_brute_force(spark, most_rows):
    rng = random.Random(2)
    rows = [(f"v{rng.randrange(2)}", f"x{i}", rng.choice([rng.uniform(0, 60), float(rng.randrange(0, 60, 5))])) for i in range(150)] + [("v0", f"y{i}", 30.0) for i in range(20)]
    nodes = spark.createDataFrame(rows, "video_id string, id string, start double")
    got = G.temporal_neighbors(nodes, nodes.where("id LIKE 'x%'"), 7.0, 6, most_rows)
    want = []
    for v, i, s in rows:
        if i[0] == "x":
            near = sorted((abs(t - s), j) for w, j, t in rows if w == v and j != i and abs(t - s) <= 7.0)[:6]
            want += [(i, j, g, n) for n, (g, j) in enumerate(near, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert G.temporal_neighbors(nodes.limit(0), nodes).count() == 0


def test_graph_search_stages_and_ledger(spark):
    rows = {r.ref_ids[0]: r for r in X.search_graph(spark.createDataFrame(BUG, FACT), "migration", hops=2, top_k=3).collect()}
    assert [(rows[i].stage, rows[i].kept) for i in ("utt_1", "utt_2")] == [("lexical", True)] * 2
    # utt_1 was said while evt_0 happened, utt_2 while evt_2; evt_1 is a step further.
    assert rows["evt_0"].stage == "graph" and rows["evt_0"].score == rows["evt_2"].score == 0.5 and rows["evt_1"].score == 0.25
    assert sorted(r["rank"] for r in rows.values()) == list(range(1, len(rows) + 1))
    assert {r.why for r in rows.values() if r["rank"] > 3} == {"rank cutoff"} and all(r.kept == (r["rank"] <= 3) for r in rows.values())
    names = [("v", "transcript", "a", 0.0, 1.0, "the Northwind project", "s", "en", 0.5), ("v", "ocr", "b", 0.5, 2.0, "Northwind budget", "s", "en", 0.5), ("v", "ocr", "c", 9.0, 9.5, "Northwind plan", "s", "en", 0.5)]
    found = X.search_graph(spark.createDataFrame(names, FACT), 'show "Northwind" now').collect()
    assert {(r.stage, tuple(r.ref_ids)) for r in found} == {("lexical", ("a",)), ("lexical", ("b",)), ("lexical", ("c",))}
    found = X.search_graph(spark.createDataFrame(names, FACT), 'the "Northwind"', base=spark.createDataFrame([], "video_id string, place int, modality string, start double, end double, text string, confidence double, score double, ref_ids array<string>")).collect()
    assert [(r.stage, r.ref_ids[0], r.score) for r in sorted(found, key=lambda r: r["rank"])] == [("entity", "a", 0.85), ("entity", "b", 0.85), ("entity", "c", 0.85)]


def test_answers_know_how_sure_they_are(spark):
    c = Collection(spark.createDataFrame(BUG, FACT))
    a = c.ask("migration", top_k=2)
    assert {tuple(r.ref_ids) for r in a.spans} == {("utt_1",), ("utt_2",)} and a.confidence() == pytest.approx(0.7) and a.outcome() == "extractive"
    assert a.text().startswith("[1] ") and "(transcript): " in a.text()
    trace = a.trace()
    assert trace["retrieved"]["lexical"] == 2 and set(trace["support"]) == {"utt_1", "utt_2"} and trace["omitted"][0]["why"] == "rank cutoff"
    assert c.ask("command entered", top_k=1).confidence() == 0.5  # events have no confidence
    before = c.ask("what happened before the ConnectionError", top_k=3)
    assert before.plan.intent == "temporal_before" and all(r.end <= 30.0 + 1e-6 for r in before.spans if r.stage == "lexical")
    none = c.ask("zebra")
    assert none.confidence() == 0.0 and none.outcome() == "insufficient_evidence" and none.spans == []
    strict = c.ask("migration", min_score=9.0)
    assert strict.spans == [] and "least score" in strict.text()
    silent = Collection(spark.createDataFrame([r for r in BUG if r[1] == "events"], FACT)).ask("compare what was said about zebra")
    assert silent.missing == ("transcript",) and silent.outcome() == "insufficient_coverage" and "transcript" in silent.text()


def test_contexts_are_cut_in_order(spark):
    text = lambda n: "x" * n
    spans = spark.createDataFrame([("v", i, text(400)) for i in range(1, 6)], "video_id string, rank int, text string")
    frames = spark.createDataFrame([("v", i, f"f{i}") for i in range(1, 6)], "video_id string, rank int, frame_id string")
    texts = spark.createDataFrame([("v", text(40), text(400), text(4000))], "video_id string, one_line string, short string, detailed string")
    # A span is 150 tokens, a frame 200, the summaries 10, 100 and 1000.
    want = {2860: (5, 5, "one_line,short,detailed"), 2859: (3, 5, "one_line,short,detailed"), 2559: (3, 3, "one_line,short,detailed"), 2159: (3, 3, "one_line,short"), 1159: (3, 3, "one_line"), 1059: (3, 0, "one_line"), 459: (0, 0, "one_line")}
    for budget, left in want.items():
        r = C.select_context(spans, frames, budget, texts).first()
        assert (r.spans, r.frames, r.summaries) == left, budget
        items = C.context_items(spans, frames, budget, texts).collect()
        count = lambda kind: sum(x.kind == kind for x in items)
        assert (count("span"), count("frame"), count("summary")) == (*left[:2], len(left[2].split(",")))
        assert sum(x.tokens for x in items) <= budget
    alone = C.select_context(spans, frames, 5000).first()
    assert (alone.spans, alone.frames, alone.summaries, alone.notes) == (5, 5, "", "")


def test_the_whole_graph_has_nodes_for_its_edges(spark, tables):
    c = Collection(facts(spark, tables).where("video_id IN ('v0', 'v1')"))
    nodes, edges = c.graph()
    ids = [r.id for r in nodes.collect()]
    assert len(ids) == len(set(ids))
    rows = edges.collect()
    assert {"SUPPORTS", "CONTAINS", "OBSERVED_IN", "APPEARS_IN", "PRECEDES"} <= {r.relation for r in rows}
    assert {x for r in rows for x in (r.src, r.dst)} <= set(ids)
    from chronofact.plans.evidence_graph import whole_graph

    few, left = whole_graph(c.facts, c.durations(), most_nodes=40, most_edges=15)
    held = few.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert all(r.n <= 40 for r in held) and few.where("NOT observed").count() == 0
    kept = {r.id for r in few.collect()}
    assert left.count() <= 30 and all(r.src in kept and r.dst in kept for r in left.collect())


def test_profiles_by_name_and_the_first_provider_that_loads(spark, tables):
    from chronofact.operators import profiles
    from chronofact.plugins import Registry

    rows = facts(spark, tables)
    assert {r.kind for r in profiles.profile("tutorial", rows).select("kind").distinct().collect()} <= {"objective", "step"}
    assert profiles.profile("ui_design", rows).columns[:3] == ["video_id", "dimension", "label"]
    with pytest.raises(KeyError, match="no profile"):
        profiles.profile("none", rows)
    with pytest.raises(KeyError, match="there is a profile"):
        profiles.register_profile("tutorial")(len)
    profiles.register_profile("counts")(lambda f: f.groupBy("video_id").count())
    assert profiles.profile("counts", rows).count() == 10 and profiles.PROFILES.pop("counts")
    r = Registry()
    r.register("ocr", "gone", "no.such.module:x")
    r.register("ocr", "plain", lambda: "reader")
    assert r.first("ocr", ["missing", "gone", "plain"]) == ("plain", "reader")
    with pytest.raises(LookupError, match="missing.*gone"):
        r.first("ocr", ["missing", "gone"])


def test_findings_on_documents(spark):
    from chronofact.operators.validation import document_rules, strict, valid_recordings

    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    docs = table([("a", "1.0"), ("b", None), ("c", " "), ("d", "1.1")], "video_id string, version string")
    stages = table([("a", "ocr"), ("a", "ocr"), ("d", "asr"), ("d", "ocr")], "video_id string, name string")
    segments = table([("a",), ("b",), ("d",), ("d",)], "video_id string")
    texts = table([("d", 1)] * 21 + [("a", 1)] * 20 + [("b", 1)] * 20 + [("b", 2)], "video_id string, frame_count int")
    found = document_rules(docs, stages, segments, texts)
    assert sorted(map(str, found.collect())) == sorted(map(str, table([("b", None, "version", "error"), ("c", None, "version", "error"), ("a", "ocr", "stages", "error"), ("b", None, "provenance", "warning"), ("d", None, "ocr_dedup", "warning")], "video_id string, fact_id string, rule string, severity string").collect()))
    assert [r.video_id for r in valid_recordings(docs, found).collect()] == ["d"] and valid_recordings(docs, strict(found)).count() == 0

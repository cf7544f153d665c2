"""Operators against plain Python, on random and hand-made facts."""

import os
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from chronofact.functions.scalars import language_tag, layout_signature
from chronofact.operators import boundaries as B
from chronofact.operators import compression as C
from chronofact.operators import context as X
from chronofact.operators import entities as E
from chronofact.operators import graph as G
from chronofact.operators import packaging as P
from chronofact.operators import profiles as F_
from chronofact.operators import retrieval as R
from chronofact.operators import temporal as T
from chronofact.operators.intervals import asof_backward, interval_join, islands, merge_windows, relations
from chronofact.operators.tracking import text_tracks
from chronofact.operators.validation import validate
from chronofact.plans import catalog_more as M
from chronofact.plans import understanding as U
from chronofact.plans.catalog_planning import QUESTIONS
from chronofact.plans.questions import OUT, read_questions
from chronofact.plans.questions import sql as question_sql
from chronofact.session import global_rank, shared_dir

FACT = "video_id string, modality string, fact_id string, start double, end double, text string, kind string, language string, confidence double"


def spans(seed, n, videos=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice([rng.uniform(0, 100), float(rng.randrange(0, 100, 10))])
        out.append((f"v{rng.randrange(videos)}", f"f{i:03d}", s, s + rng.choice([0.0, 0.5, 10.0, rng.uniform(0, 40)])))
    return out


ROW = "video_id string, fact_id string, start double, end double"


@pytest.mark.parametrize("kind,tol,width", [("strict", 0.0, 10.0), ("closed", 0.0, 10.0), ("strict", 1.0, 7.0), ("closed", 2.5, 50.0)])
def test_interval_join_equals_the_nested_loop(spark, kind, tol, width):
    a, b = spans(1, 120), spans(2, 120)
    out = interval_join(spark.createDataFrame(a, ROW), spark.createDataFrame(b, ROW), ["video_id"], width, tol, kind)
    got = {(r.l_fact_id, r.r_fact_id) for r in out.collect()}
    meet = (lambda p, q: p[2] < q[3] + tol and q[2] < p[3] + tol) if kind == "strict" else (lambda p, q: p[3] + tol >= q[2] and p[2] - tol <= q[3])
    assert got == {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and meet(p, q)}
    assert out.count() == len(got)


@pytest.mark.parametrize("running", [True, False])
def test_islands_equal_a_fold(spark, running):
    rows = spans(3, 150)
    got = {r.fact_id: (r.video_id, r.island) for r in islands(spark.createDataFrame(rows, ROW), ["video_id"], 2.0, ("start", "end", "fact_id"), running=running).collect()}
    want = {}
    for v in {r[0] for r in rows}:
        n, end = 0, None
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[3], r[1])):
            if end is None or r[2] - end > 2.0:
                n += 1
            end = r[3] if end is None or not running else max(end, r[3])
            want[r[1]] = (v, n)
    assert got == want


def test_merging_windows_twice_changes_nothing(spark):
    once = merge_windows(spark.createDataFrame(spans(4, 80), ROW).select("video_id", "start", "end"), ["video_id"])
    key = lambda df: sorted((r.video_id, r.start, r.end) for r in df.collect())
    assert key(once) == key(merge_windows(once, ["video_id"]))


@pytest.mark.parametrize("a,b,has,lacks", [
    ((0, 5), (10, 15), {"BEFORE", "PRECEDES"}, {"OVERLAPS", "AFTER"}), ((9.5, 19), (10, 20), {"DURING", "OVERLAPS"}, {"BEFORE"}), ((0, 9.5), (10, 20), {"CO_OCCURS", "PRECEDES"}, {"OVERLAPS"}),
    ((10, 10), (10, 10), {"DURING", "CONTAINS"}, {"OVERLAPS"}), ((0, 2), (6, 8), {"NEAR"}, {"CO_OCCURS"}),
])
def test_relations(spark, a, b, has, lacks):
    got = set(spark.range(1).select(relations(*[F.lit(float(x)) for x in (*a, *b)]).alias("r")).first()["r"])
    assert has <= got and not lacks & got


def test_asof_takes_the_last_row_before(spark):
    left, right = spans(5, 60), spans(6, 60)
    got = {r.fact_id: r.r_fact_id for r in asof_backward(spark.createDataFrame(left, ROW), spark.createDataFrame(right, ROW), ["video_id"], "start", "start", ["fact_id"], ["fact_id"]).collect()}
    for v, i, s, _ in left:
        before = [r for r in right if r[0] == v and r[2] <= s]
        assert got[i] == (max(before, key=lambda r: (r[2], r[1]))[1] if before else None)


def test_global_rank_of_hot_null_and_tied_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(20), i) for i in range(2000)]
    got = global_rank(spark.createDataFrame(rows, "g string, x int, id long"), ["g"], ["x", "id"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["rank"], r.x, r.id) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def fact(i, modality, start, end, text, video="v", kind=None, confidence=None):
    return (video, modality, i, float(start), float(end), text, kind, None, confidence)


#: A short recording: speech, screen texts, commands and an error.
BUG = [
    fact("utt_0", "transcript", 1, 6, "here is the login page of our app"), fact("utt_1", "transcript", 20, 25, "now I run the database migration"), fact("utt_2", "transcript", 41, 45, "let me retry the migration"),
    fact("ocr_1", "ocr", 0, 10, "Sign in"), fact("ocr_2", "ocr", 20, 40, "$ npm run migrate"), fact("ocr_3", "ocr", 30, 40, "ConnectionError: refused on port 5432"), fact("ocr_4", "ocr", 44, 50, "$ npm run migrate --retry"),
]


def test_search_ranks_and_copies_times(spark):
    facts = spark.createDataFrame(BUG, FACT)
    top = R.search(facts, "database migration").collect()
    assert top[0].ref_ids == ["utt_1"] and (top[0].start, top[0].end) == (20.0, 25.0)
    times = {f[2]: (f[3], f[4]) for f in BUG}
    for r in top:
        assert r.start == min(times[i][0] for i in r.ref_ids) and r.end == max(times[i][1] for i in r.ref_ids)
    assert R.search(facts, "zebra").count() == 0 and R.search(facts, "?!").count() == 0
    late = R.search(facts, "migration", start=40.0).collect()
    assert [r.ref_ids for r in late] == [["utt_2"]] and {r.modality for r in R.search(facts, "migrate", ["ocr"]).collect()} == {"ocr"}


def test_single_hit_scores_as_rank_one_with_its_boost(spark):
    rows = [fact("o", "ocr", 0, 5, "revenue grew"), fact("u", "transcript", 4, 8, "revenue is up")]
    assert {round(r.score, 7) for r in R.search(spark.createDataFrame(rows, FACT), "revenue").collect()} == {round(1.25 / 61, 7)}


def test_rule_events(spark):
    scenes = spark.createDataFrame([("v", 0.0, 20.0), ("v", 20.0, 55.0)], "video_id string, start double, end double")
    got = {(r.type, r.start, r.ref, r.detail) for r in T.rule_events(spark.createDataFrame(BUG, FACT), scenes).collect()}
    assert ("scene_changed", 20.0, None, None) in got and ("command_entered", 20.0, "ocr_2", "npm run migrate") in got and ("error_shown", 30.0, "ocr_3", "exception") in got
    assert sum(t == "text_appeared" for t, *_ in got) == 4 and sum(t == "text_disappeared" for t, *_ in got) == 4


def test_silences_speech_and_chains(spark):
    u = spark.createDataFrame([f[:1] + f[2:5] for f in BUG if f[1] == "transcript"], ROW)
    d = spark.createDataFrame([("v", 60.0)], "video_id string, duration double")
    gaps = T.silence_gaps(u, d)
    assert sorted((r.start, r.end) for r in gaps.collect()) == [(6.0, 20.0), (25.0, 41.0), (45.0, 60.0)]
    assert sorted((r.start, r.end) for r in T.speech_spans(gaps, d).collect()) == [(0.0, 6.0), (20.0, 25.0), (41.0, 45.0)]
    events = spark.createDataFrame([("v", f"e{i}", float(t), float(t), "k") for i, t in enumerate((0, 100, 221, 500, 501))], ROW + ", kind string")
    assert sorted((r.start, r.end, r.events) for r in T.event_chains(events).collect()) == [(0.0, 100.0, 2), (500.0, 501.0, 2)]


def test_changes_between_regions(spark):
    def kinds(facts, regions):
        r = spark.createDataFrame([("v", i, float(a), float(b)) for i, (a, b) in enumerate(regions)], "video_id string, region int, start double, end double")
        return [(x.ts, x.change_type) for x in T.change_points(r, spark.createDataFrame(facts, FACT)).orderBy("ts").collect()]

    assert kinds([fact("a", "ocr", 0, 60, "alpha beta"), fact("b", "ocr", 60, 120, "gamma delta")], [(0, 60), (60, 120)]) == [(60.0, "text_changed")]
    assert kinds([fact("u", "transcript", 70, 80, "hello")], [(0, 60), (60, 120)]) == [(60.0, "speech_started")]
    assert kinds([fact("u", "transcript", 10, 20, "hello")], [(0, 60), (60, 120)]) == [(60.0, "speech_ended")]
    assert kinds([fact("a", "ocr", 0, 120, "alpha beta")], [(0, 60), (60, 120)]) == [(60.0, "scene_transition")]


def test_chapters(spark):
    d = spark.createDataFrame([("v", 600.0)], "video_id string, duration double")
    tiles = T.tile_chapters(d)
    assert [(r.start, r.end) for r in tiles.orderBy("start").collect()] == [(0.0, 300.0), (300.0, 600.0)]
    titled = T.chapter_titles(tiles, spark.createDataFrame([fact("a", "ocr", 0, 5, "Pricing pricing table 99"), fact("b", "transcript", 1, 9, "the pricing plan")], FACT))
    assert [r.title for r in titled.orderBy("start").collect()] == ["Pricing · Plan · Table", "Part 2"]
    scenes = spark.createDataFrame([("v", float(s), s + 50.0) for s in range(0, 600, 50)], "video_id string, start double, end double")
    cut = [(r.start, r.end) for r in T.cut_chapters(scenes, d, 120.0).orderBy("start").collect()]
    assert cut == [(0.0, 150.0), (150.0, 300.0), (300.0, 450.0), (450.0, 600.0)]


def test_states(spark):
    rows = [("v", "a", 0.0, 30.0), ("v", "b", 30.0, 60.0), ("v", "c", 30.0, 31.0)]
    got = [(r.start, r.end, r.evidence_ids) for r in T.states(spark.createDataFrame(rows, ROW)).orderBy("start").collect()]
    assert got == [(0.0, 31.0, "a,b,c"), (31.0, 60.0, "b")]


def test_segments_tile_and_hold_every_fact(spark):
    rng = random.Random(9)
    cuts = sorted({0.0, *(rng.uniform(1, 300) for _ in range(7))})
    scenes = spark.createDataFrame([("v", a, b) for a, b in zip(cuts, [*cuts[1:], 300.0], strict=True)], "video_id string, start double, end double")
    segments = T.plan_segments(scenes)
    for s in (segments, T.merge_short(segments)):
        rows = [(r.start, r.end) for r in s.orderBy("segment").collect()]
        assert rows[0][0] == 0.0 and abs(rows[-1][1] - 300.0) < 1e-9 and all(abs(x[1] - y[0]) < 1e-9 for x, y in zip(rows, rows[1:], strict=False))
    assert all(b - a <= 45 + 1e-9 for a, b in [(r.start, r.end) for r in segments.collect()])
    facts = [fact(f"f{i}", "ocr", s := rng.uniform(0, 300), min(300.0, s + rng.choice([0, 5])), "x") for i in range(50)] + [fact("end", "ocr", 300, 300, "x")]
    assert {r.fact_id for r in T.segment_members(segments, spark.createDataFrame(facts, FACT)).collect()} == {f[2] for f in facts}


def test_rates(spark):
    w = spark.createDataFrame([("v", 0.0, 10.0, 1.0, "base"), ("v", 4.0, 6.0, 4.0, "burst")], "video_id string, start double, end double, fps double, reason string")
    flat = [(r.start, r.end, r.fps) for r in T.flatten_rates(w).orderBy("start").collect()]
    assert flat == [(0.0, 4.0, 1.0), (4.0, 6.0, 4.0), (6.0, 10.0, 1.0)]
    fit = T.fit_budget(w, 9).collect()
    assert abs(sum((r.end - r.start) * r.fps for r in fit) - 9) < 1e-9


def test_utterances_are_normalised(spark):
    rows = [("v", 5.0, 2.0, " a  b "), ("v", -1.0, 99.0, "c"), ("v", 1.0, 2.0, "  ")]
    d = spark.createDataFrame([("v", 10.0)], "video_id string, duration double")
    got = [(r.id, r.start, r.end, r.text) for r in T.normal_utterances(spark.createDataFrame(rows, "video_id string, start double, end double, text string"), d).orderBy("id").collect()]
    assert got == [("utt_0000", 0.0, 10.0, "c"), ("utt_0001", 2.0, 5.0, "a b")]


def test_concepts_link_over_modalities(spark):
    rows = [fact("o", "ocr", 861, 867, "see Acme Corp today"), fact("u", "transcript", 858, 869, "so Acme Corp said"), fact("x", "ocr", 0, 1, "Lonely Name"), fact("p", "ocr", 10, 11, "Beta Inc"), fact("q", "ocr", 30, 31, "Beta Inc")]
    got = {r.name: (r.confidence, r.ambiguous, r.modalities) for r in E.concepts(spark.createDataFrame(rows, FACT)).collect()}
    assert got["acme corp"] == (0.85, False, "ocr,transcript") and got["beta inc"] == (0.5, True, "ocr") and "lonely name" not in got


def test_similar_names(spark):
    e = spark.createDataFrame([("v", "connection error"), ("v", "connexion error"), ("v", "other thing")], "video_id string, name string")
    assert [(r.a, r.b) for r in E.similar_names(e).collect()] == [("connection error", "connexion error")]


def test_graph_traversal_is_bounded(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "PRECEDES", 1.0) for i in range(6)], "src string, dst string, relation string, confidence double")
    hops = lambda a, b, d=4: G.shortest_hops(edges, a, b, d).first()["hops"]
    assert hops("n0", "n3") == 3 and hops("n3", "n0") == 3 and hops("n0", "n6") is None
    assert {r.id for r in G.neighbors(edges, "n2").collect()} == {"n1", "n3"} and G.neighbors(edges, "n2", "NEAR").count() == 0


def test_budgets_and_spacing_equal_folds(spark):
    rng = random.Random(11)
    rows = [(f"v{i % 3}", f"s{i:02d}", i // 3 + 1, 0.0, rng.uniform(1, 30)) for i in range(60)]
    got = {r.span_id: r.kept for r in P.seconds_budget(spark.createDataFrame(rows, "video_id string, span_id string, rank int, start double, end double"), 60.0).collect()}
    for v in ("v0", "v1", "v2"):
        used, first = 0.0, True
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: r[2]):
            keep = first or used + r[4] <= 60.0
            used, first = used + r[4] * keep, False
            assert got[r[1]] == keep
    points = [("v", float(rng.randrange(100)), rng.random()) for _ in range(40)]
    kept = []
    for _, ts, _ in sorted(points, key=lambda p: (-p[2], p[1])):
        if all(abs(ts - k) >= 5 for k in kept):
            kept.append(ts)
    assert sorted(r.ts for r in P.spaced(spark.createDataFrame(points, "video_id string, ts double, score double"), 5.0, ["video_id"]).collect()) == sorted(kept)


def test_tracks(spark):
    obs = [("v", 0.0, "Sign in"), ("v", 1.0, "Sign in"), ("v", 2.0, "sign  in"), ("v", 5.0, "Other")]
    none = [None] * 4
    o = spark.createDataFrame([(*x, 0.9, *none) for x in obs], "video_id string, ts double, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    frames = spark.createDataFrame([("v", float(t)) for t in range(6)], "video_id string, ts double")
    d = spark.createDataFrame([("v", 10.0)], "video_id string, duration double")
    got = [(r.text, r.start, r.end, r.last_ts, r.frame_count, r.stable) for r in text_tracks(o, frames, d).orderBy("start").collect()]
    assert got == [("sign  in", 0.0, 2.5, 2.0, 3, True), ("Other", 5.0, 10.0, 5.0, 1, False)]


def test_validation(spark):
    rows = [fact("a", "ocr", 0, 5, "x"), fact("a", "ocr", 1, 2, "x"), fact("b", "ocr", 5, 3, "x"), fact("c", "ocr", 0, 99, "x", confidence=2.0)]
    d = spark.createDataFrame([("v", 10.0)], "video_id string, duration double")
    refs = spark.createDataFrame([("v", "a"), ("v", "gone")], "video_id string, ref string")
    got = {(r.fact_id, r.rule) for r in validate(spark.createDataFrame(rows, FACT), d, refs).collect()}
    assert got == {("a", "unique_id"), ("b", "ordering"), ("c", "bounds"), ("c", "confidence"), ("gone", "dangling_ref")}


def test_compression(spark):
    rows = [("v", 0.0, 1.0, "d1", ["a", "b"], ["x"]), ("v", 1.0, 2.0, "d2", ["a", "b"], ["x"]), ("v", 2.0, 3.0, "d3", ["c"], ["y"])]
    states = C.visual_states(spark.createDataFrame(rows, "video_id string, start double, end double, description string, entities array<string>, actions array<string>"))
    assert [(r.start, r.end, r.moments) for r in states.orderBy("state").collect()] == [(0.0, 2.0, 2), (2.0, 3.0, 1)]
    assert sorted((r.change, r.entity) for r in C.state_changes(states).collect()) == [("appeared", "c"), ("disappeared", "a"), ("disappeared", "b")]


@pytest.mark.parametrize("q,want", [
    ("error between 01:30 and 02:00", ("error", None, 90.0, 120.0)), ("from 0:10 to 0:50 pricing", ("pricing", None, 10.0, 50.0)), ("what happened before the crash?", ("the crash", "BEFORE", None, None)),
    ("before the zebra", ("before the zebra", None, None, None)), ("pricing at 12:20", ("pricing at", None, 710.0, 770.0)), ("what was shown during the demo", ("what was shown the demo", "DURING", None, None)),
])
def test_temporal_phrasing(spark, q, want):
    t = U.build_plan(q).temporal
    assert (t.anchor, t.relation, t.start, t.end) == want


def test_gap_words_and_order_words(spark):
    t = lambda q: U.build_plan(q).temporal
    assert t("what happened immediately after the login").max_gap == 10.0
    assert t("find the first mention of revenue").first and t("last occurrence of pricing").anchor == "of pricing"
    assert t("what happened between the login and the error").anchor_b == "the error"
    assert t("what happened around the crash").radius == 30.0 and t("the crash").radius is None


@pytest.mark.parametrize("q,want", [
    ("compare both videos", "cross_video_comparison"), ("which videos mention pricing", "multi_video_search"), ("old vs new design", "comparison"), ("summarize it", "general_summary"), ("find the invoice", "fact_lookup"),
    ("what happened after the login", "temporal_after"), ("show me the evidence", "evidence_request"), ("step by step", "event_sequence"), ("what changed here", "change_detection"), ("timeline of revenue", "entity_timeline"),
])
def test_intents(spark, q, want):
    assert U.build_plan(q).intent == want


def test_questions_run(spark):
    facts = spark.createDataFrame(BUG, FACT)
    plan, rows = U.run_temporal(facts, "what happened before the ConnectionError")
    assert plan.intent == "temporal_before" and {r.start for r in rows.collect()} <= {0.0, 1.0, 20.0} and rows.count() >= 2
    plan, rows = U.run_temporal(facts, "what happened after zebra")
    assert rows.count() == 0 and "zebra" in plan.notes[0]
    plan, rows = U.run_temporal(facts, "first migration")
    assert rows.first().start == 20.0
    assert [s for s, _ in U.plan_stages("what was said")] == ["audio", "asr", "segments"]


def test_tasks(spark):
    rows = spark.createDataFrame([("summarize this",), ("recreate this visual style",), ("xyz",)], "text string")
    got = {r.text: (r.task, r.confidence) for r in U.classify_tasks(rows).collect()}
    assert got["summarize this"] == ("summary", 0.2) and got["xyz"] == ("global_understanding", 0.3) and got["recreate this visual style"][0] == "design_analysis"


def test_names_merge_by_shared_word_and_moment(spark):
    rows = [
        ("v", "ocr", "a", 0.0, 5.0, "Stripe Dashboard"), ("v", "transcript", "b", 4.0, 6.0, "Stripe Dashboard Export"), ("v", "ocr", "c", 6.5, 7.0, "Export Wizard"),
        ("v", "ocr", "d", 50.0, 51.0, "Stripe Account"), ("v", "ocr", "e", 0.0, 1.0, "Api Key"), ("v", "ocr", "f", 0.0, 1.0, "Api Log"), ("w", "ocr", "g", 0.0, 1.0, "Stripe Dashboard"),
    ]
    m = E.mentions(spark.createDataFrame(rows, "video_id string, modality string, fact_id string, start double, end double, text string"))
    got = {(r.video_id, r.surface): r.name for r in E.merged(m).collect()}
    assert got["v", "Stripe Dashboard"] == got["v", "Stripe Dashboard Export"] == got["v", "Export Wizard"] == "export wizard"
    assert got["v", "Stripe Account"] == "stripe account"  # too far in time
    assert got["v", "Api Key"] == "api key" and got["v", "Api Log"] == "api log"  # their word is too short
    assert got["w", "Stripe Dashboard"] == "stripe dashboard"
    entity = E.rolled_up(E.merged(m)).where("name = 'export wizard'").first()
    assert entity.display == "Stripe Dashboard Export" and entity.occurrences == 3 and entity.confidence == 0.85 and not entity.ambiguous
    assert E.merged(m.limit(0)).count() == 0
    close = [("v", "ocr", "a", 0.0, 5.0, "Postgres"), ("v", "ocr", "b", 4.0, 6.0, "Postgress"), ("v", "ocr", "c", 90.0, 96.0, "Postgred")]
    p = E.mentions(spark.createDataFrame(close, "video_id string, modality string, fact_id string, start double, end double, text string"))
    assert sorted(r.name for r in E.merged(p, 0.9).collect()) == ["postgred", "postgres", "postgres"]


def test_close_boundaries_are_decided(spark):
    def kept(cuts, duration=20.0):
        rows = [("v", float(t), float(s), sig, duration) for t, s, sig in cuts]
        out = B.boundary_spans(B.arbitrated(spark.createDataFrame(rows, "video_id string, ts double, score double, signal string, duration double")))
        return [(r.start, r.end, r.score, r.signals) for r in out.orderBy("start").collect()]

    assert kept([(5, 0.5, "cut")]) == [(0.0, 5.0, None, "start"), (5.0, 20.0, 0.5, "cut")]
    assert kept([(5, 0.5, "a"), (5.04, 0.7, "b")])[1] == (5.0, 20.0, 0.7, "a+b")  # one instant
    assert kept([(5, 0.95, "a"), (5.9, 0.92, "a")])[1] == (5.9, 20.0, 0.92, "a+flash")  # a flash: the later
    assert kept([(5, 0.5, "a"), (5.9, 0.6, "a")])[1] == (5.9, 20.0, 0.6, "a")
    assert kept([(5, 0.6, "a"), (5.9, 0.6, "a")])[1] == (5.0, 20.0, 0.6, "a")  # ties: the earlier
    assert kept([(0, 1.0, "a"), (25, 1.0, "a")]) == [(0.0, 20.0, None, "start")]
    many = [("v", float(i), i / 100, "a") for i in range(1, 20)] + [("v", 30.0, 0.9, "b")]
    found = B.budgeted(spark.createDataFrame(many, "video_id string, ts double, score double, signal string"), spark.createDataFrame([("v", 60.0)], "video_id string, duration double"))
    assert sorted(r.ts for r in found.collect()) == [17.0, 18.0, 19.0, 30.0]


def test_windows_of_one_rate_join_and_cuts_spare_sentences(spark):
    rows = [("v", 0.0, 2.0, 1.0, "a"), ("v", 2.5, 4.0, 1.0, "b"), ("v", 4.0, 5.0, 2.0, "a"), ("v", 5.0, 6.0, 1.0, "a"), ("v", 8.0, 9.0, 1.0, "a")]
    got = B.same_rate_windows(spark.createDataFrame(rows, "video_id string, start double, end double, fps double, reason string")).orderBy("start").collect()
    assert [(r.start, r.end, r.fps, r.reason) for r in got] == [(0.0, 4.0, 1.0, "mixed"), (4.0, 5.0, 2.0, "a"), (5.0, 6.0, 1.0, "a"), (8.0, 9.0, 1.0, "a")]
    scenes = spark.createDataFrame([("v", 0.0, 100.0)], "video_id string, start double, end double")
    said = spark.createDataFrame([("v", "a", 0.0, 48.0), ("v", "b", 52.0, 90.0)], "video_id string, fact_id string, start double, end double")
    cut = lambda longest: [(r.start, r.end) for r in B.snapped_segments(scenes, said, longest).orderBy("start").collect()]
    assert cut(50.0) == [(0.0, 50.0), (50.0, 100.0)] and cut(100.0) == [(0.0, 100.0)]
    assert cut(49.0) == [(0.0, 100 / 3), (100 / 3, 200 / 3), (200 / 3, 100.0)]
    near = spark.createDataFrame([("v", "a", 0.0, 47.0), ("v", "b", 50.0, 90.0)], "video_id string, fact_id string, start double, end double")
    assert [r.start for r in B.snapped_segments(scenes, near, 50.0).orderBy("start").collect()] == [0.0, 48.5]


def test_frames_and_budgets_of_context(spark):
    frames = spark.createDataFrame([("v", "f1", 0.0, "scene_change"), ("v", "f2", 3.0, "keyframe"), ("v", "f3", 9.0, "motion"), ("v", "f4", 30.0, "other")], "video_id string, frame_id string, ts double, reason string")
    shown = spark.createDataFrame([("v", "ocr", 2.0, 4.0, "The login error"), ("v", "vision", 8.0, 9.0, "a login page")], "video_id string, modality string, start double, end double, text string")
    scored = X.frame_scores(frames, shown, "login error of")
    assert {r.frame_id: r.score for r in scored.collect()} == {"f1": 10, "f2": 12, "f3": 10, "f4": 0}
    assert [(r.frame_id, r["rank"]) for r in X.representative_frames(scored).orderBy("rank").collect()] == [("f2", 1), ("f3", 2), ("f4", 3)]
    assert [r.frame_id for r in X.representative_frames(scored, 1).collect()] == ["f2"]
    spans = spark.createDataFrame([("v", i, "x" * 400) for i in range(1, 7)], "video_id string, rank int, text string")
    held = lambda budget: X.select_context(spans, X.representative_frames(scored), budget).first()
    for budget, want in ((2000, (6, 3)), (1100, (3, 3)), (500, (3, 0)), (100, (0, 0))):
        assert (held(budget).spans, held(budget).frames) == want
    assert held(2000).notes == "" and held(1100).notes == "spans 6 to 3"


def test_paths_language_tags_and_layouts(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("a", "e"), ("e", "d"), ("x", "y")], "src string, dst string").withColumns({"relation": F.lit("R"), "confidence": F.lit(1.0)})
    assert [tuple(r) for r in G.shortest_path(edges, "a", "d").orderBy("hop").collect()] == [(1, "a", "e"), (2, "e", "d")]
    assert G.shortest_path(edges, "a", "x").count() == 0 and G.shortest_path(edges, "a", "d", 1).count() == 0
    proof = spark.createDataFrame([("D1", "D2"), ("D2", "D3"), ("D3", "o1"), ("o1", "D9"), ("D1", "o2"), ("D3", "D4"), ("D4", "o4")], "src string, dst string").withColumn("relation", F.lit("SUPPORTS"))
    found = {(r.origin, r.id) for r in G.evidence_of(proof, lambda c: c.startswith("D")).collect()}
    assert {i for o, i in found if o == "D1"} == {"o1", "o2"} and {i for o, i in found if o == "D9"} == {"o1"} and {i for o, i in found if o == "D3"} == {"o1", "o2", "o4"}
    tag = lambda *codes: spark.range(1).select(language_tag(F.array(*map(F.lit, codes))).alias("t")).first().t
    assert [tag("eng"), tag("eng", "hin"), tag("chi_sim_vert"), tag("osd", "DEU"), tag("osd"), tag("xyz")] == ["en", None, "zh-Hans", "de", None, "xyz"]
    e = spark.createDataFrame([([(0.0, 0.0, 0.2, 0.2, "a"), (900.0, 900.0, 1000.0, 1000.0, "b"), (None, None, None, None, "x" * 45)],)], "e array<struct<x1:double,y1:double,x2:double,y2:double,text:string>>")
    assert e.select(layout_signature(F.col("e")).alias("s")).first().s == "3:00,22,L2"


def test_questions_as_columns_equal_the_sql(spark):
    rng = random.Random(1)
    bits = ["what happened", "before", "after", "immediately", "right after", "between", "and", "from", "to", "1:20", "2:30", "1:02:03.5", "while", "during", "around", "first", "last", "the error", "login?", "video", "compare", "time", "show me", "speech", "which videos", ","]
    asked = [*QUESTIONS, "", "  x  ", "first around while", *(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(1500))]
    rows = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    con = duckdb.connect()
    con.register("asked", rows.toArrow())
    want = con.sql(question_sql("asked")).project(", ".join(f'"{c}"' for c in ("item_id", "question", *OUT))).fetchall()
    got = [tuple(r) for r in read_questions(rows).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(asked)
    for r in rng.sample(got, 40):
        assert r[9] == ",".join(s for s, _ in U.plan_stages(r[1]))
    assert read_questions(spark.createDataFrame([(None,)], "text string")).first().intent == "fact_lookup"
    assert read_questions(spark.createDataFrame([], "text string")).count() == 0


@pytest.mark.parametrize("least", [0.75, 0.88, 0.95])
def test_no_pair_of_alike_names_is_missed(spark, least):
    """The similarity join against all pairs, on random names, names with repeats and names a few edits apart."""
    rng = random.Random(int(100 * least))
    names = {"a", "b", "ab", "ba", "aa", "aaaa", "aaaaa", "abab abab", "x" * 40, "x" * 41, "ü", "connection error", "connection errors", "conection error"}
    while len(names) < 220:
        w = "".join(rng.choice("abcd e") for _ in range(rng.randint(1, 24))).strip()
        names.add(w)
        for _ in range(2):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randint(0, len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "f"])
            names.add("".join(x).strip())
    names.discard("")
    rows = [(f"v{i % 2}", n) for i, n in enumerate(sorted(names))] + [("v0", "aa"), ("v0", "aa")]
    got = {(r.video_id, r.a, r.b) for r in E.similar_names(spark.createDataFrame(rows, "video_id string, name string"), least, shared=False).collect()}
    ratio = lambda a, b: 0.0 if min(len(a), len(b)) < 0.5 * max(len(a), len(b)) else SequenceMatcher(None, a, b).ratio()
    want = {(v, a, b) for v, a in set(rows) for w, b in set(rows) if v == w and a < b and ratio(a, b) >= least}
    assert got == want and len(want) > 5


def test_profiles_by_one_automaton(spark):
    rows = [("v", "transcript", "a", 1.0, 2.0, "First, open the Dark Mode panel. Then save it. ok", None, None, None), ("v", "ocr", "b", 5.0, 6.0, None, None, None, None), ("v", "ocr", "c", 0.0, 1.0, "a concept called Event Sourcing and CQRS", None, None, None)]
    df = spark.createDataFrame(rows, FACT)
    labels = {"x": ("ab", "abc"), "y": ("bc",), "z": ("ÄÖ",), "none": ("q",)}
    texts = spark.createDataFrame([("xabcx",), ("AB",), ("äö",), ("",), (None,), ("b c",)], "text string")
    assert [r.found for r in F_.labelled(texts, labels).collect()] == [["x", "y"], ["x"], ["z"], [], [], []]
    assert {(r.label, r.n, r.first_seen) for r in F_.keyword_profile(df, {"style": {"dark": ("dark", "dark mode"), "light": ("light",)}}).collect()} == {("dark", 1, 1.0)}
    lists = [(r.kind, r.sentence, r["rank"]) for r in F_.profile_lists(df).orderBy("kind", "rank").collect()]
    assert lists == [("step", "first, open the dark mode panel", 1), ("step", "then save it", 2)]
    assert [r.concept for r in F_.key_concepts(df).orderBy("rank").collect()] == ["Event Sourcing"]
    assert F_.keyword_profile(df.limit(0)).count() == 0


def test_rendered_packages(spark):
    shown = spark.createDataFrame(
        [("v1", "ocr", 2, 5.0, 5.0, "x" * 400), ("v1", "transcript", 1, 0.0, 61.5, "spoken\nline"), ("v2", "events", 1, 3.0, 4.0, None)],
        "video_id string, modality string, rank int, start double, end double, text string",
    )
    omitted = spark.createDataFrame([("v1", 3), ("v2", 0)], "video_id string, n long")
    got = {r.video_id: r.package for r in P.package_text(shown, "why", "timeline", omitted).collect()}
    said = "00:00:00.000 → 00:01:01.500"
    assert got["v1"] == f"QUERY: why\nINTENT: timeline\n[1] {said} (transcript): spoken\nline\n[2] 00:00:05.000 (ocr): {'x' * 200}\n[omitted 3 spans — see package]"
    assert got["v2"] == "QUERY: why\nINTENT: timeline\n[1] 00:00:03.000 → 00:00:04.000 (events): "
    ranges = P.relevant_ranges(shown.where("video_id = 'v1'"), spark.createDataFrame([("v1", 60.0)], "video_id string, duration double"))
    got = {r.video_id: r.package for r in P.package_markdown(shown, "why", ranges=ranges).collect()}
    assert got["v1"] == f"# Context: why\n\n**Ranges:** 00:00:00.000 → 00:01:00.000\n\n## Evidence\n1. **{said}** (transcript) — spoken\nline\n2. **00:00:05.000** (ocr) — {'x' * 300}"
    assert got["v2"] == "# Context: why\n\n\n## Evidence\n1. **00:00:03.000 → 00:00:04.000** (events) — "
    assert P.package_text(shown.limit(0), "why").count() == P.package_markdown(shown.limit(0), "why").count() == 0


def test_ranges_are_rounded_as_in_sql(spark):
    at = [k + m / 1000 + 0.0005 for k in range(0, 600, 7) for m in range(0, 1000, 83)]
    shown = spark.createDataFrame([(f"v{i}", t, t) for i, t in enumerate(at)], "video_id string, start double, end double")
    got = P.relevant_ranges(shown, shown.select("video_id", (F.col("end") + 9).alias("duration")))
    want = duckdb.sql(f"SELECT 'v' || i, round(greatest(0, t - 5), 3), round(t + 5, 3) FROM (SELECT unnest({at}::DOUBLE[]) AS t, generate_subscripts({at}, 1) - 1 AS i)").fetchall()
    assert sorted((r.video_id, r.start, r.end) for r in got.collect()) == sorted(want)


def test_overlaps_of_equal_intervals_do_not_depend_on_the_order_of_rows(spark):
    rows = [("v", x, 0.0, 9.0) for x in ("c", "a", "d", "b")]
    for given in (rows, rows[::-1]):
        said = spark.createDataFrame(given, "video_id string, fact_id string, start double, end double").withColumn("confidence", F.lit(1.0)).coalesce(1)
        found = validate(said, said.limit(1).select("video_id", F.col("end").alias("duration")), exclusive=said)
        assert sorted((r.fact_id, r.rule) for r in found.collect()) == [(x, "overlap") for x in "bcd"]


def test_supporting_evidence_is_what_the_walk_finds_and_writes_no_table(spark, tables):
    store = shared_dir(spark).removeprefix("file://")
    pairs = lambda df: sorted((r.origin, r.id) for r in df.collect())
    held = set(os.listdir(store))
    got = pairs(M.supporting_evidence(spark, tables))
    assert set(os.listdir(store)) == held
    want = pairs(G.evidence_of(M._whole(spark, tables), lambda c: c.rlike(r"^[^/]+/(entity|change|state|chapter|rule)/")))
    assert got == want and {x.split("/")[1] for x, _ in got} == {"entity", "change", "state", "chapter", "rule"}

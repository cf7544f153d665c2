"""Gaps, chains, changes, chapters, states, segments, rule events and sampling plans over facts of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.text import STOPWORDS, clip, command_in, content_terms, error_in, first_of_each, terms
from chronofact.operators.intervals import EPS, interval_join, islands

VIDEO = ["video_id"]


def _by_time(*more: str):
    return Window.partitionBy("video_id").orderBy("start", "end", *more)


def silence_gaps(utterances: DataFrame, durations: DataFrame, least: float = 2.0) -> DataFrame:
    """Gaps of ``least`` seconds or more between an utterance's end and the next one's start, at the head and the tail too."""
    w = _by_time("fact_id")
    rows = utterances.join(durations, "video_id").select(
        "video_id", "duration", "start", "end", F.lag("end").over(w).alias("before"), F.lead("start").over(w).alias("after")
    )
    head = rows.where("before IS NULL").select("video_id", F.lit(0.0).alias("start"), F.least("start", "duration").alias("end"))
    inner = rows.where("before IS NOT NULL").select("video_id", F.least("before", "duration").alias("start"), F.least("start", "duration").alias("end"))
    tail = rows.where("after IS NULL").select("video_id", F.least("end", "duration").alias("start"), F.col("duration").alias("end"))
    gaps = head.union(inner).union(tail).where(F.col("end") - F.col("start") >= least)
    return gaps.withColumn("duration_s", F.round(F.col("end") - F.col("start"), 3))


def speech_spans(silences: DataFrame, durations: DataFrame, least: float = 0.3) -> DataFrame:
    """What the silences leave of each recording, in pieces of ``least`` seconds or more."""
    w = Window.partitionBy("video_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marks = silences.select("video_id", "start", "end").union(durations.select("video_id", F.col("duration").alias("start"), F.col("duration").alias("end")))
    spans = marks.select("video_id", F.coalesce(F.max("end").over(w), F.lit(0.0)).alias("_from"), F.col("start").alias("end"))
    return spans.where(F.col("end") - F.col("_from") >= least).select("video_id", F.col("_from").alias("start"), "end")


def event_chains(events: DataFrame, max_gap: float = 120.0, least: int = 2) -> DataFrame:
    """Sessions: a new chain begins when an event starts more than max_gap after the previous event's end."""
    runs = islands(events, VIDEO, max_gap, ("start", "end", "fact_id"), running=False, name="chain")
    members = F.array_sort(F.collect_list(F.struct("start", "end", "fact_id", "kind")))
    return (
        runs.groupBy("video_id", "chain")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("events"), members.alias("_m"))
        .where(F.col("events") >= least)
        .select("video_id", "chain", "start", "end", "events", F.array_join(F.transform("_m", lambda x: x["kind"]), ">").alias("sequence"))
    )


def change_points(regions: DataFrame, facts: DataFrame) -> DataFrame:
    """Changes between neighbouring regions of a recording: text_changed, speech_started or _ended, scene_transition.

    Text changed when both regions hold screen terms and share none; else speech counts; else the scene boundary.
    """
    inside = interval_join(regions.select("video_id", "region", "start", "end"), facts.where(F.col("modality").isin("ocr", "transcript")), VIDEO, 60.0, -EPS)
    found = inside.groupBy(F.col("l_video_id").alias("video_id"), F.col("l_region").alias("region")).agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("r_modality") == "ocr", content_terms(F.col("r_text")))))).alias("words"),
        F.bool_or(F.col("r_modality") == "transcript").alias("speech"),
        F.count(F.lit(1)).alias("n"),
    )
    w = Window.partitionBy("video_id").orderBy("region")
    rows = regions.join(found, ["video_id", "region"], "left").withColumns(
        {
            "words": F.coalesce("words", F.array().cast("array<string>")),
            "speech": F.coalesce("speech", F.lit(False)),
        }
    )
    rows = rows.withColumns({"_w": F.lag("words").over(w), "_s": F.lag("speech").over(w)}).where("_s IS NOT NULL")
    turnover = (F.size("words") > 0) & (F.size("_w") > 0) & ~F.arrays_overlap("words", "_w")
    kind = (
        F.when(turnover, "text_changed")
        .when(F.col("speech") & ~F.col("_s"), "speech_started")
        .when(~F.col("speech") & F.col("_s"), "speech_ended")
        .otherwise("scene_transition")
    )
    return rows.select("video_id", F.col("start").alias("ts"), kind.alias("change_type"), F.col("end").alias("region_end"))


def screen_timeline(states: DataFrame, changes: DataFrame) -> DataFrame:
    """(video_id, ts, kind, label, place): a recording's states and what broke them, in order of time, changes first."""
    label = F.concat_ws(" + ", F.slice(F.split("evidence_ids", ","), 1, 2))
    rows = states.select("video_id", F.col("start").alias("ts"), F.lit("state").alias("kind"), label.alias("label")).unionByName(
        changes.select("video_id", "ts", F.lit("change").alias("kind"), F.col("change_type").alias("label"))
    )
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "kind", "label")))


def structure(chapters: DataFrame, changes: DataFrame, states: DataFrame) -> DataFrame:
    """(video_id, chapters, changes, states): how many of each a recording has."""
    marks = [x.select("video_id", F.lit(n).alias("of")) for n, x in (("chapters", chapters), ("changes", changes), ("states", states))]
    every = marks[0].union(marks[1]).union(marks[2])
    return every.groupBy("video_id").agg(*[F.count_if(F.col("of") == n).alias(n) for n in ("chapters", "changes", "states")])


def run_metrics(frames: DataFrame, plan: DataFrame, times: DataFrame) -> DataFrame:
    """(video_id, realtime_factor, frames_sampled, frames_skipped): seconds of work over seconds recorded, to four significant
    digits, frames taken, and those planned but not taken (never under 0)."""
    taken = frames.groupBy("video_id").agg(F.count_distinct("ts").alias("n"))
    planned = plan.groupBy("video_id").agg(F.sum(F.ceil((F.col("end") - F.col("start")) * F.col("fps"))).alias("p"))
    raw = F.col("seconds") / F.col("duration")
    digits = F.lit(3) - F.floor(F.log10(raw)).cast("int")
    factor = F.when(F.col("duration") > 0, F.when(raw > 0, F.round(raw * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)).otherwise(0.0))
    rows = times.join(taken, "video_id", "left").join(planned, "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select("video_id", factor.alias("realtime_factor"), zero("n").alias("frames_sampled"), F.greatest(F.lit(0).cast("long"), zero("p") - zero("n")).alias("frames_skipped"))


def tile_chapters(durations: DataFrame, target: float = 300.0, most: int = 12) -> DataFrame:
    """Chapters of recordings without scenes: equal tiles of about ``target`` seconds, half-even, at most ``most``."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.bround(F.col("duration") / target).cast("int")))
    rows = durations.where("duration > 0").withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    edge = lambda i: F.when(i == F.col("n"), F.col("duration")).otherwise(F.round(i * F.col("duration") / F.col("n"), 3))
    return rows.select("video_id", F.col("i").alias("chapter"), edge(F.col("i")).alias("start"), edge(F.col("i") + 1).alias("end"))


def cut_chapters(scenes: DataFrame, durations: DataFrame, target: float = 300.0, most: int = 12, runt: float = 60.0) -> DataFrame:
    """Chapters cut at scene starts: the next cut is the first scene ``target`` seconds after the last one.

    The scan keeps its last cut, so it is a fold over each recording's ordered scene starts.
    """
    starts = scenes.groupBy("video_id").agg(F.array_sort(F.collect_list("start")).alias("s"))
    fold = F.aggregate(
        "s",
        F.array(F.lit(0.0)),
        lambda cuts, x: F.when((x - F.element_at(cuts, -1) >= target) & (F.size(cuts) < most), F.array_append(cuts, x)).otherwise(cuts),
    )
    merged = F.aggregate(
        F.slice("cuts", 2, 1000000),
        F.array(F.lit(0.0)),
        lambda kept, x: F.when(x - F.element_at(kept, -1) < runt, kept).otherwise(F.array_append(kept, x)),
    )
    rows = starts.select("video_id", F.explode(F.array(fold)).alias("cuts")).select("video_id", F.explode(F.array(merged)).alias("cuts")).join(durations, "video_id")
    rows = rows.select("video_id", "duration", F.posexplode("cuts").alias("chapter", "start"))
    end = F.coalesce(F.lead("start").over(Window.partitionBy("video_id").orderBy("chapter")), F.col("duration"))
    return rows.withColumn("end", end).where(F.col("end") - F.col("start") > EPS).select("video_id", "chapter", "start", "end")


def chapter_titles(chapters: DataFrame, facts: DataFrame, top: int = 3) -> DataFrame:
    """chapters with a title of the most frequent content terms of what is said and shown in them, else Part n."""
    inside = interval_join(chapters, facts.where(F.col("modality").isin("ocr", "transcript")), VIDEO, 60.0, -EPS)
    stop = F.array(*map(F.lit, STOPWORDS))
    good = F.filter(terms(F.col("r_text")), lambda x: ~F.array_contains(stop, x) & x.rlike(r"\p{L}"))
    counts = inside.select(F.col("l_video_id").alias("video_id"), F.col("l_chapter").alias("chapter"), F.explode(good).alias("term")).groupBy("video_id", "chapter", "term").count()
    w = Window.partitionBy("video_id", "chapter").orderBy(F.desc("count"), "term")
    best = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    titles = best.groupBy("video_id", "chapter").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: F.initcap(x["term"])), " · ").alias("title")
    )
    return chapters.join(titles, ["video_id", "chapter"], "left").withColumn("title", F.coalesce("title", F.format_string("Part %d", F.col("chapter") + 1)))


def states(lifespans: DataFrame, least: float = 2.0, width: float = 30.0) -> DataFrame:
    """Maximal intervals with one set of stable texts on screen; runts join the state before them.

    All ends of lifespans cut a recording into elementary intervals; each holds the lifespans that cover it, and equal
    neighbours are one state.
    """
    points = lifespans.select("video_id", F.explode(F.array("start", "end")).alias("p")).distinct()
    w = Window.partitionBy("video_id").orderBy("p")
    bits = points.select("video_id", F.col("p").alias("start"), F.lead("p").over(w).alias("end")).where(F.col("end") - F.col("start") > EPS)
    covered = interval_join(bits, lifespans.select("video_id", "fact_id", "start", "end"), VIDEO, width, 0.0).where(
        (F.col("r_start") <= F.col("l_start") + EPS) & (F.col("r_end") >= F.col("l_end") - EPS)
    )
    active = covered.groupBy(F.col("l_video_id").alias("video_id"), F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(
        F.array_join(F.array_sort(F.collect_set("r_fact_id")), ",").alias("ids")
    )
    v = Window.partitionBy("video_id").orderBy("start")
    same = (F.lag("ids").over(v) == F.col("ids")) & (F.abs(F.lag("end").over(v) - F.col("start")) <= EPS)
    runs = active.withColumn("_f", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_f").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("video_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("ids").alias("ids"))
    r = Window.partitionBy("video_id").orderBy("run")
    head = F.when((F.col("end") - F.col("start") >= least) | (F.row_number().over(r) == 1), 1).otherwise(0)
    folded = whole.withColumn("_h", head).withColumn("state", F.sum("_h").over(r.rowsBetween(Window.unboundedPreceding, 0)))
    members = F.array_sort(F.collect_list(F.struct("run", "ids")))
    return folded.groupBy("video_id", "state").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(members, lambda x: x["ids"]), ",").alias("evidence_ids"))


def plan_segments(scenes: DataFrame, longest: float = 45.0) -> DataFrame:
    """Windows that tile each recording: scene gaps are closed, and scenes over ``longest`` cut into equal parts."""
    w = Window.partitionBy("video_id").orderBy("start", "end")
    closed = scenes.select("video_id", F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.col("start")).alias("start"), F.coalesce(F.lead("start").over(w), F.col("end")).alias("end"))
    parts = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / longest).cast("int"))
    cut = closed.where("end > start").withColumn("n", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    size = (F.col("end") - F.col("start")) / F.col("n")
    end = F.when(F.col("i") + 1 == F.col("n"), F.col("end")).otherwise(F.col("start") + (F.col("i") + 1) * size)
    out = cut.select("video_id", (F.col("start") + F.col("i") * size).alias("start"), end.alias("end"))
    return out.withColumn("segment", F.row_number().over(Window.partitionBy("video_id").orderBy("start")) - 1)


def merge_short(segments: DataFrame, least: float = 4.0) -> DataFrame:
    """Segments under ``least`` seconds joined to the one before (the first to the one behind), as a fold in time order."""
    rows = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        short = (x["end"] - x["start"] < least) | (last["end"] - last["start"] < least)
        head = F.slice(kept, 1, F.size(kept) - 1)
        return F.when(short, F.array_append(head, pair(last["start"], x["end"]))).otherwise(F.array_append(kept, x))

    out = rows.select("video_id", F.explode(F.array(F.aggregate(F.slice("s", 2, 1000000), F.slice("s", 1, 1), step))).alias("s"))
    return out.select("video_id", F.posexplode("s").alias("segment", "x")).select("video_id", "segment", "x.start", "x.end")


def segment_members(segments: DataFrame, facts: DataFrame, width: float = 45.0) -> DataFrame:
    """(video_id, segment, fact): facts that overlap a segment; instants by containment, the last segment closed."""
    last = F.max("end").over(Window.partitionBy("video_id"))
    pairs = interval_join(segments.withColumn("last_end", last), facts, VIDEO, width, 0.0, "closed")
    s, e, a, b = F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")
    instant = (s <= a) & ((a < e) | ((a == e) & (e == F.col("l_last_end"))))
    meets = F.when(b > a, (a < e) & (s < b)).otherwise(instant)
    return pairs.where(meets).select(F.col("l_video_id").alias("video_id"), F.col("l_segment").alias("segment"), *[F.col("r_" + c).alias(c) for c in facts.columns if c != "video_id"])


def segment_text(members: DataFrame) -> DataFrame:
    """Each segment's texts in time order, blanks collapsed, case-insensitive repeats dropped, a line each."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "fact_id", "text"))), lambda x: x["text"])
    grouped = members.where("text IS NOT NULL").groupBy("video_id", "segment").agg(lines.alias("lines"))
    return grouped.select("video_id", "segment", first_of_each(F.col("lines")).alias("text"))


def rule_events(facts: DataFrame, scenes: DataFrame) -> DataFrame:
    """Typed events by rule: scene_changed at inner scene starts, text_appeared and text_disappeared of screen texts,
    command_entered and error_shown where a screen text holds a prompt or an error form. One pass over each table; where
    facts say which texts are stable (column ``stable``), the others give no events."""
    w = Window.partitionBy("video_id").orderBy("start", "end")
    cuts = scenes.withColumn("_i", F.row_number().over(w)).where("_i > 1").select("video_id", F.lit("scene_changed").alias("type"), F.col("start"), F.col("start").alias("end"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("detail"))
    event = lambda kind, s, e, detail, good: F.when(good, F.struct(F.lit(kind).alias("type"), s.alias("start"), e.alias("end"), detail.cast("string").alias("detail")))
    s, e, none = F.col("start"), F.col("end"), F.lit(None)
    made = F.array(
        event("text_appeared", s, s, none, F.lit(True)),
        event("text_disappeared", e, e, none, F.lit(True)),
        event("command_entered", s, s, F.col("_command"), F.col("_command").isNotNull()),
        event("error_shown", s, e, F.col("_error"), F.col("_error").isNotNull()),
    )
    kept = facts.where("modality = 'ocr'" + (" AND stable" if "stable" in facts.columns else ""))
    shown = kept.withColumn("_command", command_in(F.col("text"))).withColumn("_error", error_in(F.col("text")))
    return shown.select("video_id", F.col("fact_id").alias("ref"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("video_id", "x.type", "x.start", "x.end", "ref", "x.detail").unionByName(cuts)


def flatten_rates(windows: DataFrame, width: float = 30.0) -> DataFrame:
    """Overlapping windows with a rate as a piecewise-constant greatest rate: video_id, start, end, fps, reason."""
    points = windows.select("video_id", F.explode(F.array("start", "end")).alias("p")).distinct()
    w = Window.partitionBy("video_id").orderBy("p")
    bits = points.select("video_id", F.col("p").alias("start"), F.lead("p").over(w).alias("end")).where("end IS NOT NULL AND end > start")
    over = interval_join(bits, windows, VIDEO, width)
    best = over.groupBy(F.col("l_video_id").alias("video_id"), F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(
        F.max(F.struct(F.col("r_fps").alias("fps"), F.col("r_reason").alias("reason"))).alias("m")
    )
    v = Window.partitionBy("video_id").orderBy("start")
    same = (F.lag("m").over(v) == F.col("m")) & (F.lag("end").over(v) == F.col("start"))
    runs = best.withColumn("_f", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_f").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("video_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("m").alias("m")).select("video_id", "start", "end", "m.fps", "m.reason")


def adaptive_plan(scenes: DataFrame, base: float = 1.0, most: float = 4.0, least: float = 0.2, burst: float = 1.2, static: float = 8.0) -> DataFrame:
    """Sampling windows of scenes: a burst at the start at the highest rate, then the base rate, long scenes at the lowest."""
    cut = F.least(F.col("start") + burst, F.col("end"))
    window = lambda s, e, fps, why: F.struct(s.alias("start"), e.alias("end"), fps.alias("fps"), F.lit(why).alias("reason"))
    rest = F.when(F.col("end") - F.col("start") > static, F.lit(least)).otherwise(F.lit(base))
    made = F.array(window(F.col("start"), cut, F.lit(most), "boundary_burst"), window(cut, F.col("end"), rest, "scene"))
    return scenes.select("video_id", F.explode(F.filter(made, lambda x: x["end"] > x["start"])).alias("x")).select("video_id", "x.*")


def fixed_plan(durations: DataFrame, base: float = 1.0) -> DataFrame:
    """One sampling window a recording, at one rate; recordings of no length have none."""
    return durations.where("duration > 0").select("video_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.lit(base).alias("fps"), F.lit("fixed").alias("reason"))


def scene_plan(durations: DataFrame, scenes: DataFrame, least: float = 0.2, static: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """(windows, frames): a frame (video_id, ts, reason) for each scene, at its keyframe where it has one (``keyframe``), else at
    its start, and windows at the lowest rate over scenes longer than ``static``; recordings without scenes are swept at that rate."""
    key = F.coalesce("keyframe", "start") if "keyframe" in scenes.columns else F.col("start")
    frames = scenes.select("video_id", F.round(F.least(key, F.greatest("start", F.col("end") - 0.05)), 3).alias("ts"), F.lit("scene_keyframe").alias("reason"))
    window = lambda rows, s, e, why: rows.select("video_id", s.alias("start"), e.alias("end"), F.lit(least).alias("fps"), F.lit(why).alias("reason"))
    long = window(scenes.where(F.col("end") - F.col("start") > static), F.col("start"), F.col("end"), "long_scene")
    bare = durations.where("duration > 0").join(scenes.select("video_id").distinct(), "video_id", "left_anti")
    return long.unionByName(window(bare, F.lit(0.0), F.col("duration"), "no_scenes")), frames


def fit_budget(windows: DataFrame, max_frames: int, floor: float = 0.05) -> DataFrame:
    """Rates scaled, down to ``floor``, so that each recording's estimated frames keep the budget."""
    frames = F.sum((F.col("end") - F.col("start")) * F.col("fps")).over(Window.partitionBy("video_id"))
    return windows.withColumn("_f", frames).withColumn("fps", F.when(F.col("_f") > max_frames, F.greatest(F.lit(floor), F.col("fps") * max_frames / F.col("_f"))).otherwise(F.col("fps"))).drop("_f")


def text_boundaries(scenes: DataFrame, lifespans: DataFrame, threshold: float = 0.35, around: float = 0.25, min_scene: float = 1.5) -> DataFrame:
    """Cuts where the words on screen turn over: at each text's start, Jaccard of the words before and after <= threshold.

    Only cuts ``min_scene`` seconds away from every scene start are kept; score is 1 - Jaccard.
    """
    starts = lifespans.select("video_id", F.col("start").alias("t")).distinct()
    sides = starts.select("video_id", "t", F.explode(F.array(F.struct(F.lit("before").alias("side"), (F.col("t") - around).alias("start")), F.struct(F.lit("after").alias("side"), (F.col("t") + around).alias("start")))).alias("x")).select("video_id", "t", "x.side", "x.start", F.col("x.start").alias("end"))
    shown = interval_join(sides, lifespans, VIDEO, 30.0, 0.0, "closed").where((F.col("r_start") <= F.col("l_start")) & (F.col("l_start") < F.greatest("r_end", F.col("r_start") + 1e-3)))
    words = shown.groupBy(F.col("l_video_id").alias("video_id"), F.col("l_t").alias("t")).agg(
        *[F.array_distinct(F.flatten(F.collect_list(F.when(F.col("l_side") == side, content_terms(F.col("r_text")))))).alias(side) for side in ("before", "after")]
    )
    union = F.size(F.array_union("before", "after"))
    jaccard = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("before", "after")) / union)
    cuts = words.withColumn("score", F.round(1 - jaccard, 6)).where(jaccard <= threshold).select("video_id", F.col("t").alias("start"), F.col("t").alias("end"), "score")
    near = interval_join(cuts, scenes.select("video_id", "start", F.col("start").alias("end")), VIDEO, 30.0, min_scene)
    return cuts.join(near.select(F.col("l_video_id").alias("video_id"), F.col("l_start").alias("start")).distinct(), ["video_id", "start"], "left_anti").select("video_id", F.col("start").alias("ts"), "score")


def frame_runs(frames: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Runs of consecutive frames whose signature differs by at most ``threshold`` in its worst place: (video_id, ts, signature)."""
    w = Window.partitionBy("video_id").orderBy("ts")
    worst = F.array_max(F.zip_with("signature", F.lag("signature").over(w), lambda a, b: F.abs(a - b)))
    fresh = F.when(F.lag("ts").over(w).isNull() | (worst > threshold), 1).otherwise(0)
    return frames.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def normal_utterances(rows: DataFrame, durations: DataFrame) -> DataFrame:
    """Utterances fit to store: blanks collapsed and blank ones dropped, reversed times swapped, cut to the recording, numbered."""
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    s, e = F.least("start", "end"), F.greatest("start", "end")
    fit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.col("duration"))
    out = rows.join(durations, "video_id").select("video_id", fit(s).alias("start"), fit(e).alias("end"), t.alias("text")).where("text <> ''")
    return out.withColumn("id", F.format_string("utt_%04d", F.row_number().over(Window.partitionBy("video_id").orderBy("start", "end", "text")) - 1))


def interaction_clip(text: Column) -> Column:
    return clip(text, 160)

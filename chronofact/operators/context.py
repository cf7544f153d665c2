"""Context for a question: representative frames, and what of evidence and frames a budget holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators.intervals import interval_join

#: What a frame scores for the reason it was taken; seconds between chosen frames; tokens of a
#: frame and of a span besides its text.
REASONS = {"scene_change": 10, "boundary_burst": 8, "event": 7, "keyframe": 6, "motion": 5, "ocr_density": 5}
SPACING, FRAME_TOKENS, SPAN_TOKENS = 5.0, 200, 50
#: What a context falls back to, in spans and frames, before it gives up summaries.
LEAST_SPANS, LEAST_FRAMES = 3, 3
SUMMARIES = ("one_line", "short", "detailed")


def frame_scores(frames: DataFrame, facts: DataFrame, query: str = "", width: float = 30.0) -> DataFrame:
    """frames (video_id, frame_id, ts, reason) with score: reason, +2 with screen text, +3 with a vision note, +2 for each
    word of the query (over two letters) that these hold."""
    words = list(dict.fromkeys(w for w in query.lower().split() if len(w) > 2))
    shown = facts.where("modality IN ('ocr', 'vision')").select("video_id", "modality", "start", "end", F.lower("text").alias("text"))
    at = frames.select("video_id", "frame_id", F.col("ts").alias("start"), F.col("ts").alias("end"))
    over = interval_join(at, shown, ["video_id"], width, 0.0, "closed")
    some = lambda c: F.max(c.cast("int"))
    found = over.groupBy(F.col("l_video_id").alias("video_id"), F.col("l_frame_id").alias("frame_id")).agg(
        some(F.col("r_modality") == "ocr").alias("_o"), some(F.col("r_modality") == "vision").alias("_v"), *[some(F.col("r_text").contains(w)).alias(f"_w{i}") for i, w in enumerate(words)]
    )
    reason = F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("reason")], F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    bonus = 2 * zero(F.col("_o")) + 3 * zero(F.col("_v")) + sum((2 * zero(F.col(f"_w{i}")) for i in range(len(words))), F.lit(0))
    return frames.join(found, ["video_id", "frame_id"], "left").select(*frames.columns, (reason + bonus).alias("score"))


def frame_context(frames: DataFrame, shown: DataFrame, described: DataFrame, width: float = 30.0) -> DataFrame:
    """frames (video_id, frame_id, ts) with ``shown_ids``, the texts whose lifespan holds them, and ``described_ids``, the
    descriptions (with frame_ids) they belong to or whose lifespan holds them; both sorted.

    Lifespans meet by time buckets; sets of frames are taken apart, so that membership is an equality.
    """
    at = frames.select("video_id", "frame_id", F.col("ts").alias("start"), F.col("ts").alias("end"))
    inside = lambda facts: interval_join(at, facts.select("video_id", "fact_id", "start", "end"), ["video_id"], width, 0.0, "closed").select(F.col("l_video_id").alias("video_id"), F.col("l_frame_id").alias("frame_id"), F.col("r_fact_id").alias("fact_id"))
    member = described.select("video_id", F.explode("frame_ids").alias("frame_id"), "fact_id").join(frames.select("video_id", "frame_id"), ["video_id", "frame_id"])
    ids = lambda rows, name: rows.groupBy("video_id", "frame_id").agg(F.array_sort(F.collect_set("fact_id")).alias(name))
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    out = frames.join(ids(inside(shown), "shown_ids"), ["video_id", "frame_id"], "left").join(ids(inside(described).unionByName(member), "described_ids"), ["video_id", "frame_id"], "left")
    return out.select(*[F.col(c) for c in frames.columns], none("shown_ids"), none("described_ids"))


def representative_frames(scored: DataFrame, most: int = 10, spacing: float = SPACING) -> DataFrame:
    """(video_id, frame_id, ts, score, rank): frames in descending score, each at least ``spacing`` from those chosen before.

    A fold over a recording's frames, which stops choosing at ``most``.
    """
    rows = scored.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ts", "frame_id"))).alias("f"))
    free = lambda kept, x: (F.size(kept) < most) & ~F.exists(kept, lambda k: F.abs(k["ts"] - x["ts"]) < spacing)
    chosen = F.aggregate("f", F.filter("f", lambda x: F.lit(False)), lambda kept, x: F.when(free(kept, x), F.array_append(kept, x)).otherwise(kept))
    return rows.select("video_id", F.posexplode(chosen).alias("rank", "x")).select("video_id", "x.frame_id", "x.ts", (-F.col("x.neg")).alias("score"), (F.col("rank") + 1).alias("rank"))


def letters(text: Column) -> Column:
    """Tokens of a text: a quarter of its characters, none for null."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def summaries(facts: DataFrame, short: int = 200, detailed: int = 2000) -> DataFrame:
    """(video_id, one_line, short, detailed) of each recording: what it holds, and the beginning of what was said in it."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("modality") == "transcript", F.struct("start", "fact_id", "text")))), lambda x: x["text"]), " ")
    held = F.concat_ws(", ", *[F.concat(F.count_if(F.col("modality") == m).cast("string"), F.lit(f" {m}")) for m in ("transcript", "ocr", "events")])
    rows = facts.groupBy("video_id").agg(held.alias("one_line"), said.alias("_said"))
    return rows.select("video_id", "one_line", F.substring("_said", 1, short).alias("short"), F.substring("_said", 1, detailed).alias("detailed"))


def trimmed(spans: Column, first: Column, tokens: Column, frames: Column, texts: list[Column], budget: int) -> tuple[Column, Column, list[Column]]:
    """What a token budget leaves: how many spans and frames, and which of the summaries (their tokens, the shortest first).

    In order, until it fits: spans down to three, frames down to three, the longest summary away, the next one away, no
    frames, no spans. ``tokens`` are those of all spans, ``first`` those of the best three.
    """
    held = [F.lit(True)] * len(texts)

    def over(t: Column, f: Column) -> Column:
        return t + f * FRAME_TOKENS + sum((F.when(k, x).otherwise(0) for k, x in zip(held, texts, strict=True)), F.lit(0)) > budget

    cut = over(tokens, frames) & (spans > LEAST_SPANS)
    s, t = F.when(cut, F.lit(LEAST_SPANS)).otherwise(spans), F.when(cut, first).otherwise(tokens)
    f = F.when(over(t, frames) & (frames > LEAST_FRAMES), F.lit(LEAST_FRAMES)).otherwise(frames)
    for i in range(len(texts) - 1, 0, -1):
        held[i] = ~over(t, f)
    f = F.when(over(t, f), F.lit(0)).otherwise(f)
    return F.when(over(t, f), F.lit(0)).otherwise(s), f, held


def select_context(spans: DataFrame, frames: DataFrame, budget: int, texts: DataFrame | None = None, max_spans: int = 10, max_frames: int = 10) -> DataFrame:
    """One row a recording: how many ranked spans (video_id, rank, text) and frames (video_id, rank) are its context, and
    which of its summaries (``texts``).

    Caps first, then tokens; what was cut is in the notes.
    """
    size = letters(F.col("text")) + SPAN_TOKENS
    e = spans.where(F.col("rank") <= max_spans).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("t"), F.coalesce(F.sum(F.when(F.col("rank") <= LEAST_SPANS, size)), F.lit(0)).alias("t3"))
    f = frames.where(F.col("rank") <= max_frames).groupBy("video_id").agg(F.count(F.lit(1)).alias("m"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = e.join(f, "video_id", "full_outer").select("video_id", zero("n").alias("n"), zero("t").alias("t"), zero("t3").alias("t3"), zero("m").alias("m"))
    held = texts if texts is not None else rows.select("video_id", *[F.lit(None).cast("string").alias(c) for c in SUMMARIES])
    rows = rows.join(held, "video_id", "left").withColumns({f"_{c}": letters(F.col(c)) for c in SUMMARIES})
    kept, left, texts_kept = trimmed(F.col("n"), F.col("t3"), F.col("t"), F.col("m"), [F.col(f"_{c}") for c in SUMMARIES], budget)
    out = rows.withColumns({"spans": kept.cast("long"), "frames": left.cast("long"), "summaries": F.concat_ws(",", *[F.when(k & F.col(c).isNotNull(), c) for c, k in zip(SUMMARIES, texts_kept, strict=True)])})
    note = F.concat_ws("; ", F.when(F.col("spans") < F.col("n"), F.concat(F.lit("spans "), "n", F.lit(" to "), "spans")), F.when(F.col("frames") < F.col("m"), F.concat(F.lit("frames "), "m", F.lit(" to "), "frames")))
    return out.select("video_id", "spans", "frames", "summaries", note.alias("notes"))


def context_items(spans: DataFrame, frames: DataFrame, budget: int, texts: DataFrame, max_spans: int = 10, max_frames: int = 10) -> DataFrame:
    """(video_id, kind, rank, text, tokens): the spans, frames and summaries themselves that ``select_context`` leaves."""
    plan = select_context(spans, frames, budget, texts, max_spans, max_frames).select("video_id", F.col("spans").alias("_s"), F.col("frames").alias("_f"), F.col("summaries").alias("_t"))
    span = spans.join(plan, "video_id").where(F.col("rank") <= F.col("_s")).select("video_id", F.lit("span").alias("kind"), "rank", "text", (letters(F.col("text")) + SPAN_TOKENS).alias("tokens"))
    frame = frames.join(plan, "video_id").where(F.col("rank") <= F.col("_f")).select("video_id", F.lit("frame").alias("kind"), "rank", F.col("frame_id").alias("text"), F.lit(FRAME_TOKENS).cast("long").alias("tokens"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("name"), F.col(c).alias("text")) for i, c in enumerate(SUMMARIES, 1)])).alias("x")
    told = texts.join(plan, "video_id").select("video_id", "_t", each).where(F.array_contains(F.split("_t", ","), F.col("x.name")))
    return span.unionByName(frame).unionByName(told.select("video_id", F.lit("summary").alias("kind"), "x.rank", "x.text", letters(F.col("x.text")).alias("tokens")))


def first_ranks(spans: DataFrame, order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy(*order)
    return spans.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)

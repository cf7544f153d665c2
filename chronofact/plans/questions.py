"""Questions read as columns: temporal phrasing, intent and stages of a table of questions, and the same as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.plans import cues

_TC = r"(?:\d+:)?[0-5]?\d:[0-5]\d(?:\.\d+)?"
_LEAD = r"(?:^|\b)(?:what happened|what was|show me|find)\s+(?:(?:just|immediately|right|shortly)\s+)?"
_REST = r"([^\n]+?)\??$"
#: Forms of temporal phrasing, each with what stands before it as the first group.
FORMS = {
    "between_clock": rf"(?is)^(.*?)\bbetween\s+({_TC})\s+and\s+({_TC})(.*)$",
    "from_clock": rf"(?is)^(.*?)\bfrom\s+({_TC})\s+to\s+({_TC})(.*)$",
    "between": rf"(?is)^(.*?)\bbetween\s+([^\n]+?)\s+and\s+{_REST}",
    "before": rf"(?is)^(.*?){_LEAD}before\s+{_REST}",
    "after": rf"(?is)^(.*?){_LEAD}after\s+{_REST}",
    "while": rf"(?is)^(.*?)\bwhile\s+{_REST}",
    "during": rf"(?is)^(.*?)\bduring\s+{_REST}",
    "around": rf"(?is)^(.*?)\baround\s+{_REST}",
    "first": r"(?i)\bfirst\b",
    "last": r"(?i)\b(?:last|final|most recent|disappeared|disappear)\b",
}
CLOCK = rf"\b{_TC}\b"
LEAD = r"(?i)^(?:when did|where was|what was|which|who|show me|find|tell me)\b\s*"
EVENT = r"(?i)\b(?:occurrence|appearance|mention|time)\b"
ASKED = r"(?i)\b(?:what changed|what happened)\b"
AT_ONCE, SOON = r"(?i)\bimmediately\b|\bright\s+(?:after|before)\b", r"(?i)\bshortly\b"
#: The least number of words that a form needs.
WORDS = {"while": 4, "during": 3, "around": 3}
RELATIONS = {"before": "BEFORE", "after": "AFTER", "while": "CO_OCCURS", "around": "CO_OCCURS", "during": "DURING"}
#: The intents in the order in which they are tried, by the cues or the form that shows them.
INTENTS = (
    (cues.COMPARISON, "comparison"), (cues.SUMMARY, "general_summary"), (("before",), "temporal_before"), (("after",), "temporal_after"),
    (("while",), "temporal_while"), (("around", "during"), "co_occurrence"), (("between", "between_clock", "from_clock", "clock"), "temporal_between"),
    (("first",), "first_occurrence"), (("last",), "last_occurrence"), (cues.SEQUENCE, "event_sequence"), (cues.EVIDENCE, "evidence_request"),
    (cues.CHANGE, "change_detection"), (cues.TIMELINE, "entity_timeline"), (cues.SCREEN, "ui_state_query"),
)
_KINDS = {*FORMS, "clock"}
STAGES = ("scenes", "frames", "ocr", "audio", "asr", "vision", "events")
#: Stages of a question that shows no signal.
GENERAL = ("scenes", "frames", "ocr", "audio", "asr", "events")
#: Seconds on either side of what a question with "around" names.
AROUND = 30.0
OUT = ["intent", "anchor", "relation", "start", "end", "max_gap", "anchor_b", "stages"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _of(chain: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first test that holds."""
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(chain), otherwise)


def seconds(timecode: Column) -> Column:
    """Seconds of [h:]m:s; null for anything else."""
    parts = F.transform(F.split(timecode, ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)


def read_questions(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """questions with intent, anchor, relation, start, end, max_gap, anchor_b and stages; a function of each row, without a
    shuffle. A null text counts as empty."""
    return phrased(questions, text_col).drop("_kind")


def phrased(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """``read_questions``, and the form of each question's phrasing (``_kind``): one of FORMS, in their order, clock or plain."""
    raw, clock, kind = F.col("_raw"), F.col("_clock"), F.col("_kind")
    part = lambda name, n: F.regexp_extract(raw, FORMS[name], n)
    spans = lambda name: F.coalesce(seconds(part(name, 3)) > seconds(part(name, 2)), F.lit(False))
    bare = F.size(clock) == 0
    test = {name: raw.rlike(p) for name, p in FORMS.items()}
    test |= {name: spans(name) for name in ("between_clock", "from_clock")}
    test |= {name: test[name] & (F.size(F.split(raw, r"\s+")) >= n) for name, n in WORDS.items()}
    test |= {name: test[name] & bare for name in ("between", "around")}
    kinds = _of([(test[name], F.lit(name)) for name in FORMS], F.when(~bare, "clock").otherwise("plain"))
    step = questions.withColumn("_raw", F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+|\s+$", ""))
    step = step.withColumn("_clock", F.regexp_extract_all("_raw", F.lit(CLOCK), 0)).withColumn("_kind", kinds)

    def outside(name: str) -> Column:
        return F.btrim(F.concat(part(name, 1), part(name, 4)), F.lit(" ?,-"))

    def without(name: str) -> Column:
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, FORMS[name], ""), LEAD, ""), r"^\s+|\s+$", "")
        rest = F.regexp_replace(rest, EVENT, "") if name == "last" else rest
        return F.btrim(F.regexp_replace(rest, r"\s+", " "), F.lit(" ?,-"))

    group = lambda name, n=2: F.btrim(part(name, n), F.lit(" ?"))
    both = lambda name: F.regexp_replace(F.concat(F.regexp_replace(part(name, 1), r"^\s+|\s+$", ""), F.lit(" "), group(name)), r"^\s+|\s+$", "")
    anchors = {
        "between_clock": F.btrim(F.regexp_replace(outside("between_clock"), ASKED, ""), F.lit(" ?,-")),
        "from_clock": outside("from_clock"),
        "clock": F.btrim(F.regexp_replace(raw, CLOCK, ""), F.lit(" ?,-")),
        **{name: group(name) for name in ("between", "before", "after", "around")},
        **{name: both(name) for name in ("while", "during")},
        **{name: without(name) for name in ("first", "last")},
    }
    falls = ("between_clock", "from_clock", "clock", "first", "last")
    anchor = _of([(kind == name, F.when(a == "", raw).otherwise(a) if name in falls else a) for name, a in anchors.items()], raw)
    at = F.array_sort(F.transform(clock, seconds))
    several = F.size(clock) > 1
    start = _of([(kind == name, seconds(part(name, 2))) for name in ("between_clock", "from_clock")], F.when(kind == "clock", F.when(several, F.get(at, F.lit(0))).otherwise(F.greatest(F.lit(0.0), F.get(at, F.lit(0)) - 30))))
    end = _of([(kind == name, seconds(part(name, 3))) for name in ("between_clock", "from_clock")], F.when(kind == "clock", F.when(several, F.element_at(at, -1)).otherwise(F.get(at, F.lit(0)) + 30)))
    low = F.lower(raw)
    has = lambda words: _any([low.contains(w) for w in words])
    seen = F.when((kind == "around") & low.rlike(r"\bwhile\b"), "while").otherwise(kind)
    shown = [(seen.isin(*how) if set(how) <= _KINDS else has(how), F.lit(name)) for how, name in INTENTS]
    across = has(cues.COLLECTION) | (low.contains("video") & has(cues.COMPARISON))
    intent = F.when(across, F.when(has(cues.COMPARISON), "cross_video_comparison").otherwise("multi_video_search")).otherwise(_of(shown, F.lit("fact_lookup")))
    signals = [(low.rlike(p), stages) for p, stages, _ in cues.STAGE_SIGNALS]
    none = ~_any([s for s, _ in signals])
    needed = [F.when(_any([s for s, stages in signals if name in stages]) | (none if name in GENERAL else F.lit(False)), name) for name in STAGES]
    return step.select(
        *questions.columns,
        intent.alias("intent"),
        anchor.alias("anchor"),
        _of([(kind == name, F.lit(r)) for name, r in RELATIONS.items()], F.lit(None).cast("string")).alias("relation"),
        start.alias("start"),
        end.alias("end"),
        F.when(kind.isin("before", "after"), F.when(raw.rlike(AT_ONCE), 10.0).when(raw.rlike(SOON), 30.0)).alias("max_gap"),
        F.when(kind == "between", group("between", 3)).alias("anchor_b"),
        F.concat_ws(",", *needed, F.lit("segments")).alias("stages"),
        "_kind",
    )


def plan_table(questions: DataFrame, facts: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """questions with intent, modalities, strategy, operations, fallback and missing: what each asks for and how it is answered.

    Modalities are those a question's words name, else its intent's. ``missing`` are those of them that no fact has; the
    modalities there are, a row each, join as one row. Lists are joined by ", ". A function of each row but for that.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    of = lambda table: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, ", ".join(v) if isinstance(v, tuple) else v)])[F.col("intent")]
    named = F.filter(F.array(*[F.when(_any([low.contains(w) for w in words]), m) for m, words in cues.MODALITIES.items()]), lambda x: x.isNotNull())
    needed = F.when(F.size(named) > 0, named).otherwise(F.split(F.coalesce(of(cues.INTENT_MODALITIES), F.lit("")), ", "))
    read = read_questions(questions, text_col).select(*questions.columns, "intent").withColumn("_needed", F.filter(needed, lambda x: x != ""))
    if facts is None:
        there = read.withColumn("_there", F.lit(None).cast("array<string>"))
    else:
        there = read.crossJoin(F.broadcast(facts.select("modality").distinct().agg(F.collect_set("modality").alias("_there"))))
    missing = F.when(F.col("_there").isNotNull(), F.array_join(F.array_except("_needed", "_there"), ", ")).otherwise("")
    return there.select(
        *questions.columns,
        "intent",
        F.array_join("_needed", ", ").alias("modalities"),
        of(cues.STRATEGIES).alias("strategy"),
        F.coalesce(of(cues.GRAPH_OPERATIONS), F.lit("")).alias("operations"),
        F.coalesce(of(cues.FALLBACKS), F.lit(cues.FALLBACK)).alias("fallback"),
        missing.alias("missing"),
    )


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(source: str) -> str:
    """``read_questions`` over a SQL table (item_id, text), with item_id, question and the columns OUT."""
    secs = lambda x: f"list_reduce(list_transform(string_split({x}, ':'), lambda p: TRY_CAST(p AS DOUBLE)), lambda a, b: a * 60 + b)"
    part = lambda name, n: f"regexp_extract(raw, {_q(FORMS[name])}, {n})"
    tidy = lambda x: f"trim({x}, ' ?,-')"
    bare = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    drop = lambda x, p: f"regexp_replace({x}, {_q(p)}, '', 'g')"
    group = lambda name, n=2: f"trim({part(name, n)}, ' ?')"
    has = lambda words: f"len(list_filter([{', '.join(map(_q, words))}], lambda w: contains(low, w))) > 0"
    more = {name: f" AND len(regexp_split_to_array(raw, '\\s+')) >= {n}" for name, n in WORDS.items()}
    test = {name: f"regexp_matches(raw, {_q(p)}){more.get(name, '')}{' AND len(clock) = 0' if name in ('between', 'around') else ''}" for name, p in FORMS.items()}
    test |= {name: f"{test[name]} AND {secs(part(name, 3))} > {secs(part(name, 2))}" for name in ("between_clock", "from_clock")}
    kinds = " ".join(f"WHEN {t} THEN '{name}'" for name, t in test.items())
    no_word = lambda name: bare(drop(drop("raw", FORMS[name]), LEAD))
    anchor = {
        "between_clock": tidy(drop(tidy(f"{part('between_clock', 1)} || {part('between_clock', 4)}"), ASKED)),
        "from_clock": tidy(f"{part('from_clock', 1)} || {part('from_clock', 4)}"),
        "clock": tidy(drop("raw", CLOCK)),
        "first": tidy(f"regexp_replace({no_word('first')}, '\\s+', ' ', 'g')"),
        "last": tidy(f"regexp_replace({drop(no_word('last'), EVENT)}, '\\s+', ' ', 'g')"),
    }
    anchor = {name: f"coalesce(nullif({a}, ''), raw)" for name, a in anchor.items()}
    anchor |= {name: group(name) for name in ("between", "before", "after", "around")}
    anchor |= {name: bare(f"({bare(part(name, 1))} || ' ' || {group(name)})") for name in ("while", "during")}
    case = lambda of, rest: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + f" ELSE {rest} END"
    edge = lambda n, one, many: case({**{k: secs(part(k, n)) for k in ("between_clock", "from_clock")}, "clock": f"CASE WHEN len(clock) > 1 THEN {many} ELSE {one} END"}, "NULL")
    shown = " ".join(f"WHEN {'seen IN (' + ', '.join(map(_q, how)) + ')' if set(how) <= _KINDS else has(how)} THEN '{name}'" for how, name in INTENTS)
    hits = [f"regexp_matches(low, {_q(p)})" for p, _, _ in cues.STAGE_SIGNALS]
    needs = ", ".join(
        f"CASE WHEN {' OR '.join([h for h, (_, s, _) in zip(hits, cues.STAGE_SIGNALS, strict=True) if name in s] + ([f'NOT ({chr(32).join([hits[0], *(f"OR {h}" for h in hits[1:])])})'] if name in GENERAL else []))} THEN '{name}' END"
        for name in STAGES
    )
    return f"""WITH r AS (SELECT item_id, text AS question, {bare("coalesce(text, '')")} AS raw FROM {source}),
c AS (SELECT *, lower(raw) AS low, regexp_extract_all(raw, {_q(CLOCK)}, 0) AS clock FROM r),
k AS (SELECT *, list_sort(list_transform(clock, lambda c: {secs("c")})) AS stamps, CASE {kinds} WHEN len(clock) > 0 THEN 'clock' ELSE 'plain' END AS kind, CASE WHEN kind = 'around' AND regexp_matches(low, '\\bwhile\\b') THEN 'while' ELSE kind END AS seen FROM c)
SELECT item_id, question, CASE WHEN {has(cues.COLLECTION)} OR (contains(low, 'video') AND {has(cues.COMPARISON)}) THEN CASE WHEN {has(cues.COMPARISON)} THEN 'cross_video_comparison' ELSE 'multi_video_search' END {shown} ELSE 'fact_lookup' END AS intent,
{case(anchor, "raw")} AS anchor, {case({k: _q(v) for k, v in RELATIONS.items()}, "NULL")} AS relation,
{edge(2, "greatest(0.0::DOUBLE, stamps[1] - 30)", "stamps[1]")} AS "start", {edge(3, "stamps[1] + 30", "stamps[-1]")} AS "end",
CASE WHEN kind IN ('before', 'after') THEN CASE WHEN regexp_matches(raw, {_q(AT_ONCE)}) THEN 10.0::DOUBLE WHEN regexp_matches(raw, {_q(SOON)}) THEN 30.0::DOUBLE END END AS max_gap,
CASE WHEN kind = 'between' THEN {group("between", 3)} END AS anchor_b, concat_ws(',', {needs}, 'segments') AS stages FROM k"""

"""Quality rules, line first: failing lines are removed, then documents that lose too much text; DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.exact_dedup import SPACE

#: Fixed value of the base figures: what counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Characters that divide the entries of a menu.
DIVIDERS = "|»«›‹·•"
#: A line with one of these phrases (case folded) is boilerplate.
PHRASES = [
    "all rights reserved", "licensed under", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "use of cookies", "uses cookies",
    "enable javascript", "requires javascript", "subscribe to our newsletter", "powered by wordpress", "lorem ipsum", "click here to", "copyright (c)", "copyright ©",
]
#: A line that is one of these entries (case folded), and nothing else, is navigation.
ENTRIES = [
    "home", "menu", "search", "login", "log in", "log out", "sign in", "sign up", "register", "next", "previous", "next page", "previous page", "back to top",
    "read more", "contact us", "about us", "share", "print", "skip to content", "site map", "sitemap", "subscribe", "add to cart",
]
#: Sentence marks; a line of LEAST_WORDS or more without any is no prose.
MARKS = ".!?…:;。！？؟।"
LEAST_WORDS = 5
#: Of the characters of a document's words, how many of a hundred may stand in lines that fail.
MOST_LOST = 30


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, where a lambda would evaluate it for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _of(letters: str) -> str:
    """A pattern of one of these characters."""
    return "[" + letters.replace("$", r"\$").replace("&", r"\&") + "]"


def _count(text: Column, letters: str) -> Column:
    return F.regexp_count(text, F.lit(_of(letters)))


def _letters(words: Column) -> Column:
    """Code points in words."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s + F.length(x))


def punctuation_fails(line: Column, words: Column) -> Column:
    """No sentence mark in a line of some words; or more shouts (!!, ??) or symbols than one for two words."""
    n = F.size(words)
    without = (n >= LEAST_WORDS) & ~F.rlike(line, F.lit(_of(MARKS)))
    return without | (2 * F.regexp_count(line, F.lit(r"[!?]{2,}")) > n) | (2 * _count(line, SYMBOLS.replace("|", "")) > n)


def navigation_fails(line: Column, words: Column) -> Column:
    """Three dividers or more, one for each four words at least; or a line that is one entry of a menu."""
    dividers = _count(line, DIVIDERS)
    entry = F.lower(F.array_join(words, " ")).isin(ENTRIES)
    return ((dividers >= 3) & (4 * dividers >= F.size(words))) | entry


def boilerplate_fails(line: Column, words: Column) -> Column:
    """A phrase of boilerplate; or, in a line of some words, over two of five equal to the word before."""
    n = F.size(words)
    stutter = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(words, i) == F.get(words, i - 1)))
    # A lambda of one element, so that the line is folded once and not for each phrase.
    said = lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in PHRASES])
    return F.get(F.transform(F.array(F.lower(line)), said), F.lit(0)) | F.when(n >= LEAST_WORDS, 5 * stutter > 2 * n).otherwise(False)


def _repeated(df: DataFrame, width: int = 8) -> DataFrame:
    """df with ``n_repeat_words``: words in windows of ``width`` words that the row's ``words`` hold twice or more.

    Windows are told apart by a 64-bit hash first; those that share one are compared word by word. Only texts with such
    windows are sorted, and only those windows become strings.
    """
    n = F.size("words")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))
    df = _once(df, "_h", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, width))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = _once(df, "_s", F.when(twice, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))))

    def tied(rows: str, key: str) -> Column:
        at = lambda k: F.get(F.col(rows), k)[key]
        same = lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(rows) - 1), same), lambda k: F.get(F.col(rows), k)["i"])

    none = F.array().cast("array<int>")
    df = _once(df, "_tied", F.when(F.col("_s").isNotNull(), tied("_s", "h")).otherwise(none))
    bodies = F.array_sort(F.transform("_tied", lambda i: F.struct(F.array_join(F.slice("words", i, width), " ").alias("body"), i.alias("i"))))
    df = _once(df, "_b", F.when(F.size("_tied") > 0, bodies))
    df = _once(df, "_r", F.when(F.col("_b").isNotNull(), F.array_sort(tied("_b", "body"))).otherwise(none))
    gap = F.transform("_r", lambda i, k: F.least(F.lit(width), F.coalesce(F.get("_r", k + 1) - i, F.lit(width))))
    return df.withColumn("n_repeat_words", F.aggregate(gap, F.lit(0).cast("long"), lambda s, g: s + g)).drop("_h", "_s", "_tied", "_b", "_r")


def quality(docs: DataFrame, most_lost: int = MOST_LOST, least_words: int = 20, most_repeated: int = 30, text_col: str = "text") -> DataFrame:
    """docs' columns, and the base figures, ``line_fails`` (for each line, the rules it fails), ``clean_text``, ``lost_chars``, base_failed and kept.

    Every line with a word is held against the rules of punctuation, navigation and boilerplate; clean_text is what
    lines without a failure leave, joined by line feeds (lines without a word stay). A document is dropped when it fails the base figures
    (under ``least_words`` words, or over ``most_repeated`` of a hundred words in repeated 8-word windows), or when
    over ``most_lost`` of a hundred of its words' characters stand in lines that fail.

    The figures: n_words; word_chars, code points in words; n_symbols, characters of #*$%&|<>; n_dup_lines, lines with a
    word that equal an earlier one; n_repeat_words, words in 8-word windows found twice or more. All are exact, of the whole text, and
    need its row alone, so nothing is shuffled. Equal texts come out equal.

    Null and empty texts have no words, fail the base figures and have an empty clean_text. Repeated rows and null ids are rows
    like others; other columns are kept, those named like an added one are replaced. An empty table gives an empty result.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_fails", "clean_text", "lost_chars", "base_failed", "kept"]
    own = [c for c in docs.columns if c.lower() not in made]
    names = {c: f"_c{i}" for i, c in enumerate(own)}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], text.alias("text"))
    split = lambda line: F.struct(line.alias("line"), F.filter(F.split(line, SPACE), lambda x: x != "").alias("w"))
    df = _once(df, "lines", F.transform(F.split("text", "\n"), split))
    df = _once(df, "words", F.flatten(F.transform("lines", lambda s: s["w"])))
    df = _repeated(df)
    rules = {"punctuation": punctuation_fails, "navigation": navigation_fails, "boilerplate": boilerplate_fails}
    failed = lambda s: F.filter(F.array(*[F.when((F.size(s["w"]) > 0) & f(s["line"], s["w"]), name) for name, f in rules.items()]), lambda x: x.isNotNull())
    df = _once(df, "line_fails", F.transform("lines", failed))
    stays = lambda k: F.size(F.get("line_fails", k)) == 0
    clean = F.array_join(F.transform(F.filter("lines", lambda s, k: stays(k)), lambda s: s["line"]), "\n")
    worded = F.transform(F.filter("lines", lambda s: F.size(s["w"]) > 0), lambda s: s["line"])
    df = _once(df, "worded", worded)
    df = df.select(
        *names.values(),
        F.size("words").cast("long").alias("n_words"),
        _letters(F.col("words")).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "line_fails",
        clean.alias("clean_text"),
        _letters(F.flatten(F.transform(F.filter("lines", lambda s, k: ~stays(k)), lambda s: s["w"]))).alias("lost_chars"),
    )
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    df = df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars")))
    return df.select(*[F.col(n).alias(c) for c, n in names.items()], *made)


def op13_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", F.sha2("clean_text", 256).alias("clean_sha256"))


def _either(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


SQL = {
    "op13_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS body
  FROM w, unnest(range(1, greatest(len(words) - 6, 1))) AS u(i)
),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, body) > 1),
cov AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(gap, 8))) AS BIGINT) AS n
  FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM rep) GROUP BY doc_id
),
l AS (
  SELECT doc_id, no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d)
),
m AS (
  SELECT *, len(lw) AS n,
    length(regexp_replace(line, '[^{MARKS}]', '', 'g')) AS marks,
    length(regexp_replace(line, '[^#*$%&<>]', '', 'g')) AS syms,
    length(regexp_replace(line, '[^{DIVIDERS}]', '', 'g')) AS dividers,
    len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouts,
    len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) AS stutter,
    len(list_filter([{_either(PHRASES)}], lambda p: contains(lower(line), p))) AS phrases,
    list_contains([{_either(ENTRIES)}], lower(array_to_string(lw, ' '))) AS entry
  FROM l
),
f AS (
  SELECT doc_id, no, line, n, n > 0 AND (
      (n >= 5 AND marks = 0) OR 2 * shouts > n OR 2 * syms > n
      OR (dividers >= 3 AND 4 * dividers >= n) OR entry
      OR phrases > 0 OR (n >= 5 AND 5 * stutter > 2 * n)) AS fails
  FROM m
),
g AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT fails), '') AS clean
  FROM f GROUP BY doc_id
),
b AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    length(regexp_replace(clean, '[\x20\x09-\x0D]+', '', 'g')) AS clean_chars, sha256(clean) AS clean_sha256
  FROM w JOIN g ON g.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (word_chars - clean_chars) <= {MOST_LOST} * word_chars AS kept,
  word_chars - clean_chars AS lost_chars, clean_sha256
FROM b
""",
}
QUERIES = {"op13_quality": op13_quality}

"""Text functions of facts: tokens, terms, names, clipping and redaction, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be",
    "been", "this", "that", "these", "those", "it", "its", "as", "at", "by", "from", "you", "we", "they", "he", "she",
    "them", "his", "her", "our", "your", "their", "not", "no", "yes", "so", "if", "then", "there", "here", "what",
    "when", "where", "which", "who", "how", "why", "will", "would", "can", "could", "should", "shall", "may", "might",
    "do", "does", "did", "done", "have", "has", "had", "having", "let", "us", "lets", "now", "today", "video",
]
#: Capitalised words that name nothing.
NAME_STOPWORDS = [
    "The", "And", "For", "With", "From", "That", "This", "These", "Those", "Your", "Our", "Their", "Its", "Monday",
    "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April",
    "June", "July", "August", "September", "October", "November", "December",
]
#: Forms of secrets, for opt-in redaction.
SECRETS = {
    "api_key": r"\b(sk-[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,})\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
#: Forms of credentials, removed from every agent-facing text.
CREDENTIAL_ASSIGNMENT = (
    r"(?i)((?<![A-Za-z])[A-Za-z0-9_]*(?:password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|token))(\s*[:=]\s*)(\S.*)$"
)
CREDENTIALS = (
    r"(?<![A-Za-z0-9])(sk-\S{6,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}",
)
#: Shell prompts, and error forms with the most specific first.
PROMPT = r"^(?:[\w.\-]+@[\w.\-]+:\S*\s*[$#%]|(?:PS\s*)?[A-Za-z]:\\\S*\s*>|[$>%])\s+(\S.*)$"
ERRORS = {
    "traceback": r"\bTraceback\b",
    "http_status": r"\b[45]\d{2}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
    "exception": r"\b\w*(?:Error|Exception)\b",
    "failure": r"\b(?:FAILED|FAIL|ERROR|Failed)\b",
}


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits, in order, repeats kept; none for null."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normal_line(text: Column) -> Column:
    """Lower case with blanks collapsed, for comparing recognised lines."""
    return F.lower(collapse(text))


def normal_name(text: Column) -> Column:
    """An entity's name for comparison: letters, digits, underscores, blanks and $ . : / - only, lower case."""
    return normal_line(F.regexp_replace(text, r"[^\p{L}\p{N}_\s$.:/\-]", ""))


def clip(text: Column, limit: int = 160) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def terms(text: Column) -> Column:
    """White-space words without outer punctuation, lower case, three characters or more."""
    bare = lambda w: F.regexp_replace(w, r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", "")
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), bare)
    return F.transform(F.filter(words, lambda w: F.length(w) >= 3), F.lower)


def content_terms(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(terms(text), lambda w: ~F.array_contains(stop, w) & ~w.rlike(r"^\d+$")))


def candidate_names(text: Column) -> Column:
    """Quoted strings of 3 to 80 characters, then phrases of one to four capitalised words; no bare stop words."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(
        F.regexp_extract_all(t, F.lit(r'"([^"]{3,80})"'), 1),
        F.regexp_extract_all(t, F.lit(r"\b([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+){0,3})\b"), 1),
    )
    stop = F.array(*map(F.lit, NAME_STOPWORDS))
    named = lambda c: (F.length(c) >= 3) & (F.size(F.array_except(F.split(c, r"\s+"), stop)) > 0)
    return F.filter(F.transform(found, lambda x: F.trim(x)), named)


def command_in(text: Column) -> Column:
    """The command behind the first shell prompt of the text, or null. A first word that ends in a colon is a quote."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x))
    command = lambda x: F.trim(F.regexp_extract(x, PROMPT, 1))
    good = F.filter(lines, lambda x: x.rlike(PROMPT) & ~command(x).rlike(r"^\S*:(\s|$)"))
    return F.when(F.size(good) > 0, command(F.get(good, F.lit(0))))


def error_in(text: Column) -> Column:
    """The name of the first error form found, or null."""
    out = None
    for name, pattern in ERRORS.items():
        out = F.when(text.rlike(pattern), F.lit(name)) if out is None else out.when(text.rlike(pattern), F.lit(name))
    return out


def redact(text: Column, kinds: tuple[str, ...] = tuple(SECRETS)) -> Column:
    for k in kinds:
        text = F.regexp_replace(text, SECRETS[k], "[REDACTED]")
    return text


def scrub(text: Column, limit: int = 300) -> Column:
    """An agent-facing text: credentials removed, blanks collapsed, cut to ``limit``; empty for null."""
    t = F.regexp_replace(collapse(text), CREDENTIAL_ASSIGNMENT, "$1$2[REDACTED]")
    for p in CREDENTIALS:
        t = F.regexp_replace(t, p, "[REDACTED]")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def first_of_each(lines: Column) -> Column:
    """The lines joined by line feeds, blanks collapsed, repeats that differ in case alone dropped, order kept."""
    flat = F.filter(F.transform(lines, collapse), lambda x: x != "")
    seen = F.aggregate(
        flat,
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.when(F.array_contains(acc["keys"], F.lower(x)), acc).otherwise(
            F.struct(F.array_append(acc["keys"], F.lower(x)).alias("keys"), F.array_append(acc["kept"], x).alias("kept"))
        ),
    )
    return F.array_join(seen["kept"], "\n")

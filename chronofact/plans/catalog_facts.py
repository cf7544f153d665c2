"""Queries over facts and scalar functions, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.functions import scalars as S
from chronofact.functions import text as X
from chronofact.functions.timecode import format_millis, format_span, parse_timecode
from chronofact.operators.intervals import closed, contains
from chronofact.session import table
from chronofact.sources.facts import FACTS_SQL, facts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(f"""WITH {FACTS_SQL} SELECT video_id, modality, fact_id, "start", "end", md5(text) AS text_md5, kind, language, confidence FROM facts""")
def facts_projection(spark, sf) -> DataFrame:
    return facts(spark, sf).withColumn("text_md5", F.md5("text")).drop("text")


@query(f"""WITH {FACTS_SQL} SELECT modality, count(*) AS n, count(DISTINCT video_id) AS videos, min("start") AS first_start, max("end") AS last_end FROM facts GROUP BY modality""")
def facts_by_modality(spark, sf) -> DataFrame:
    return facts(spark, sf).groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_id").alias("videos"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query(f"""WITH {FACTS_SQL} SELECT video_id, coalesce(count(*) FILTER (modality = 'transcript'), 0) AS transcript, count(*) FILTER (modality = 'ocr') AS ocr,
  count(*) FILTER (modality = 'vision') AS vision, count(*) FILTER (modality = 'events') AS events FROM facts GROUP BY video_id""")
def coverage_pivot(spark, sf) -> DataFrame:
    n = lambda m: F.count_if(F.col("modality") == m).alias(m)
    return facts(spark, sf).groupBy("video_id").agg(*map(n, ("transcript", "ocr", "vision", "events")))


@query(f"""WITH {FACTS_SQL} SELECT video_id, modality, fact_id, "start", "end" FROM facts WHERE "start" - 5 <= 100 AND 100 <= "end" + 5""")
def point_lookup(spark, sf) -> DataFrame:
    return facts(spark, sf).where((F.col("start") - 5 <= 100) & (F.lit(100) <= F.col("end") + 5)).select("video_id", "modality", "fact_id", "start", "end")


@query(f"""WITH {FACTS_SQL} SELECT video_id, modality, fact_id, "start", "end" FROM facts WHERE ("start" <= 90 AND 90 < "end") OR "start" = 90""")
def instant_containment(spark, sf) -> DataFrame:
    return facts(spark, sf).where(contains(F.col("start"), F.col("end"), F.lit(90.0))).select("video_id", "modality", "fact_id", "start", "end")


@query(f"""WITH {FACTS_SQL} SELECT video_id, modality, fact_id, "start", "end" FROM facts WHERE "end" >= 60 AND "start" <= 120 AND modality IN ('transcript', 'events')""")
def range_scan(spark, sf) -> DataFrame:
    rows = facts(spark, sf, "transcript", "events")
    return rows.where(closed(F.col("start"), F.col("end"), F.lit(60.0), F.lit(120.0))).select("video_id", "modality", "fact_id", "start", "end")


@query(f"""WITH {FACTS_SQL} SELECT fact_id, video_id, "start" FROM facts WHERE modality = 'events' AND kind IN ('error', 'signup') AND "start" BETWEEN 30 AND 300""")
def event_filter(spark, sf) -> DataFrame:
    return facts(spark, sf, "events").where(F.col("kind").isin("error", "signup") & F.col("start").between(30, 300)).select("fact_id", "video_id", "start")


@query("""SELECT event_type, user_id % 10 AS user_group, count(*) AS n FROM events GROUP BY ALL""")
def event_histogram(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 10).alias("user_group")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FACTS_SQL}, r AS (SELECT unnest(['ocr_0', 'evt_5', 'utt_0_1', 'ocr_none']) AS ref)
SELECT r.ref, f.video_id, f.fact_id IS NULL AS missing FROM r LEFT JOIN facts f ON f.fact_id = r.ref""")
def evidence_refs(spark, sf) -> DataFrame:
    refs = spark.createDataFrame([("ocr_0",), ("evt_5",), ("utt_0_1",), ("ocr_none",)], "ref string")
    return refs.join(facts(spark, sf), F.col("ref") == F.col("fact_id"), "left").select("ref", "video_id", F.col("fact_id").isNull().alias("missing"))


@query(f"""WITH {FACTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "start", fact_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM facts WHERE modality = 'events')
SELECT video_id, fact_id FROM n WHERE n <= 7 OR i IN (SELECT k * n // 7 FROM range(7) t(k))""")
def evenly_spread(spark, sf) -> DataFrame:
    """Seven events of each recording, evenly by rank: places k * n // 7."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id")
    rows = facts(spark, sf, "events").withColumn("i", F.row_number().over(w.orderBy("start", "fact_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    places = F.array(*[F.floor(F.lit(k) * F.col("n") / 7) for k in range(7)])
    return rows.where((F.col("n") <= 7) | F.array_contains(places, F.col("i").cast("long"))).select("video_id", "fact_id")


_TC = """lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')"""


@query(f"""WITH t AS (SELECT event_id, CAST(round(epoch_us(ts) % 86400000000 / 1000.0) AS BIGINT) AS ms FROM events) SELECT event_id, {_TC} AS tc FROM t""")
def timecode_format(spark, sf) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) % 86400000000
    return table(spark, sf, "events").select("event_id", format_millis(at / 1000.0).alias("tc"))


@query("""SELECT t, s FROM (VALUES ('90', 90.0), ('1:30', 90.0), ('01:02:03.5', 3723.5), ('3:75', NULL), ('1:2:3:4', NULL), ('', NULL), ('abc', NULL), ('3:21 pm', NULL), ('-5', NULL), ('1:60', NULL), ('12.25', 12.25)) v(t, s0), LATERAL (SELECT CAST(s0 AS DOUBLE) AS s)""")
def timecode_parse(spark, sf) -> DataFrame:
    rows = [(t,) for t in ("90", "1:30", "01:02:03.5", "3:75", "1:2:3:4", "", "abc", "3:21 pm", "-5", "1:60", "12.25")]
    return spark.createDataFrame(rows, "t string").select("t", parse_timecode(F.col("t")).alias("s"))


@query(f"""WITH {FACTS_SQL}, m AS (SELECT fact_id, "start", "end", CAST(round("start" * 1000) AS BIGINT) AS a, CAST(round("end" * 1000) AS BIGINT) AS b FROM facts),
l AS (SELECT fact_id, "start", "end", (SELECT {_TC} FROM (SELECT a AS ms)) AS x, (SELECT {_TC} FROM (SELECT b AS ms)) AS y FROM m)
SELECT fact_id, CASE WHEN "end" <= "start" THEN x ELSE x || ' → ' || y END AS label FROM l""")
def span_label(spark, sf) -> DataFrame:
    return facts(spark, sf).select("fact_id", format_span(F.col("start"), F.col("end")).alias("label"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' ') AS tokens FROM documents""")
def tokenize(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_BARE = r"""lower(regexp_replace(w, '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g'))"""


@query(rf"""WITH w AS (SELECT doc_id, {_BARE} AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents))
SELECT doc_id, count(DISTINCT t) AS n_terms, string_agg(DISTINCT t, ' ' ORDER BY t) AS terms FROM w
WHERE length(t) >= 3 AND t NOT IN ({_STOP}) AND NOT regexp_full_match(t, '\d+') GROUP BY doc_id""")
def content_terms(spark, sf) -> DataFrame:
    t = F.array_sort(X.content_terms(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.array_join(t, " ").alias("terms")).where("n_terms > 0")


@query(rf"""SELECT doc_id, lower({FLAT.format('text')}) AS norm FROM documents""")
def ocr_normalize(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normal_line(F.col("text")).alias("norm"))


@query(rf"""SELECT doc_id, lower({FLAT.format(r"regexp_replace(text, '[^\p{L}\p{N}_\s$.:/-]', '', 'g')")}) AS name FROM documents""")
def entity_normalize(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normal_name(F.col("text")).alias("name"))


@query(rf"""WITH t AS (SELECT doc_id, {FLAT.format('text')} AS f FROM documents) SELECT doc_id, CASE WHEN length(f) <= 160 THEN f ELSE substr(f, 1, 159) || '…' END AS clipped FROM t""")
def clip_text(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.clip(F.col("text")).alias("clipped"))


_LINES = ["$ npm run build", "user@host:~/app$ ls -la", "PS C:\\Users\\me> dir", "> Note: quoted", "# Introduction", "C:\\> cls", "% make", "plain text", "$", "$ FOO: bar",
          "Traceback (most recent call last)", "500 Internal Server Error", "ValueError: bad", "an error occurred", "FAILED tests", "404 Not Found", "build ok", "text\n$ git push"]
_VALUES = "(VALUES " + ", ".join("('" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for x in _LINES) + ") v(line)"


@query(rf"""SELECT line, nullif(list_extract(list_filter(list_transform(string_split(line, chr(10)), lambda x: CASE
  WHEN regexp_matches(trim(regexp_extract(trim(x), '^(?:[A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+:\S*\s*[$#%]|(?:PS\s*)?[A-Za-z]:\\\S*\s*>|[$>%])\s+(\S.*)$', 1)), '^\S*:(\s|$)') THEN ''
  ELSE trim(regexp_extract(trim(x), '^(?:[A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+:\S*\s*[$#%]|(?:PS\s*)?[A-Za-z]:\\\S*\s*>|[$>%])\s+(\S.*)$', 1)) END), lambda c: c <> ''), 1), '') AS command
FROM (SELECT line FROM {_VALUES} UNION ALL SELECT text FROM documents) t""")
def command_detect(spark, sf) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _LINES], "line string").union(table(spark, sf, "documents").select("text"))
    return rows.select("line", X.command_in(F.col("line")).alias("command"))


@query(rf"""SELECT line, CASE WHEN regexp_matches(line, '\bTraceback\b') THEN 'traceback' WHEN regexp_matches(line, '\b[45]\d{{2}}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b') THEN 'http_status'
  WHEN regexp_matches(line, '\b\w*(?:Error|Exception)\b') THEN 'exception' WHEN regexp_matches(line, '\b(?:FAILED|FAIL|ERROR|Failed)\b') THEN 'failure' END AS error
FROM (SELECT line FROM {_VALUES} UNION ALL SELECT text FROM documents) t""")
def error_detect(spark, sf) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _LINES], "line string").union(table(spark, sf, "documents").select("text"))
    return rows.select("line", X.error_in(F.col("line")).alias("error"))


@query("SELECT doc_id, " + "regexp_replace(" * 4 + "text" + "".join(f", '{p}', '[REDACTED]', 'g')" for p in X.SECRETS.values()) + " AS redacted FROM documents")
def redact_secrets(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.redact(F.col("text")).alias("redacted"))


#: The credential forms with the character before them as a group, as the SQL engine's expressions have no look-behind.
_ASSIGNED = r"(?i)(^|[^A-Za-z])([A-Za-z0-9_]*(?:password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|token))(\s*[:=]\s*)(\S.*)$"
_KEYS = r"(^|[^A-Za-z0-9])(?:sk-\S{6,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})"
_PLANTED = "text || CASE doc_id % 5 WHEN 0 THEN ' my_token: abc def' WHEN 1 THEN ' x-sk-' || doc_id || 'abcdef sk-abcdef1 end' WHEN 2 THEN ' Bearer abcdefghijklmnop= -----BEGIN RSA PRIVATE KEY-----' WHEN 3 THEN ' desk-abcdefgh passwordless=' ELSE '' END"


@query(rf"""WITH d AS (SELECT doc_id, {_PLANTED} AS text FROM documents UNION ALL SELECT -1 - doc_id, right({_PLANTED}, 90) FROM documents),
a AS (SELECT doc_id, regexp_replace({FLAT.format('text')}, '{_ASSIGNED}', '\1\2\3[REDACTED]', 'g') AS t FROM d),
k AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '{_KEYS}', '\1[REDACTED]', 'g'), '-----BEGIN [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g'), '(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{{16,}}', '[REDACTED]', 'g') AS t FROM a)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 299) || '…' END AS scrubbed FROM k""")
def scrub_credentials(spark, sf) -> DataFrame:
    """Every text with a credential planted after it, and once more its last 90 characters, so that no cut hides what was scrubbed."""
    text = F.expr(_PLANTED)
    rows = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    both = rows.unionByName(rows.select((-1 - F.col("doc_id")).alias("doc_id"), F.expr("right(text, 90)").alias("text")))
    return both.select("doc_id", X.scrub(F.col("text")).alias("scrubbed"))


_EPHEMERAL = ", ".join(f"'{p}'" for p in S.EPHEMERAL)
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?"
_PARTS = f"""SELECT page_id, lower(regexp_extract(u, '{_URL}', 1)) AS scheme, lower(regexp_extract(u, '{_URL}', 2)) AS host, regexp_extract(u, '{_URL}', 3) AS port,
  regexp_extract(u, '{_URL}', 4) AS path, string_split(regexp_extract(u, '{_URL}', 5), '&') AS params"""
_ADD = "(SELECT page_id, url || CASE WHEN contains(url, '?') OR contains(url, '#') THEN '' ELSE '?Token=a&v=' || page_id || '&sig=x' END AS u FROM pages)"


def _pages(spark, sf) -> DataFrame:
    more = F.when(F.col("url").contains("?") | F.col("url").contains("#"), F.lit("")).otherwise(F.concat(F.lit("?Token=a&v="), "page_id", F.lit("&sig=x")))
    return table(spark, sf, "pages").select("page_id", F.concat("url", more).alias("u"))


@query(f"""WITH p AS ({_PARTS} FROM {_ADD}), q AS (SELECT *, array_to_string(list_filter(params, lambda x: x <> '' AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN ({_EPHEMERAL})), '&') AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical,
  'src_' || substr(sha256(scheme || '://' || host), 1, 12) AS source_id FROM q""")
def url_canonical(spark, sf) -> DataFrame:
    u = F.col("u")
    return _pages(spark, sf).select("page_id", S.canonical_url(u).alias("canonical"), S.stable_id("src", F.concat(S._scheme(u), F.lit("://"), S._host(u))).alias("source_id"))


@query(f"""WITH p AS ({_PARTS} FROM {_ADD}), q AS (SELECT *, array_to_string(list_transform(list_filter(params, lambda x: x <> ''), lambda x: CASE WHEN lower(regexp_extract(x, '^([^=]*)', 1)) IN ({_EPHEMERAL}) THEN regexp_extract(x, '^([^=]*)', 1) || '=***' ELSE x END), '&') AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN port = '' THEN '' ELSE ':' || port END || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS redacted FROM q""")
def url_redact(spark, sf) -> DataFrame:
    return _pages(spark, sf).select("page_id", S.redact_url(F.col("u")).alias("redacted"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE w * h / (100 + 100 - w * h) END, 6) AS iou
FROM (SELECT l_orderkey, l_linenumber, 10 - abs(l_quantity % 20) AS w, 10 - l_discount * 100 AS h FROM lineitem)""")
def box_iou(spark, sf) -> DataFrame:
    dx, dy = F.abs(F.col("l_quantity") % 20), F.col("l_discount") * 100
    ten = F.lit(10.0)
    box = S.iou([F.lit(0.0), F.lit(0.0), ten, ten], [dx, dy, dx + ten, dy + ten])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(box, 6).alias("iou"))


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest(l_tax * 20 - 0.2, 0), 1), 4) AS conf, round(least(greatest(exp(-l_quantity / 10), 0), 1), 4) AS from_logprob FROM lineitem""")
def confidence_scale(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.confidence(F.col("l_tax") * 20 - 0.2).alias("conf"), S.confidence_of_logprob(-F.col("l_quantity") / 10).alias("from_logprob"))


@query(rf"""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50""")
def event_attributes(spark, sf) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_id", "event_type", k.alias("k")).where("k >= 50")


@query(f"""WITH {FACTS_SQL} SELECT fact_id, CASE modality WHEN 'vision' THEN 'model_interpretation' WHEN 'events' THEN 'detected' ELSE 'observed' END AS evidence_kind, CAST(length(text) // 4 + 50 AS BIGINT) AS tokens FROM facts""")
def evidence_kinds(spark, sf) -> DataFrame:
    from chronofact.operators.packaging import token_estimate

    kind = F.when(F.col("modality") == "vision", "model_interpretation").when(F.col("modality") == "events", "detected").otherwise("observed")
    return facts(spark, sf).select("fact_id", kind.alias("evidence_kind"), token_estimate(F.col("text")).cast("long").alias("tokens"))

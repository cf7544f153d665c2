"""Truth tables of the scalar functions."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from chronofact.functions import scalars as S
from chronofact.functions import text as X
from chronofact.functions.timecode import format_span, format_timecode, parse_timecode
from chronofact.operators.tracking import grams, may_reach, similarity
from chronofact.plans import catalog_facts
from chronofact.sources.adapters import SourceError, adapter_for, blocked_address, resolve_redirect, validate_url


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,seconds", [("0", 0), ("90", 90), ("1:30", 90), ("01:02:03.5", 3723.5), ("59:59", 3599), ("100:00:00", 360000)])
def test_timecodes_read(spark, text, seconds):
    assert one(spark, parse_timecode(F.lit(text))) == seconds


@pytest.mark.parametrize("text", ["3:75", "1:2:3:4", "", "abc", "3:21 pm", "-5", "1:60"])
def test_timecodes_refused(spark, text):
    assert one(spark, parse_timecode(F.lit(text))) is None


@pytest.mark.parametrize("s,text", [(0.0, "00:00:00.000"), (59.9996, "00:01:00.000"), (3661.25, "01:01:01.250"), (-1.5, "-00:00:01.500"), (float("nan"), None), (float("inf"), None)])
def test_timecodes_written(spark, s, text):
    assert one(spark, format_timecode(F.lit(s))) == text


def test_half_milliseconds_of_events_round_up(spark, tmp_path):
    at = ["2024-01-04 04:34:45.985500", "2024-01-20 00:34:39.338500", "2024-01-01 00:00:00.000499", "2024-01-01 23:59:59.999500"]
    spark.createDataFrame(list(enumerate(at)), "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = [r.tc for r in catalog_facts.timecode_format(spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got == ["04:34:45.986", "00:34:39.339", "00:00:00.000", "24:00:00.000"]


def test_spans(spark):
    assert one(spark, format_span(F.lit(1.0), F.lit(2.0))) == "00:00:01.000 → 00:00:02.000"
    assert one(spark, format_span(F.lit(2.0), F.lit(2.0))) == "00:00:02.000"


COMMANDS = {
    "$ npm run migrate": "npm run migrate", "user@host:~/app$ ls -la": "ls -la", "root@box:/etc# cat x": "cat x", "PS C:\\Users\\me> dir": "dir", "C:\\tools> run.bat": "run.bat",
    "% make": "make", "> echo hi": "echo hi", "intro\n  $ git push": "git push",
    "# Introduction": None, "> Note: quoted": None, "$": None, "$5 off": None, "price is $ 5": None, "plain": None, "$ FOO: bar": None, "": None,
}


@pytest.mark.parametrize("text", COMMANDS)
def test_commands(spark, text):
    assert one(spark, X.command_in(F.lit(text))) == COMMANDS[text]


ERRORS = {
    "Traceback (most recent call last):": "traceback", "500 Internal Server Error": "http_status", "404 Not Found": "http_status", "ConnectionError: refused": "exception", "NullPointerException": "exception",
    "3 tests FAILED": "failure", "ERROR something": "failure", "an error occurred": None, "errors": None, "500 units sold": None, "failing": None, "": None,
}


@pytest.mark.parametrize("text", ERRORS)
def test_errors(spark, text):
    assert one(spark, X.error_in(F.lit(text))) == ERRORS[text]


def test_words(spark):
    assert one(spark, X.tokens(F.lit("Straße foo_bar 3.5 — É"))) == ["strasse", "foo", "bar", "3", "5", "é"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, X.content_terms(F.lit("The (pricing), pricing! of 2024 and it's $499."))) == ["pricing", "it's", "$499"]
    assert one(spark, X.normal_name(F.lit("  Foo's  BAR! $9/mo "))) == "foos bar $9/mo"
    assert one(spark, X.candidate_names(F.lit('The "quick fox" met Acme Corp on Monday. The'))) == ["quick fox", "Acme Corp"]
    assert one(spark, X.first_of_each(F.array(F.lit("a  b"), F.lit("A B"), F.lit(" "), F.lit("c")))) == "a b\nc"


def test_clip(spark):
    assert one(spark, X.clip(F.lit("a " * 100), 10)) == "a a a a a…"
    assert one(spark, X.clip(F.lit(" a\n b "), 10)) == "a b"


@pytest.mark.parametrize("text,want", [
    ("mail me@example.com now", "mail [REDACTED] now"), ("call 555-123-4567", "call [REDACTED]"), ("AKIA" + "A" * 16, "[REDACTED]"), ("-----BEGIN RSA PRIVATE KEY-----", "[REDACTED]"), ("nothing here", "nothing here"),
])
def test_redaction(spark, text, want):
    assert one(spark, X.redact(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [
    ("OPENAI_API_KEY=sk- abc def", "OPENAI_API_KEY=[REDACTED]"), ("password: hunter2 and more", "password: [REDACTED]"), ("use sk-abcdefgh now", "use [REDACTED] now"),
    ("Bearer abcdefghijklmnop1234", "[REDACTED]"), ("mail me@example.com", "mail me@example.com"), ("tokenised text", "tokenised text"),
])
def test_credentials(spark, text, want):
    assert one(spark, X.scrub(F.lit(text))) == want


def test_numbers(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert math.isclose(one(spark, S.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))), 25 / 175)
    assert one(spark, S.iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0.0
    assert one(spark, S.iou([F.lit(None).cast("double")] * 4, box(0, 0, 1, 1))) == 1.0
    assert one(spark, S.significant(F.lit(0.0123456))) == 0.01235 and one(spark, S.significant(F.lit(0.0))) == 0.0
    assert math.isclose(one(spark, S.rational(F.lit("30000/1001"))), 29.97002997002997) and one(spark, S.rational(F.lit("1/0"))) is None
    assert one(spark, S.confidence_of_logprob(F.lit(-0.1))) == 0.9048


@pytest.mark.parametrize("url,want", [
    ("HTTPS://User:pw@Example.COM:443/A/b?token=1&v=2#top", "https://example.com/A/b?v=2"), ("http://h:8080", "http://h:8080/"), ("http://h/v?SIG=x", "http://h/v"), ("http://h:80/x?a=&b", "http://h/x?a=&b"),
])
def test_urls(spark, url, want):
    assert one(spark, S.canonical_url(F.lit(url))) == want


def test_url_for_logs(spark):
    assert one(spark, S.redact_url(F.lit("http://u:p@h/x?sig=abc&v=1#f"))) == "http://h/x?sig=***&v=1"


@pytest.mark.parametrize("url", ["ftp://h/x", "http://127.0.0.1/", "http://10.0.0.1/", "http://[::1]/", "http://169.254.1.1/x", "http://u:p@h.org/", "http://h.org/a b", "http://localhost/", "http:///x", "http://[::ffff:10.0.0.1]/"])
def test_refused_addresses(url):
    with pytest.raises(SourceError):
        validate_url(url)


def test_allowed_addresses_and_adapters():
    assert validate_url("https://example.org/x") == "https://example.org/x"
    assert resolve_redirect("https://example.org/a/b", "../c") == "https://example.org/c"
    with pytest.raises(SourceError):
        validate_url("https://example.org/", resolve=lambda h: ["192.168.0.1"])
    assert blocked_address("224.0.0.1") and not blocked_address("8.8.8.8")
    assert adapter_for("/data/x.json").name == "files" and adapter_for("https://x/y").name == "url"


def test_similarity():
    assert similarity("abc", "abc") == 1.0 and similarity("ab", "abcde") == 0.0
    assert similarity("hello world", "hello word") == SequenceMatcher(None, "hello world", "hello word").ratio()


def test_may_reach_loses_no_pair():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abc de") for _ in range(rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.choice("abc dez")] * rng.randint(0, 2)
        b = "".join(b)
        for least in (0.6, 0.88, 1.0):
            assert may_reach(a, b, grams(a), grams(b), least) or similarity(a, b) < least
    assert not may_reach("error at line", "login page shown", grams("error at line"), grams("login page shown"), 0.88)

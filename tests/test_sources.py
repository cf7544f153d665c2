"""Readers, writers, settings, plugins, streams and the API."""

import gzip
import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chronofact.api import Collection
from chronofact.plans import catalog_planning as planning
from chronofact.plugins import Registry, Settings, default
from chronofact.sources import readers as R
from chronofact.sources.adapters import LocalFiles
from chronofact.session import discard, materialize, passing
from chronofact.sources.facts import facts
from chronofact.sources.workspace import Workspace
from chronofact.operators.tracking import text_tracks
from chronofact.streaming import facts as S
from chronofact.streaming.tracks import stream_tracks

SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello <i>there</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n{\\an8}Second line\ncontinues 42\n\n3\n00:00:05,000 --> 00:00:06,000\n\n"
VTT = "﻿WEBVTT\r\n\r\n01:02.500 --> 01:04.000 align:start\r\n<v Ann>Hi all\r\n"


def test_subtitles(spark):
    got = R.parse_cues(spark.createDataFrame([("a.srt", SRT), ("b.vtt", VTT), ("c", "")], "path string, payload string")).orderBy("path", "start").collect()
    assert [(r.path, r.start, r.end, r.speaker, r.text) for r in got] == [
        ("a.srt", 1.0, 2.5, None, "Hello there"), ("a.srt", 3.0, 4.0, None, "Second line continues 42"), ("b.vtt", 62.5, 64.0, "Ann", "Hi all"),
    ]


def test_recognition_and_logs(spark):
    words = [(1, 1, 1, 1, 2, 30, 5, 20, 10, 80.0, "in"), (1, 1, 1, 1, 1, 0, 4, 25, 12, 90.0, "Sign"), (1, 1, 1, 2, 1, 0, 30, 5, 5, 95.0, "|"), (1, 1, 1, 1, 3, 60, 5, 9, 9, 5.0, "zz")]
    tsv = spark.createDataFrame(words, "page int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string")
    assert [(r.text, r.confidence, r.x1, r.y1, r.x2, r.y2) for r in R.parse_recognition(tsv).collect()] == [("Sign in", 0.85, 0, 4, 50, 16)]
    log = spark.createDataFrame([("f", 1, "frame pts_time:1.5 x"), ("f", 2, "lavfi.scene_score=0.4"), ("f", 3, "pts_time:9"), ("f", 4, "silence_start: 2.5"), ("f", 5, "silence_end: 4.0 | d"), ("f", 6, "silence_start: 8")], "path string, n int, line string")
    assert [(r.pts, r.score) for r in R.parse_scene_scores(log).collect()] == [(1.5, 0.4)]
    assert [(r.start, r.end) for r in R.parse_silences(log).orderBy("start").collect()] == [(2.5, 4.0), (8.0, None)]


def test_documents_round_trip(spark, tmp_path):
    doc = {"vctx_version": "1.0", "video": {"id": "v", "duration": 9.0}, "ocr": [{"id": "ocr_0000", "start": 1.0, "end": 2.0, "text": "x"}], "later_field": 1}
    (tmp_path / "a.vctx.gz").write_bytes(gzip.compress(json.dumps(doc).encode()))
    docs = R.migrate(R.read_documents(spark, f"{tmp_path}/a.vctx.gz"))
    row = docs.first()
    assert row.vctx_version == "1.1" and row.transcript == [] and row.ocr[0].text == "x"
    assert [(r.video_id, r.id) for r in R.fact_table(docs, "ocr").collect()] == [("v", "ocr_0000")]
    R.write_documents(docs, f"{tmp_path}/out")
    assert R.fact_table(R.read_documents(spark, f"{tmp_path}/out/*.json.gz"), "ocr").count() == 1
    (tmp_path / "b.vctx").write_text(json.dumps(doc | {"vctx_version": "2.0"}))
    with pytest.raises(Exception, match="unreadable document version 2.0"):
        R.read_documents(spark, f"{tmp_path}/b.vctx").collect()
    assert "vctx_version" in R.json_schema(spark)


def test_page_lines(spark):
    pages = spark.createDataFrame([(1, "<html><script>var x;</script><p>One</p>\n<b>Two</b></html>"), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.text) for r in R.page_lines(pages).collect()] == [(1, "One"), (1, "Two")]


def test_workspace_makes_once_and_forgets_on_demand(spark, tmp_path):
    w, made = Workspace(spark, "work", f"file://{tmp_path}"), []

    def make(n):
        return lambda: made.append(n) or spark.range(n)

    assert w.get_or_make("abc", "ocr", make(3), "1", {"a": 1}).count() == 3
    assert w.get_or_make("abc", "ocr", make(4), "1", {"a": 1}).count() == 3
    assert w.get_or_make("abc", "ocr", make(5), "1", {"a": 2}).count() == 5 and w.get_or_make("abc", "asr", make(6)).count() == 6
    assert made == [3, 5, 6]
    assert sorted((r.stage, r.content, r.version) for r in w.manifest().collect()) == [("asr", "abc", "1"), ("ocr", "abc", "1"), ("ocr", "abc", "1")]
    with pytest.raises(ZeroDivisionError):
        w.get_or_make("abc", "bad", lambda: 1 / 0)
    spark.range(1).write.parquet(f"{w.path('open')}/left-by-a-lost-writer")
    assert w.sweep(1.0) == 0 and w.invalidate("ocr") == 2 and w.manifest().count() == 1
    for d in tmp_path.glob("work/*/*"):
        os.utime(d, (1_000_000_000, 1_000_000_000))
    assert w.sweep(1.0) == 2 and w.manifest().count() == 0 and w.get_or_make("abc", "asr", make(7)).count() == 7
    w.clear()
    assert not (tmp_path / "work").exists() and w.manifest().count() == 0
    for bad in ("", "..", "a/b", "file:x", ".hidden"):
        with pytest.raises(ValueError, match="plain"):
            w.path(bad)


def test_tables_of_a_block_go_when_it_ends(spark):
    there = lambda p: os.path.exists(p.removeprefix("file://"))
    with passing(spark) as keep:
        a, b = materialize(spark.range(3), "a"), keep(materialize(spark.range(4), "b"))
        paths = [a._written, b._written]
        assert all(map(there, paths))
    assert [there(p) for p in paths] == [False, True] and b.count() == 4
    with pytest.raises(KeyError), passing(spark):
        c = materialize(spark.range(2), "c")._written
        raise KeyError
    assert not there(c)
    discard(b)
    discard(b)
    assert not there(paths[1])


def test_files_of_recognisers_subtitles_and_logs(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    (tmp_path / "b.vtt").write_text(VTT)
    got = {(r.path.rsplit("/", 1)[1], r.start, r.speaker) for r in R.read_subtitles(spark, f"file://{tmp_path}/*.[sv]*t").collect()}
    assert got == {("a.srt", 1.0, None), ("a.srt", 3.0, None), ("b.vtt", 62.5, "Ann")}
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "p1.tsv").write_text(head + "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n" + '5\t1\t1\t1\t1\t1\t10\t5\t20\t8\t90\t"Sign\n5\t1\t1\t1\t1\t2\t35\t4\t10\t8\t70\tin\n5\t1\t1\t1\t2\t1\t0\t0\t1\t1\t5\tnoise\n')
    (tmp_path / "p2.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t1\t1\t1\t1\t50\tother\n")
    rows = sorted(R.read_recognition(spark, f"file://{tmp_path}/*.tsv").collect(), key=lambda r: r.path)
    assert [(r.text, r.confidence, r.x1, r.y1, r.x2, r.y2) for r in rows] == [('"Sign in', 0.8, 10, 4, 45, 13), ("other", 0.5, 1, 1, 2, 2)]
    (tmp_path / "run.log").write_text("frame pts_time:1.5\nlavfi.scene_score=0.4\nsilence_start: 2.0\r\nsilence_end: 3.5\nsilence_start: 9\n")
    log = R.read_log(spark, f"file://{tmp_path}/run.log")
    assert [(r.pts, r.score) for r in R.parse_scene_scores(log).collect()] == [(1.5, 0.4)]
    assert sorted((r.start, r.end or -1) for r in R.parse_silences(log).collect()) == [(2.0, 3.5), (9.0, -1)]


def test_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = LocalFiles().read(spark, str(tmp_path)).first()
    assert row["size"] == 3 and row.content_hash.startswith("ba7816bf")


def test_registry_and_settings(spark):
    r = Registry()
    r.register("llm", "echo", "json:dumps", "e")
    assert r.build("llm", "e", {"obj": 1}) == "1" and default.build("ocr", "null", {"unknown": 2})([]) == []
    with pytest.raises(KeyError, match="known: echo"):
        r.build("llm", "none")
    r.register("llm", "bad", "no_such_module:x")
    with pytest.raises(ImportError):
        r.build("llm", "bad")
    assert ("llm", "bad") in r.broken and default.build("llm", "null")("q") is None
    spark.conf.set("chronofact.top_k", "7")
    assert Settings.load(spark, merge_gap="3").top_k == 7 and Settings.load(spark, merge_gap="3").merge_gap == 3.0
    spark.conf.unset("chronofact.top_k")
    with pytest.raises(KeyError):
        Settings.load(nothing=1)


def test_streams_equal_batches(spark, tables):
    events = S.read_events(spark, tables)
    batch = spark.read.parquet(f"{tables}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    endless, end = S.ended(events)
    assert counts(S.run_available(S.windowed_counts(endless), end)) == counts(S.windowed_counts(batch))
    # Sessions that the watermark has closed are those of the batch.
    every = {(r.user_id, r.start, r.end, r.n) for r in S.sessions(batch).collect()}
    closed = {(r.user_id, r.start, r.end, r.n) for r in S.run_available(S.sessions(events)).collect()}
    assert closed and closed <= every
    endless, end = S.ended(events)
    assert {(r.user_id, r.start, r.end, r.n) for r in S.run_available(S.sessions(endless), end).collect()} == every


def batches(spark, path, parts, schema):
    """A stream of several files, one a micro-batch, in the order given."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{path}/{i}")
        for f in (path / str(i)).glob("*.parquet"):
            os.utime(f, (1_600_000_000 + 60 * i, 1_600_000_000 + 60 * i))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def test_late_rows_fall_into_windows_or_are_dropped(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1, 10, 0) + timedelta(minutes=minute)
    parts = [[(1, "a", at(5)), (2, "a", at(100))], [(3, "a", at(95)), (4, "a", at(10)), (5, "a", at(190))], [(6, "a", at(30)), (7, "a", at(300))]]
    stream = batches(spark, tmp_path, parts, "event_id long, event_type string, ts timestamp")
    stream, end = S.ended(stream)
    got = {r.start: r.n for r in S.run_available(S.windowed_counts(stream), end).collect()}
    # The watermark stands at 11:30 after the first batch, and is held against rows of the third: 10:30 comes too late, 10:10 and 11:35 do not.
    assert got == {at(0): 2, at(60): 2, at(180): 1, at(300): 1}


def test_streamed_tracks_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    lines = ["Sign in to the app", "ConnectionError: refused", "npm run migrate", "Sign in to the App!", "npm run  migrate"]
    base, rows, ends = 86_400.0, [], {}
    for v in ("v1", "v2", "v3"):
        for i in range(30):
            ts = base + 2.0 * i
            rows.append((v, ts, None, None, None, None, None, None, False))
            for line in rng.sample(lines, rng.choice([0, 0, 1, 2])):
                x = rng.choice([0.0, 5.0, 200.0])
                rows.append((v, ts, line, rng.choice([None, 0.5, 0.9]), x, 0.0, x + 20.0, 10.0, False))
        ends[v] = base + 61.0
        rows.append((v, ends[v], None, None, None, None, None, None, True))
    schema = "video_id string, ts double, text string, confidence double, x1 double, y1 double, x2 double, y2 double, last boolean"
    table = spark.createDataFrame([r for r in rows if not r[8]], schema)
    want = text_tracks(table.where("text IS NOT NULL"), table.select("video_id", "ts"), spark.createDataFrame(list(ends.items()), "video_id string, duration double"))
    order = sorted(rows, key=lambda r: (r[1] + rng.uniform(0, 15), r[0]))  # out of order, within the delay
    parts = [[(*r, datetime.fromtimestamp(r[1], timezone.utc)) for r in order[i : i + 60]] for i in range(0, len(order), 60)]
    stream = batches(spark, tmp_path, parts, schema + ", at timestamp")
    stream, end = S.ended(stream, "at")
    got = S.run_available(stream_tracks(stream, late="30 seconds"), end)
    key = lambda df: sorted(map(str, df.select("video_id", "text", "start", "end", "last_ts", "frame_count", "confidence", "stable").collect()))
    assert len(parts) > 2 and key(got) == key(want) and got.where("stable").count() > 3


def test_streams_read_tables_that_are_folders(spark, tables, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{tables}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = lambda d: sorted(map(str, planning.stream_tracks(spark, d).collect()))
    assert len(rows(str(tmp_path))) > 0 and rows(str(tmp_path)) == rows(tables)
    assert S.run_available(S.read_events(spark, str(tmp_path))).count() == S.run_available(S.read_events(spark, tables)).count() > 0


def test_collection(spark, tables):
    c = Collection(facts(spark, tables))
    assert c.search("error").count() == 10 and c.recording("v0").search("error", top_k=3).count() == 3
    assert c.at(100.0, 5.0).count() > 0 and c.timeline(50.0, 10.0).count() == 0 and c.timeline(0.0, 60.0, ["events"]).count() > 0
    assert c.chapters().count() > 0 and c.states().count() > 0 and c.chains().count() > 0 and c.silences().count() > 0
    found = c.search_graph("error", top_k=2).collect()
    assert {r.stage for r in found} >= {"lexical", "graph"} and sum(r.kept for r in found if r.video_id == "v0") == 2
    assert c.package("error").count() > 0 and c.receipt().count() > 0 and c.compare("v0", "v1").count() > 0 and c.entity_timeline("The").count() >= 0


def test_shared_folder_is_the_sessions_or_one_of_our_own(spark):
    from chronofact.session import shared_dir

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"applicationId": "app-1", "master": "local[2]"})

    class OnCluster(Unset):
        sparkContext = type("S", (), {"applicationId": "app-2", "master": "spark://host:7077"})

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(Unset) == shared_dir(Unset) and shared_dir(Unset).startswith("file:///")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(OnCluster)

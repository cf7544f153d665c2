"""Exact, near, line and suffix deduplication against brute force, with the odd cases of each."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact.llm import line_dedup as L
from chronofact.llm import suffix_dedup as S
from chronofact.llm.components import components
from chronofact.llm.exact_dedup import exact_dedup
from chronofact.llm.near_dedup import near_dedup

DOCS = "doc_id long, text string"


def near_brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        w = [x.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for x in w]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def varied(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(0, max(2, len(w) // 6))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        rows.append((i, " ".join(w)))
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "two words"), (1006, "Two\twords"), (1007, "x" * 50000), (1008, "a b " * 30000), (1009, "Ünï çödé ß"), (1010, "Ünï çödé ß")]


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 2)])
def test_near_dedup_equals_brute_force(spark, width, seed):
    rows = varied(seed, 250) + ODD
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, DOCS), width=width).collect()}
    assert got == near_brute(rows, width)


def test_near_dedup_of_a_large_group_and_its_star(spark):
    """A group of copies with edits of one hub, more than any one order's neighbours reach."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for _ in range(12):
            w[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, DOCS), width=2).collect()}
    assert got == {i: c for i, (_, c) in near_brute(rows, 2).items()}


def test_near_dedup_of_nothing_nulls_and_clashing_columns(spark):
    empty = near_dedup(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit("x"), "key": F.lit(1), "n": F.lit(2), "kept": F.lit(True)})
    got = sorted(((r.doc_id, r.component_id) for r in near_dedup(df).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=str)


def test_near_dedup_links_each_row_of_a_repeated_id(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " y"), (None, c), (5, c + " x"), (None, d), (None, d + " w"), (7, None), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 5, False), (5, 5, True), (None, None, True), (None, None, True), (7, 7, True), (None, None, True)]
    assert got == sorted(want, key=str)


def test_components_of_chains_stars_and_pairs(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(500, 501), (501, 500)], "a long, b long")).collect()}
    groups = [{got[i] for i in range(61)}, {got[i] for i in range(100, 140)}, {got[500], got[501]}]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    out = {}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        out[i] = (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_exact_dedup_equals_brute_force_even_when_all_fingerprints_collide(spark):
    rows = [(5, "a b"), (2, "a  b"), (9, "a\t\nb"), (1, "ab"), (3, None), (4, ""), (6, " "), (7, "A b"), (8, "é" * 3000), (0, "é" * 3000)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_fp": F.lit(1), "keep_id": F.lit("x")})
    for fingerprint in (F.md5, lambda c: F.lit("same")):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, fingerprint=fingerprint).collect()}
        assert got == exact_brute(rows)
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    twice = exact_dedup(spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], DOCS)).collect()
    assert sorted((r.doc_id or -1, r.group_size, r.kept) for r in twice) == [(-1, 1, True), (1, 2, True), (1, 2, True)]


def line_brute(rows, divisor=3, least=2):
    hashed = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:7], 16)
    seen, out = {}, {}
    chunks = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        h = [hashed(x) for x in lines]
        marks = [k > 0 and (h[k] + 31 * h[k - 1]) % divisor == 0 for k in range(len(lines))]
        start, mine = 0, []
        for k in range(len(lines)):
            if k == len(lines) - 1 or (least <= k + 1 <= len(lines) - least and marks[k] and not any(marks[k - least + 1 : k])):
                mine.append(lines[start : k + 1])
                start = k + 1
        chunks[i] = mine
        for no, c in enumerate(mine):
            seen.setdefault("\n".join(c), (i, no))
    for i, mine in chunks.items():
        kept = [c for no, c in enumerate(mine) if len(c) < least or seen["\n".join(c)] == (i, no)]
        t = dict(rows)[i]
        out[i] = t if len(kept) == len(mine) else "\n".join(x for c in kept for x in c)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    lines = [f"line {k} " + "x" * rng.randrange(20) for k in range(40)]
    passage = [f"shared {k}" for k in range(12)]
    rows = []
    for i in range(120):
        body = [rng.choice(lines) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.4:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        rows.append((i, "\n".join(body)))
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, "\n".join(passage * 500)), (204, "a\r\nb\r\n")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"no": F.lit(1), "chunk": F.lit("c"), "gone": F.lit(2), "id": F.lit("i")})
    out = L.line_dedup(df)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == line_brute(rows)
    for least in (1, 3):
        assert {r.doc_id: r.text for r in L.line_dedup(df, min_lines=least).collect()} == line_brute(rows, least=least)
    assert out.columns[:6] == df.columns
    assert sum(r.removed_chunks for r in out.collect()) > 50


def test_line_dedup_odd_cases(spark):
    assert L.line_dedup(spark.createDataFrame([], DOCS)).count() == 0
    text = "\n".join(f"l{k}" for k in range(20))
    rows = L.line_dedup(spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], DOCS)).collect()
    by = sorted(((r.doc_id, r.text, r.removed_chunks) for r in rows), key=str)
    # The null id comes first, so it keeps the chunks; the equal rows are one document and lose theirs alike.
    assert [x[1] == text for x in by if x[0] is None and x[1] is not None] == [True]
    assert len({x for x in by if x[0] == 1}) == 1 and next(x[2] for x in by if x[0] == 1) > 0


def test_line_dedup_empties_exact_copies_of_many_lines(spark):
    pages = ["\n".join(f"page {p} line {k}" for k in range(2 + p % 9)) for p in range(60)]
    rows = [(i, t) for i, t in enumerate(pages + pages)]
    got = {r.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i in range(120)] == pages + [""] * 60


def run_brute(rows, least=2):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - least + 1):
            run = tuple(lines[k : k + least])
            gone |= set(range(k, k + least)) if run in seen else set()
            seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
    return out


def test_run_dedup_leaves_nothing_of_copies_and_equals_brute_force(spark):
    rng = random.Random(9)
    lines = [f"line {k}" for k in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    page = "\n".join(f"own {k}" for k in range(60))
    rows += [(100, page), (101, page), (102, "head\n" + page[6:] + "\ntail"), (103, page.replace("own 30", "new")), (200, None), (201, ""), (202, "\n\n\n"), (203, "\n" * 5000)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"no": F.lit(1), "gone": F.lit("g"), "fp": F.lit(2), "id": F.lit("i")})
    out = L.run_dedup(df)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == run_brute(rows)
    assert (got[100], got[101], got[102], got[103], got[200]) == (page, "", "head\ntail", "new", None)
    assert out.columns[:6] == df.columns
    twice = L.run_dedup(spark.createDataFrame([(1, page), (1, page), (None, page), (None, None)], DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in twice if r.text is not None) == [("1", ""), ("1", ""), ("None", page)]
    assert L.run_dedup(df.limit(0)).count() == 0


def suffix_brute(texts, length, keep):
    where, out = {}, []
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            where.setdefault(t[s : s + length], []).append((i, s))
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = where[t[s : s + length]]
            if len(w) > 1 and (keep == "none" or w[0] != (i, s)):
                gone[s : s + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(t), spans, bytes(c for c, x in zip(t, gone, strict=True) if not x)))
    return out


@pytest.mark.parametrize("length,floor,keep,crowd", [(400, 256, "none", 1 << 17), (400, 256, "first", 100), (120, 120, "first", 200), (120, 100, "none", 0)])
def test_suffix_dedup_equals_brute_force(spark, length, floor, keep, crowd):
    """Removed and reported ranges, when all suffixes are ordered in tasks, when some are ordered by Spark, and when all are."""
    rng = random.Random(length)
    words = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 400))) for _ in range(40)]
    for _ in range(30):
        a, b = rng.choice(texts), rng.choice(texts)
        s = rng.randrange(max(1, len(a) - 300))
        k = rng.randrange(len(b) + 1)
        texts.append(b[:k] + a[s : s + rng.choice([99, 100, 119, 120, 121, 255, 256, 399, 400, 401, 900])] + b[k:])
    texts += [texts[0], texts[0], "a" * 1000, "ab" * 400, "", None, "z" * length, "z" * (length - 1), "\0" * (floor + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"rk": F.lit(1), "z": F.lit("q"), "anchor": F.lit(0)})
    pairs = lambda x: [(s.start, s.end) for s in x]
    rows = S.suffix_dedup(df, length, keep, floor, crowd).collect()
    raw = [(t or "").encode() for t in texts]
    assert sorted((r.doc_id, r.n_bytes, pairs(r.spans), bytes(r.kept)) for r in rows) == suffix_brute(raw, length, keep)
    assert sorted((r.doc_id, pairs(r.shared)) for r in rows) == [(i, spans) for i, _, spans, _ in suffix_brute(raw, floor, keep)]
    for r in rows:
        for s in r.shared:
            whole = [m for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw[r.doc_id]) if s.start <= m.start() and m.end() <= s.end]
            assert s.words == len(whole)


def test_previous_factors_equal_brute_force():
    rng = random.Random(3)
    for floor, depth in ((1, 12), (3, 5), (4, 20)):
        data = bytes(rng.choice(b"ab") for _ in range(150)) + b"abab" * 20 + bytes(rng.choice(b"ab\0") for _ in range(80))
        starts = np.array(sorted(rng.sample(range(len(data)), 200)))
        sizes = np.minimum(len(data) - starts, [rng.randrange(1, 30) for _ in starts])
        keys = [data[s : s + min(n, depth)] for s, n in zip(starts, sizes)]
        share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        least = lambda n: n if n >= floor else 0
        count = 1 + np.array([rng.random() < 0.3 for _ in starts])
        drawn = rng.sample(range(1000), int(count.sum()))
        places = np.full((2, len(starts)), -1)
        for i, n in enumerate(count):
            for j in range(n):
                places[j, i] = drawn.pop()
        rows = [(places[j, i], keys[i], j, i) for i, n in enumerate(count) for j in range(n)]
        for side, got in zip((-1, 1), S.previous_factors(data, starts, sizes, places, floor, depth)):
            for place, key, j, i in rows:
                assert got[j, i] == least(max((share(key, k) for p, k, _, _ in rows if (p - place) * side > 0), default=0))


def test_suffix_dedup_cuts_long_texts_into_stretches(spark, monkeypatch):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long), (2, "x" * 500 + long[1_048_000:1_049_500]), (None, long[10:30])]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in S.suffix_dedup(spark.createDataFrame(rows, DOCS), 400, "none").collect()}
    # The run of x repeats within itself; the copied stretch lies across the cut.
    assert got[1] == [(1_048_000, 1_049_500)] and got[2] == [(0, 2000)] and got[None] == []


def test_op1_reports_passages_of_over_50_words_that_stay(spark, tmp_path):
    """Under 400 bytes a repeated passage is not removed, but counted; of 50 words, or unrepeated, it is not."""
    rng = random.Random(51)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    short, fifty, long = prose(52), prose(50), prose(80)
    texts = [f"{prose(30)} {x} {prose(30)}" for x in (short, short, fifty, fifty, long, long, prose(52))] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in S.op1_suffix_dedup(spark, f"file://{tmp_path}").collect()}
    assert len(short) < 400 and {i: r.n_passages for i, r in rows.items()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0, 8: 0}
    raw = [(t or "").encode() for t in texts]
    for i, size, spans, kept in suffix_brute(raw, 400, "none"):
        assert rows[i][:5] == (i, size, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_nothing(spark):
    assert S.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.kept for r in S.suffix_dedup(spark.createDataFrame([(1, "short"), (None, None)], DOCS).orderBy("doc_id")).collect()].count(b"short") == 1

"""Periodic runs, k-means with bounds and quality rules, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact.llm import kmeans, quality, runs

DOCS = "doc_id long, text string"


def brute_runs(w, least):
    """Maximal repetitions by the definition: for each period, stretches of places equal to those a period later."""
    out = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            smaller = any(all(w[x] == w[x + q] for x in range(s, s + n - q)) for q in range(1, p))
            if i > s and n >= max(least, 2 * p) and not smaller:
                out.add((s, n, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            p, a = rng.randint(1, max(1, n // 3)), rng.randrange(n)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 5, 12])
        assert [tuple(r) for r in runs.runs(np.array(w, dtype=np.int64), least).tolist()] == brute_runs(w, least)


class Letter(int):
    """An integer that counts how often it is compared."""

    count = 0

    def __eq__(self, other):
        Letter.count += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Letter.count += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [fibonacci, lambda n: [0] * n, lambda n: [i % 7 for i in range(n)], lambda n: [(i % 100) * 7 % 13 for i in range(n)], lambda n: [bin(i).count("1") & 1 for i in range(n)], lambda n: [(i & -i) for i in range(1, n + 1)]])
def test_lyndon_arrays_take_linear_comparisons(make):
    for n in (1000, 8000):
        Letter.count = 0
        runs.lyndon([Letter(x) for x in make(n)])
        assert Letter.count <= 8 * n


def op11_brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 12)
    gone = {i for s, n_, p in found for i in range(s + p, s + n_)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (4, "x"), (5, "la " * 30), (6, "é ü \x0b a\x00 a a\x00 a " * 4)]
    for i in range(7, 260):
        w = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 70))]
        at = rng.randint(0, len(w))
        w[at:at] = (w[at : at + rng.randint(1, 8)] or ["q"]) * rng.choice([0, 1, 3, 5])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = runs.op11_periodic_runs(spark, f"file://{tmp_path}").collect()
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted((op11_brute(*r) for r in rows), key=order)
    assert sum(r.n_runs for r in got) > 100


def test_runs_of_a_long_text_and_other_columns(spark):
    body = " ".join(f"w{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([(1, body, "x", 2), (1, body, "y", 3), (None, None, None, None)], DOCS + ", collapsed string, Runs int").withColumn("words", F.lit(1))
    got = runs.periodic_runs(df).collect()
    assert got[0].collapsed == " ".join(f"w{i}" for i in range(5000)) and [tuple(r) for r in got[0].runs] == [(0, 200_000, 5000)]
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].words == 1 and len(got) == 3
    assert runs.periodic_runs(df.limit(0)).count() == 0


def lloyd(rows, k, rounds, scale=64):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((dist(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], c


def vectors_of(rng, n, groups=12):
    middle = rng.normal(size=(groups, 64))
    x = (middle[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, 64))).astype(np.float32)
    return [(i, [float(y) for y in v]) for i, v in enumerate(x)]


VECTORS = "vec_id long, embedding array<float>"


def test_clusters_equal_lloyd_with_fewer_distances(spark):
    rng = np.random.default_rng(4)
    rows = vectors_of(rng, 400)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, []), *[(1000 + i, rows[0][1]) for i in range(150)]]
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("x")).repartition(5)
    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    for rounds in (0, 1, 6):
        found = kmeans.cluster(df, seed, rounds=rounds)
        want, centers = lloyd(rows, 16, rounds)
        order = lambda r: (r[0] is None, r)
        assert sorted(map(tuple, found.rows.collect()), key=order) == sorted(want, key=order)
        assert found.centers.tolist() == centers
    full = 16 * len(want)
    assert found.distances[0] == full and sum(found.distances[1:]) < 0.5 * full * 6


def test_ties_empty_clusters_and_few_vectors(spark):
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64), (4, [0.0] * 64)]
    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    for k in (1, 2, 16):
        found = kmeans.cluster(spark.createDataFrame(few, VECTORS), seed, k=k)
        want, centers = lloyd(few, k, 3)
        assert sorted(map(tuple, found.rows.collect())) == sorted(want) and found.centers.tolist() == centers
    none = kmeans.cluster(spark.createDataFrame([(None, None)], VECTORS), seed)
    assert none.rows.count() == 0 and len(none.centers) == 0
    big = [(i, [float((i * 7919 + j * 104729) % 2_000_003 - 1_000_000) for j in range(64)]) for i in range(60)]
    found = kmeans.cluster(spark.createDataFrame(big, VECTORS), seed)
    assert sorted(map(tuple, found.rows.collect())) == sorted(lloyd(big, 16, 3)[0])
    with pytest.raises(Exception, match="beyond"):
        kmeans.cluster(spark.createDataFrame([(1, [1e30] * 64)], VECTORS), seed).rows.collect()


def test_op12_columns(spark, tmp_path):
    rows = vectors_of(np.random.default_rng(2), 200)
    spark.createDataFrame(rows, VECTORS).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = kmeans.op12_clusters(spark, f"file://{tmp_path}").collect()
    want, centers = lloyd(rows, 16, 3)
    assert len({r.inertia for r in got}) == 1 and got[0].inertia == sum(d for *_, d in want)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


def base_brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


PROSE = "The river was high that spring, and nobody crossed it before the end of April.\nWe waited for the ferry on the other bank. It came at noon, as it always did."


def test_base_figures_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a\r\na\na\n a", "😀é #*$%&|<> x y", PROSE, PROSE + "\n" + PROSE, "x " * 50]
    for _ in range(120):
        w = [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(w))
        w[at:at] = w[: rng.choice([0, 8, 9, 12])]
        texts.append("".join(x + rng.choice([" ", " ", "  ", "\n"]) for x in w))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_brute(t), t
        assert not (r.base_failed and r.kept)


def test_lines_that_fail_and_documents_that_lose_too_much(spark):
    lines = {
        "Home": ["navigation"],
        "home | products | about us | contact": ["punctuation", "navigation"],
        "© 2020 Some Company. All rights reserved.": ["boilerplate"],
        "This work is licensed under a licence.": ["boilerplate"],
        "BUY!! NOW!! IT!! IS!! CHEAP!!": ["punctuation"],
        "word*** other### thing%%% more&&& ends.": ["punctuation"],
        "a line without any mark at its end": ["punctuation"],
        "go go go go go go.": ["boilerplate"],
        "Chapter One": [],
        "He said: it was a 5% rise & no more.": [],
        "": [],
        "¿Dónde está la casa?": [],
    }
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, PROSE + "\nHome\nAll rights reserved."), (3, PROSE + "".join(f"\nMenu{i} | one{i} | two | three{i} | four" for i in range(9))), (4, PROSE), (None, None), (4, PROSE)], DOCS)
    got = quality.quality(df.withColumns({"words": F.lit(1), "kept": F.lit(2), "lines": F.lit(3)})).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert got[0].line_fails == list(lines.values())
    assert got[1].kept and got[1].clean_text == PROSE and got[1].lost_chars == len("HomeAllrightsreserved.")
    assert not got[2].kept and not got[2].base_failed and got[2].clean_text == PROSE
    assert got[3].kept and got[3].clean_text == PROSE and got[4][: len(got[3])] == got[3][: len(got[3])]
    assert got[5].base_failed and got[5].clean_text == "" and got[0].words == 1 and got[0].lines == 3
    assert quality.quality(df.limit(0)).count() == 0
    long = quality.quality(spark.createDataFrame([(1, " ".join(f"w{i % 3001}." for i in range(120_000)))], DOCS)).first()
    assert (long.n_words, long.n_repeat_words, long.base_failed) == (120_000, 120_000, True)

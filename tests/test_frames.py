"""Runs of pictures and nearest vectors, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact.operators.tracking import replayed, tile_differences, tile_runs
from chronofact.operators.vectors import nearest_vectors


@pytest.mark.parametrize("side,tiles,parts", [(32, 16, 1), (32, 16, 8), (8, 4, 3)])
def test_tile_runs_equal_numpy_wherever_tasks_are_cut(spark, side, tiles, parts):
    rng = np.random.default_rng(side + parts)
    rows, want = [], {}
    for v, n in (("a", 60), ("b", 1), ("c", 25)):
        picture, run = rng.random(side * side), 0
        for t in range(n):
            if t and rng.random() < 0.3:
                picture = picture.copy()
                grid = picture.reshape(tiles, side // tiles, tiles, side // tiles)
                grid[rng.integers(tiles), :, rng.integers(tiles), :] += 1.0  # one tile alone
            before = rows[-1][2] if t else None
            rows.append((v, float(t), (picture + 0.01 * rng.random(side * side)).tolist()))
            if before is None or tile_differences(np.array([before, rows[-1][2]]), tiles)[1] > 0.5:
                run += 1
            want[(v, float(t))] = run
    df = spark.createDataFrame([*rows, ("d", 0.0, None)], "video_id string, ts double, pixels array<double>").repartition(4)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = tile_runs(df, 0.5, tiles)
        got = {(r.video_id, r.ts): r.run for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == want and 3 < want[("a", 59.0)] < 40
    read = spark.createDataFrame([("a", 0.0, "x"), ("a", 0.0, "y"), ("c", 3.0, "z")], "video_id string, ts double, text string")
    copies = sorted((r.video_id, r.ts, r.text) for r in replayed(found, read).collect())
    assert copies == sorted((v, t, x) for v, at, x in (("a", 0.0, "x"), ("a", 0.0, "y"), ("c", 3.0, "z")) for (w, t), run in want.items() if w == v and run == want[(v, at)])
    assert tile_runs(df.limit(0), 0.5, tiles).count() == 0


def test_pictures_that_are_no_squares_are_refused():
    with pytest.raises(ValueError, match="squares"):
        tile_differences(np.zeros((2, 10)), 2)


def test_nearest_vectors_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24))
    x[50:90] = x[10]  # copies: ties by id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [float("nan")] * 24), (903, [None] * 24), (904, [0.0] * 24), (905, [1.0, 2.0]), (906, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    found = nearest_vectors(df, df.where("vec_id % 7 = 3 OR vec_id > 899"), 9, block=16, shard=50).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(got[r.query_id]) and r.rrf == 1 / (60 + r["rank"])
    good = {i: np.array(v, dtype=float) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)}
    cos = lambda a, b: round(float(a @ b) / (max(np.linalg.norm(a), 1e-12) * max(np.linalg.norm(b), 1e-12)), 5)
    for q in [i for i in good if i % 7 == 3 or i > 899]:
        want = sorted((-cos(good[q], good[c]), c) for c in good if len(good[c]) == len(good[q]))[:9]
        assert [i for i, _ in got[q]] == [c for _, c in want] and np.allclose([s for _, s in got[q]], [-s for s, _ in want], atol=2e-5)
    assert set(got) == {i for i in good if i % 7 == 3 or i > 899}
    assert nearest_vectors(df.limit(0), df).count() == 0

"""Hard negatives: the heap, the shard search and the whole job against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives as ng

COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, negatives=10):
    """Every anchor against every row, in plain Python integers; rows are (id, label, vector or None)."""
    ok = [(i, l, [int(x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in sorted(ok):
        if is_anchor(i):
            anchors.setdefault(i, (l, v))
    out = []
    for a, (label, v) in anchors.items():
        s = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in ok if i != a)
        for ps, p, _ in [r for r in s if r[2] == label][:positives]:
            fit = [r for r in s if r[2] != label and 30 * -ps <= 100 * -r[0] <= 90 * -ps][:negatives]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("cell", F.lit(1)).repartition(3)
    return sorted(map(tuple, ng.mine(df, F.col("id") % 100 == 0, **kw).select(COLS).collect()))


def clouds(rng, n, d, labels=4, scale=30):
    c = rng.normal(0, scale, (labels * 2, d))
    return [(int(i), int(k % labels), np.floor(c[k] + rng.normal(0, scale * .6, d)).tolist()) for i, k in enumerate(rng.integers(0, labels * 2, n))]


def test_multi_sequence_descends_over_all_cells():
    rng = np.random.default_rng(1)
    for _ in range(30):
        u, v = rng.integers(-5, 6, rng.integers(0, 9)).astype(float), rng.integers(-5, 6, rng.integers(0, 9)).astype(float)
        got = list(ng.multi_sequence(u, v))
        assert [g[0] for g in got] == sorted((x + y for x in u for y in v), reverse=True)
        assert len({g[1:] for g in got}) == len(u) * len(v) and all(s == u[i] + v[j] for s, i, j in got)


def test_shard_stops_early_and_misses_nothing():
    rng = np.random.default_rng(2)
    rows = clouds(rng, 3000, 16, scale=100)
    x = np.array([r[2] for r in rows])
    books = tuple(ng.kmeans(h, 12) for h in (x[:, :8], x[:, 8:]))
    near = [ng.nearest(h, b) for h, b in zip((x[:, :8], x[:, 8:]), books)]
    far = np.stack([np.sqrt(((h - b[k]) ** 2).sum(1)) for h, b, k in zip((x[:, :8], x[:, 8:]), books, near)], 1)
    labels, ids = np.array([r[1] for r in rows]), np.arange(3000)
    s = ng.Shard(near[0] * 12 + near[1], labels, ids, far, x, books)
    visited = 0
    for a in range(0, 3000, 100):
        v = x[a]
        score = x @ v
        want = sorted((-int(t), i) for i, t in enumerate(score) if labels[i] == labels[a] and i != a)[:5]
        assert s.positives(a, labels[a], v, 5) == [(-t, i) for t, i in want]
        floor = -want[-1][0]
        visited += sum(1 for bound, *_ in s.visit(v) if bound >= floor) / len(s.cell)
        assert all((s.x[p:q] @ v).max() <= upper and (s.x[p:q] @ v).min() >= lower for _, upper, lower, p, q in s.visit(v))
    assert visited < 30 * .9


@pytest.mark.parametrize("shard_rows", [300, 131_072])
def test_mine_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(ng, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(ng, "CELL_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = clouds(rng, 1200, 10) + [(2000 + i, i % 3, [40.0] * 10) for i in range(400)]  # a ball of copies, full of ties
    assert mined(spark, rows) == brute(rows, lambda i: i % 100 == 0)


def test_edges(spark):
    """Nulls, non-finite, empty and short vectors, repeated ids, ties, numbers beyond float precision."""
    rng = np.random.default_rng(4)
    big = float(1 << 29)
    rows = [(None, 1, [1.0]), (0, 1, [big, 3.0]), (100, None, [1.0, 1.0]), (200, 1, None), (300, 2, [1.0, float("nan")]), (400, 2, [float("inf"), 0.0]),
            (500, 2, [None, 1.0]), (600, 2, []), (700, 1, [5.0]), (0, 1, [big, 3.0]), (800, 2, [9.0, 9.0]), (800, 2, [9.0, 9.0])]
    rows += [(1 + i, int(rng.integers(1, 4)), [float(big + rng.integers(-9, 9)), float(rng.integers(-9, 9))]) for i in range(60)]
    rows += [(1000 + i, 1 + i % 2, [float((big // 3) + i % 4), 2.0]) for i in range(30)]
    want = brute([(i, l, None if v is None else [*v, *[0.0] * (2 - len(v))]) for i, l, v in rows], lambda i: i % 100 == 0)
    assert want and mined(spark, rows) == want


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(100, 1, [1e300]), (1, 1, [1e300])])

"""Seeded trials with successive halving."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import trials as tr


def test_draws_are_seeded_and_in_range():
    space = {"a": tr.Categorical(("x", "y")), "b": tr.Integer(2, 5), "c": tr.LogUniform(1e-4, 1e-2)}
    one, two, other = tr.sample(space, 30, 3), tr.sample(space, 30, 3), tr.sample(space, 30, 4)
    assert one == two != other and len(one) == 30
    assert all(t["a"] in "xy" and 2 <= t["b"] <= 5 and 1e-4 <= t["c"] <= 1e-2 for t in one)
    assert sum(t["c"] < 1e-3 for t in tr.sample(space, 400, 1)) in range(140, 260)  # log-uniform: half below the middle
    assert tr.sample(space, 3, 3, first=[{"a": "x", "b": 9, "c": 1.0}])[0]["b"] == 9
    assert len(tr.sample({"b": tr.Integer(1, 2)}, 9, 0)) == 2
    with pytest.raises(ValueError):
        tr.LogUniform(0.0, 1.0)


def test_halving_ends_with_all_origins():
    assert tr.halving(10, 27) == [(10, 3), (3, 9), (1, 27)]
    assert tr.halving(1, 5) == [(1, 5)] and tr.halving(3, 2) == [(3, 1), (1, 2)]


def test_search_finds_the_lags_and_repeats(spark):
    rng = np.random.default_rng(1)
    y = [0.0] * 4
    for _ in range(700):
        y.append(0.1 * y[-1] + 0.85 * y[-4] + rng.normal() * 0.1)
    rows = [("a", dt.date(2019, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)] + [("short", dt.date(2019, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "k string, ts date, v double").repartition(3)
    first = [{"penalty": "ridge", "lags": 1, "alpha": 1.0}, {"penalty": "ridge", "lags": 2, "alpha": 1.0}]
    run = lambda: sorted(tr.search(df, ["k"], "ts", "v", horizon=1, n_trials=9, seed=5, first=first, block_rows=64).collect(), key=lambda r: (r.k, r.trial))
    got = run()
    assert got == run() and len(got) == 18
    a = [r for r in got if r.k == "a"]
    best = [r for r in a if r.best]
    assert len(best) == 1 and best[0].lags >= 4 and best[0].origins == 27
    assert best[0].mae < min(r.mae for r in a if r.lags < 4)
    assert sum(r.origins == 27 for r in a) == 1 and sum(r.origins >= 9 for r in a) == 3
    assert all(r.mae is None and not r.best for r in got if r.k == "short")

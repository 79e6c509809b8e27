"""Work and memory that must not grow faster than the input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import regress as rg

D0 = dt.date(2024, 1, 1)


def _panel(spark, n_series=4, n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(s, D0 + dt.timedelta(days=i), None if (s, i) in ((1, 40), (1, 41)) else float(10 * s + rng.normal())) for s in range(n_series) for i in range(n)]
    return rows, spark.createDataFrame(rows, "series_id int, ts date, value double")


def test_pooled_grid_is_fitted_on_a_few_points_that_stand_for_all_rows(spark, monkeypatch):
    from pyspark.ml.regression import LinearRegression
    rows, df = _panel(spark)
    fitted, fit = [], LinearRegression.fit

    def spied(self, data, params=None):
        if isinstance(params, list):
            fitted.append(data.collect())
        return fit(self, data, params)

    monkeypatch.setattr(LinearRegression, "fit", spied)
    got = rg.pooled_linear(df, ["series_id"], "ts", "value", 3, 2, reg_params=(0.0,), elastic=(0.0,), block_rows=32).collect()
    tasks = 8  # at most a task a core or shuffle partition
    series = {}
    for s, _, v in rows:
        series.setdefault(s, []).append(np.nan if v is None else v)
    for k, data in enumerate(fitted, 1):
        x, y = [], []
        for v in series.values():
            for i in range(2, len(v) - 6):  # targets before the validation origin's
                if np.isfinite([*v[i - 2:i + 1], v[i + k]]).all():
                    x.append([1.0, v[i], v[i - 1], v[i - 2]])
                    y.append(v[i + k])
        assert sum(r.weight for r in data) == len(y)
        assert len(data) <= 8 * tasks < len(y)
        beta = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0]
        for r in got:
            if r.step == k and r.split == "future":
                v = series[r.series_id]
                assert r.yhat == pytest.approx(beta @ [1.0, v[-1], v[-2], v[-3]], rel=1e-8)
    assert len(fitted) == 2 and len(got) == 4 * 3 * 2


def test_points_keep_constant_columns_exact(spark):
    rows = [(7.1, float(i), 3.3) for i in range(50)] + [(7.1, 2.0, None)]
    win = spark.createDataFrame(rows, "_x0 double, _x1 double, _y1 double").coalesce(1)
    p = rg._points(win, 2, 1).collect()
    assert {(r.x[0], r.label) for r in p} == {(7.1, 3.3)} and sum(r.weight for r in p) == 50
    m = sum(r.weight * r.x[1] for r in p) / 50
    assert m == pytest.approx(24.5) and sum(r.weight * (r.x[1] - m) ** 2 for r in p) / 50 == pytest.approx(np.var(range(50)))


def _outer_reference(rows):
    """Every symbol at every date by plain loops; one value a symbol and date."""
    dates = sorted({t for _, t, _ in rows if t is not None})
    out = {}
    for s in {s for s, _, _ in rows}:
        known = {t: v for a, t, v in rows if a == s and s is not None and t is not None and v is not None}
        for t in dates:
            back = [u for u in known if u <= t]
            ahead = [u for u in known if u >= t]
            out[(s, t)] = known[max(back)] if back else known[min(ahead)] if ahead else None
    return out


def _outer_rows():
    day = lambda i: D0 + dt.timedelta(days=i)
    rows = [(1, day(0), 1.0), (1, day(40), 2.0), (1, day(41), None), (2, day(3), None), (2, day(35), 5.0), (2, day(70), None),
            (3, day(100), 7.0), (4, day(9), None), (5, None, 3.0), (None, day(50), 9.0), (None, None, 9.0)]
    return rows, "s int, ts date, value double"


def test_outer_alignment_fills_every_symbol_at_every_date(spark, monkeypatch):
    from tidemark.operators import align as al
    rows, schema = _outer_rows()
    want = _outer_reference(rows)
    df = spark.createDataFrame(rows, schema)
    for few, stretch in ((1_000_000, 4096), (0, 3)):
        monkeypatch.setattr(al, "FEW_DATES", few, raising=False)
        monkeypatch.setattr(al, "STRETCH", stretch, raising=False)
        got = al.align_outer_long(df, "s", "ts", "value").collect()
        assert len(got) == len(want) and {(r.s, r.ts): r.value for r in got} == want
    twice = al.align_outer_long(spark.createDataFrame(rows[:2] + rows[:1] + rows[4:5] * 2, schema), "s", "ts", "value").collect()
    assert sorted((r.s, (r.ts - D0).days, r.value) for r in twice) == [
        (1, 0, 1.0), (1, 0, 1.0), (1, 35, 1.0), (1, 40, 2.0), (2, 0, 5.0), (2, 35, 5.0), (2, 35, 5.0), (2, 40, 5.0)]
    assert al.align_outer_long(df.where("ts is null"), "s", "ts", "value").count() == 0


def test_outer_alignment_makes_its_grid_after_all_sorts(spark):
    from tidemark.operators import align as al
    rows, schema = _outer_rows()
    plan = al.align_outer_long(spark.createDataFrame(rows, schema), "s", "ts", "value")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = min(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert not any("Window" in x or "Aggregate" in x for x in lines[:at] if depth(x) < depth(lines[at]))


def test_short_units_step_together_as_each_alone(monkeypatch):
    from tidemark.operators import sequence as seq
    rng = np.random.default_rng(5)
    size = rng.integers(1, 40, 60)
    first = np.r_[0, np.cumsum(size)[:-1]]
    code = np.repeat(np.arange(60), size)
    y = np.repeat(rng.normal(size=(len(code), 1)).round(1), 3, axis=1)
    y[rng.random(len(code)) < 0.3] = np.nan
    together = seq._ewm(y, first, code, (3, 10, 26))
    monkeypatch.setattr(seq, "SHORT_UNIT", 0)
    np.testing.assert_allclose(together, seq._ewm(y, first, code, (3, 10, 26)), rtol=1e-12)


def test_feature_bundle_reads_its_rows_once_for_values_and_positions(spark, tmp_path):
    from tidemark.operators import indicators as ind
    rows, df = _panel(spark, 3, 60)
    df.repartition(2).write.parquet(str(tmp_path / "t"))
    src = spark.read.parquet(str(tmp_path / "t")).groupBy("series_id", "ts").agg(F.sum("value").alias("value"))
    one = src.unionByName(spark.createDataFrame([(None, D0, 1.0)], src.schema))
    got = ind.feature_bundle(one, ["series_id"], "ts", ["value"], dropna=False, block_rows=16).collect()
    assert sorted((r.series_id, r.ts) for r in got) == sorted((s, t) for s, t, _ in rows)  # a row without a key is in no series
    lag = {(s, t): v for s, t, v in rows}
    assert all(r.value_Lag3 == lag.get((r.series_id, r.ts - dt.timedelta(days=3))) for r in got)
    plan = ind.feature_bundle(src, ["series_id"], "ts", ["value"], block_rows=16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2  # the rows and their bucket summary, which share one scan and exchange

"""Property tests: operators against written definitions, DuckDB or pandas on many random cases,
each family evaluated in one Spark job (one series per case)."""

import datetime as dt
import math

import numpy as np
import pytest

from tidemark.operators import impute as im
from tidemark.operators import metrics as mt


def _expected_backcast(c, t):
    """Definition per row: a missing value before the next known one, at row k, is c[k] * t[i] / t[k],
    provided every guide value from i to k is known and every one after i is not zero."""
    out = []
    for i, v in enumerate(c):
        k = next((j for j in range(i, len(c)) if c[j] is not None), None)
        guide = [] if k is None else t[i:k + 1]
        ok = k is not None and all(x is not None for x in guide) and all(guide[1:])
        out.append(v if k == i else c[k] * t[i] / t[k] if ok else None)
    return out


def test_backcast_equals_definition(spark):
    rng = np.random.default_rng(11)
    rows, cases = [], {}
    for k in range(600):
        n = int(rng.integers(1, 10))
        t = [None if rng.random() < 0.1 else float(rng.choice([0.0, rng.uniform(1, 9)], p=[0.15, 0.85]))
             for _ in range(n)]
        c = [None if rng.random() < 0.5 else float(rng.uniform(-5, 5)) for _ in range(n)]
        cases[k] = (c, t)
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), c[i], t[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id int, ts date, c double, t double")
    got = im.proportional_backcast(df, ["series_id"], "ts", ["c"], "t", bucket="week").toPandas()
    got = got.sort_values(["series_id", "ts"])
    checked = 0
    for k, g in got.groupby("series_id"):
        for w, v in zip(_expected_backcast(*cases[k]), g["c"].tolist()):
            if w is None:
                assert v is None or math.isnan(v)
            else:
                assert v == pytest.approx(w, rel=1e-9, abs=1e-12)
            checked += 1
    assert checked == len(rows)


# A step counts when it lies in a complete block of n steps after the anchor row.  The first step of a block is
# compared from the actual value before it, later ones from the prediction before them; actual steps are
# always taken from the actual value before.
DA_SQL = """
WITH r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY k) AS len,
    lag(a) OVER w AS a0, lag(p) OVER w AS p0 FROM cases WINDOW w AS (PARTITION BY k ORDER BY day))
SELECT k, avg(CASE WHEN sign(a - a0) = sign(p - CASE WHEN (i - 1) % {n} = 0 THEN a0 ELSE p0 END) THEN 1.0 ELSE 0.0 END)
  FILTER (i > 0 AND (i - 1) // {n} < (len - 1) // {n}) AS da
FROM r GROUP BY k"""


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_anchored_directional_accuracy_equals_sql(spark, n):
    import duckdb
    import pandas as pd
    rng = np.random.default_rng(n)
    rows, cases = [], {}
    for k in range(120):
        length = int(rng.integers(1, 25))
        a = rng.integers(0, 4, size=length).astype(float).tolist()  # small ints: ties and zero steps
        p = rng.integers(0, 4, size=length).astype(float).tolist()
        cases[k] = (a, p)
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), a[i], p[i]) for i in range(length)]
    df = spark.createDataFrame(rows, "series_id int, ts date, a double, p double")
    got = {r.series_id: r.directional_accuracy
           for r in mt.anchored_directional_accuracy(df, ["series_id"], "ts", "a", "p", n, block_rows=8).collect()}
    con = duckdb.connect()
    con.register("cases", pd.DataFrame([(k, i, a[i], p[i]) for k, (a, p) in cases.items() for i in range(len(a))],
                                       columns=["k", "day", "a", "p"]))
    want = dict(con.execute(DA_SQL.format(n=n)).fetchall())
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] is None if w is None else got[k] == pytest.approx(w)


def test_reflect_smoothing_equals_padded_mean(spark):
    from tidemark.operators import indicators as ind
    rng = np.random.default_rng(7)
    rows, cases = [], {}
    for k in range(150):
        n = int(rng.integers(3, 40))
        x = rng.normal(size=n).round(3).tolist()
        cases[k] = x
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), x[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id int, ts date, value double")
    got = ind.centred_mean_reflect(df, ["series_id"], "ts", "value", block_rows=8).toPandas() \
        .sort_values(["series_id", "ts"])
    for k, g in got.groupby("series_id"):
        padded = np.pad(np.asarray(cases[k]), 3, mode="symmetric")
        want = np.convolve(padded, np.ones(7) / 7, mode="valid")
        assert np.allclose(g["value_smooth"].to_numpy(), want), k


@pytest.mark.parametrize("limit,window", [(2, 5), (1, 4)])
def test_interpolate_then_rolling_matches_pandas(spark, limit, window):
    import pandas as pd
    rng = np.random.default_rng(limit * 10 + window)
    rows, cases = [], {}
    for k in range(120):
        n = int(rng.integers(2, 30))
        x = [None if rng.random() < 0.45 else float(rng.integers(0, 50)) for _ in range(n)]
        cases[k] = x
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), x[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id int, ts date, value double")
    got = im.interpolate_then_rolling(df, ["series_id"], "ts", "value", limit_linear=limit, rolling=window,
                                      out="filled", block_rows=8).toPandas().sort_values(["series_id", "ts"])
    for k, g in got.groupby("series_id"):
        s = pd.Series(cases[k], dtype="float64")
        lin = s.interpolate(method="linear", limit=limit, limit_direction="both")
        avg = lin.rolling(window, center=True, min_periods=1).mean()
        want = lin.where(lin.notna(), avg)
        assert np.allclose(g["filled"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True), (k, cases[k])


def test_pct_change_and_rsi_match_pandas(spark):
    import pandas as pd
    from tidemark.operators import indicators as ind
    rng = np.random.default_rng(21)
    rows, cases = [], {}
    for k in range(100):
        n = int(rng.integers(2, 40))
        x = [None if rng.random() < 0.15 else float(rng.integers(0, 6)) for _ in range(n)]
        cases[k] = x
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), x[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id int, ts date, value double")
    pc = ind.pct_change(df, ["series_id"], "ts", "value", "chg", bucket="week")
    got = ind.rsi(pc, ["series_id"], "ts", ["value"], window=5, block_rows=8).toPandas() \
        .sort_values(["series_id", "ts"])
    for k, g in got.groupby("series_id"):
        s = pd.Series(cases[k], dtype="float64")
        with np.errstate(divide="ignore", invalid="ignore"):
            chg = s.ffill() / s.ffill().shift(1) - 1
        for w, v in zip(chg.tolist(), g["chg"].tolist()):
            if math.isfinite(w):
                assert v == pytest.approx(w)
            else:
                assert v is None or math.isnan(v)
        x = cases[k]
        steps = [None if i == 0 or x[i] is None or x[i - 1] is None else x[i] - x[i - 1] for i in range(len(x))]
        for i, v in enumerate(g["value_RSI_5"].tolist()):
            last = [0.0 if d is None else d for d in steps[max(0, i - 4):i + 1]]  # an unknown step is neither up nor down
            up, down = sum(d for d in last if d > 0), -sum(d for d in last if d < 0)
            if i >= 4 and down > 0:  # five steps; without a fall the ratio has no finite value
                assert v == pytest.approx(100.0 * up / (up + down))
            elif i < 4:
                assert v is None or math.isnan(v)


def test_asof_matches_pandas_merge_asof(spark):
    import pandas as pd
    from tidemark.operators import align as al
    rng = np.random.default_rng(31)
    ref_rows, probe_rows = [], []
    for k in range(60):
        days = sorted(rng.choice(200, size=int(rng.integers(1, 30)), replace=False).tolist())
        ref_rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=int(d)), float(rng.integers(0, 100))) for d in days]
        pdays = sorted(rng.choice(220, size=int(rng.integers(1, 20)), replace=False).tolist())
        probe_rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=int(d))) for d in pdays]
    ref = spark.createDataFrame(ref_rows, "series_id int, ts date, value double")
    probe = spark.createDataFrame(probe_rows, "series_id int, ts date")
    got = al.asof_backward(probe, ref, ["series_id"], "ts", "value", bucket="week").toPandas()
    rp = pd.DataFrame(ref_rows, columns=["series_id", "ts", "value"])
    pp = pd.DataFrame(probe_rows, columns=["series_id", "ts"])
    rp["ts"], pp["ts"] = pd.to_datetime(rp["ts"]), pd.to_datetime(pp["ts"])
    want = pd.merge_asof(pp.sort_values("ts"), rp.sort_values("ts"), on="ts", by="series_id",
                         direction="backward", allow_exact_matches=True)
    got["ts"] = pd.to_datetime(got["ts"])
    m = want.merge(got, on=["series_id", "ts"], suffixes=("_w", "_g"))
    assert len(m) == len(pp) == len(got)
    assert np.allclose(m["value_w"].to_numpy(dtype=float), m["value_g"].to_numpy(dtype=float), equal_nan=True)


def test_splice_matches_concat_rule(spark):
    import pandas as pd
    from tidemark.operators import align as al
    rng = np.random.default_rng(41)
    t_rows, p_rows, cases = [], [], {}
    for k in range(50):
        n_p = int(rng.integers(1, 20))
        n_t = int(rng.integers(1, n_p + 1))
        start = dt.date(2020, 1, 1)
        proxy = [(k, start + dt.timedelta(days=i), float(100 + i)) for i in range(n_p)]
        target = [(k, start + dt.timedelta(days=n_p - n_t + i), float(i)) for i in range(n_t)]  # same end date
        p_rows += proxy
        t_rows += target
        cat = pd.concat([pd.DataFrame(target), pd.DataFrame(proxy)], ignore_index=True)
        cases[k] = sorted(cat.iloc[:-len(target)].itertuples(index=False, name=None), key=lambda r: r[1])
    schema = "series_id int, ts date, value double"
    got = al.splice_history(spark.createDataFrame(t_rows, schema), spark.createDataFrame(p_rows, schema),
                            ["series_id"], "ts").toPandas()
    for k, g in got.groupby("series_id"):
        assert sorted(g.itertuples(index=False, name=None), key=lambda r: r[1]) == cases[k]

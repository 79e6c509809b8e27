"""Hand-derived operator values (FIXTURES.md section 3) and the source tests' cases."""

import datetime as dt
import math

import pytest

from tidemark.functions import text as tx
from tidemark.operators import align as al
from tidemark.operators import backtest as bt
from tidemark.operators import clean as cl
from tidemark.operators import impute as im
from tidemark.operators import indicators as ind
from tidemark.operators import metrics as mt
from tidemark.plans.q_clean import clean_quotes


def _series(spark, values, start=dt.date(2026, 1, 1), key="s", step_days=1):
    rows = [(key, start + dt.timedelta(days=i * step_days), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts date, value double")


def _col(df, name, order="ts"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_text_parsers(spark):
    df = spark.createDataFrame([("24/04/2026", "1.234,56", "1.234.567", "1.234,5 tỷ", "1.50 bil", "557.83M"),
                                ("9/4/2026", "1234,5", "1,234", "12 triệu", " 2 mil ", "107.03K"),
                                ("2026-04-24", "1,234.56", "12", "abc tỷ", "---", "123"),
                                ("x", "1.234", "1.2.3", "500", "1,234.56", "1,5M")],
                               "d string, dec string, i string, m string, n string, v string")
    out = df.select(tx.vi_date_to_us("d").alias("d"), tx.vi_decimal("dec").alias("dec"),
                    tx.vi_integer("i").alias("i"), tx.vi_money("m").alias("m"),
                    tx.suffix_number("n").alias("n"), tx.suffix_volume("v").alias("v")).collect()
    assert [r.d for r in out] == ["04/24/2026", "04/09/2026", "2026-04-24", "x"]
    assert [r.dec for r in out] == ["1234.56", "1234.5", "1,234.56", "1.234"]
    assert [r.i for r in out] == ["1,234,567", "1,234", "12", "123"]
    assert [r.m for r in out] == ["1,234.50 bil", "12.00 mil", "abc tỷ", "500"]
    assert [r.n for r in out] == [1.5e9, 2e6, None, 1234.56]
    assert out[0].v == pytest.approx(557830000.0) and out[1].v == pytest.approx(107030.0)
    assert out[2].v is None


def test_suffix_number_strict_raises(spark):
    df = spark.createDataFrame([("abc",)], "n string")
    with pytest.raises(Exception):
        df.select(tx.suffix_number("n", strict=True)).collect()


def _raw(spark, rows):
    return spark.createDataFrame(rows, "_seq long, symbol string, Date string, `Price` string, "
                                       "`Total Volume` string, `Total Value` string, `Foreign Buy Value` string")


def test_clean_keeps_rows_with_empty_side_column(spark):
    raw = _raw(spark, [(1, "IDX", "04/24/2026", "1,234.56", "123,456", "1.50 bil", None),
                       (2, "IDX", "04/25/2026", "1,240.00", "130,000", "1.75 bil", None)])
    out = clean_quotes(raw).orderBy("Date").collect()
    assert [r.Close for r in out] == [1234.56, 1240.0]
    assert [r["Total Volume"] for r in out] == [123456.0, 130000.0]
    assert [r["Total Value"] for r in out] == [1.5e9, 1.75e9]
    assert len(out[0]) == 5  # symbol + 4 output columns


def test_clean_duplicate_parsed_dates_first_wins(spark):
    raw = _raw(spark, [(1, "IDX", "04/09/2026", "1,736.68", "1", "1 bil", None),
                       (2, "IDX", "4/9/2026", "1,700.00", "1", "1 bil", None),
                       (3, "IDX", "04/10/2026", "1,750.00", "1", "1 bil", None)])
    assert _col(clean_quotes(raw), "Close", "Date") == [1736.68, 1750.0]


def test_clean_missing_columns_raise(spark):
    raw = spark.createDataFrame([(1, "IDX", "04/09/2026")], "_seq long, symbol string, Date string")
    with pytest.raises(ValueError, match="Missing required quote columns: Price, Total Volume, Total Value"):
        clean_quotes(raw)


def test_outliers(spark):
    d = _series(spark, [100, 102, 110, 111])
    assert _col(cl.remove_outliers(d, ["series_id"], "ts", "value"), "value") == [100, 102, 111]


def test_splice(spark):
    target = _series(spark, [3, 4], start=dt.date(2026, 1, 3))
    proxy = _series(spark, [10, 20, 30, 40], start=dt.date(2026, 1, 1))
    out = al.splice_history(target, proxy, ["series_id"], "ts")
    assert _col(out, "value") == [10, 20, 3, 4]


def test_backcast(spark):
    df = spark.createDataFrame([("s", dt.date(2026, 1, i + 1), c, t) for i, (c, t) in
                                enumerate([(None, 5.0), (None, 8.0), (20.0, 10.0)])],
                               "series_id string, ts date, c double, t double")
    out = im.proportional_backcast(df, ["series_id"], "ts", ["c"], "t")
    assert _col(out, "c") == [pytest.approx(10.0), pytest.approx(16.0), 20.0]


def test_ema_and_rsi(spark):
    e = ind.ema(_series(spark, [1, 2, 3, 4]), ["series_id"], "ts", ["value"], spans=[3])
    assert _col(e, "value_EMA_3") == pytest.approx([1, 1.5, 2.25, 3.125])
    r = ind.rsi(_series(spark, [1, 2, 3, 2, 4]), ["series_id"], "ts", ["value"], window=3)
    got = _col(r, "value_RSI_3")
    assert got[:2] == [None, None]
    assert got[2:] == pytest.approx([100.0, 66.66666667, 75.0])


def test_feature_bundle_warmup(spark):
    vals = [100 + i + (i % 3) for i in range(30)]
    out = ind.feature_bundle(_series(spark, vals), ["series_id"], "ts", ["value"])
    assert out.count() == 11


def test_sliding_windows_count(spark):
    w = ind.sliding_windows(_series(spark, list(range(30))), ["series_id"], "ts", "value", 5, 2)
    assert w.count() == 24


def test_reflect_smoothing(spark):
    out = ind.centred_mean_reflect(_series(spark, list(range(1, 8))), ["series_id"], "ts", "value")
    got = _col(out, "value_smooth")
    assert got[0] == pytest.approx(16 / 7) and got[3] == pytest.approx(4) and got[-1] == pytest.approx(40 / 7)


def test_compound(spark):
    df = spark.createDataFrame([("s", dt.date(2026, 1, 1), 0.1, 100.0), ("s", dt.date(2026, 1, 2), -0.1, 100.0)],
                               "series_id string, ts date, pct double, base double")
    assert _col(ind.compound(df, ["series_id"], "ts", "pct", "base"), "price") == pytest.approx([110.0, 99.0])


def test_next_business_days(spark):
    d = _series(spark, [1], start=dt.date(2026, 1, 2))  # a Friday
    out = ind.next_business_days(d, ["series_id"], "ts", 3)
    assert _col(out, "ts", "step") == [dt.date(2026, 1, 5), dt.date(2026, 1, 6), dt.date(2026, 1, 7)]


def test_combined_loss(spark):
    df = spark.createDataFrame([("m", 1, 1, 1.0, 1.0), ("m", 1, 2, 1.0, 3.0)],
                               "model string, window int, step int, a double, p double")
    row = mt.combined_loss(df, ["model"], "step", "a", "p").first()
    assert row.huber == pytest.approx(0.75) and row.directional_loss == pytest.approx(1.0)
    assert row.loss == pytest.approx(0.85)


def test_directional_accuracy_n1(spark):
    df = spark.createDataFrame([("s", dt.date(2026, 1, i + 1), a, p) for i, (a, p) in
                                enumerate([(10.0, 10.0), (12.0, 9.0), (11.0, 8.0)])],
                               "series_id string, ts date, a double, p double")
    row = mt.anchored_directional_accuracy(df, ["series_id"], "ts", "a", "p", 1).first()
    assert row.directional_accuracy == pytest.approx(0.5)


def test_config_validation():
    with pytest.raises(ValueError):
        bt.ForecastConfig(n_tests=0)
    with pytest.raises(ValueError):
        bt.ForecastConfig(n_forecasts=-1)


def test_backtest_fixture(spark):
    """Source test: 8 business days, closes 100..107, n_tests 4, horizon 2."""
    days = [dt.date(2026, 1, d) for d in (1, 2, 5, 6, 7, 8, 9, 12)]
    df = spark.createDataFrame([("IDX", d, 100.0 + i) for i, d in enumerate(days)],
                               "series_id string, ts date, close double")
    calls = []

    @bt.register_grouped("plus_one")
    def plus_one(hist, cfg):
        calls.append(len(hist))
        last = float(hist["y"].iloc[-1])
        return [last + 1, last + 2]

    @bt.register_grouped("plus_two")
    def plus_two(hist, cfg):
        last = float(hist["y"].iloc[-1])
        return [last + 2, last + 4]

    cfg = bt.ForecastConfig(n_tests=4, n_forecasts=2, seasonal_periods=2, n_lags=2)
    art = bt.run_backtest(df, ["series_id"], "ts", "close", cfg, model="plus_one", baseline="plus_two")
    final = art.final.orderBy("ts").collect()
    assert [r.ts for r in final] == days[4:]
    assert [r.actual for r in final] == [104.0, 105.0, 106.0, 107.0]
    assert [r.baseline for r in final] == [105.0, 107.0, 107.0, 109.0]
    assert [r.predicted for r in final] == [104.0, 105.0, 106.0, 107.0]
    assert art.rejected.count() == 0
    pos = bt.positions(bt.prepare(df, ["series_id"], "ts", "close"), ["series_id"], "ts")
    lengths = {r.fold: r.o for r in bt.origins(pos, ["series_id"], "y", cfg).collect()}
    assert [lengths[f] for f in (0, 1, -1)] == [6, 4, 8]  # training rows of each fold, then of the forecast
    fc = art.forecast.orderBy("step").collect()
    assert [r["Future Predictions"] for r in fc] == [108.0, 109.0]
    assert [r.ts for r in fc] == [dt.date(2026, 1, 13), dt.date(2026, 1, 14)]
    m = {r.Model: r for r in art.metrics.collect()}
    assert m["plus_one"].MAE == 0 and m["plus_one"].RMSE == 0
    assert m["plus_one"]["Directional Accuracy"] == pytest.approx(1.0)
    assert m["plus_two"].MAE == pytest.approx(1.5)
    assert m["plus_two"].RMSE == pytest.approx(math.sqrt(2.5))


def test_backtest_input_checks(spark):
    cfg = bt.ForecastConfig(n_tests=4, n_forecasts=2, seasonal_periods=2, n_lags=2)
    days = [f"2026-01-{d:02d}" for d in (1, 2, 5, 6, 7, 8, 9, 12)]
    raw = [(k, "IDX", d, str(100.0 + k)) for k, d in enumerate(days)]
    schema = "_seq long, series_id string, ts string, close string"
    run = lambda rows, **kw: bt.run_backtest(spark.createDataFrame(rows, schema), ["series_id"], "ts", "close", cfg, **kw)
    # a later row of a date replaces the earlier one
    art = run([*raw, (9, "IDX", days[-1], "500")])
    assert art.final.orderBy("ts").collect()[-1].actual == 500.0
    with pytest.raises(Exception, match="invalid dates"):
        run([*raw, (9, "IDX", "not a date", "5")])
    for bad in ("abc", None):
        with pytest.raises(Exception, match="invalid numbers"):
            run([*raw, (9, "IDX", "2026-01-13", bad)])
    with pytest.raises(ValueError, match="Missing required columns"):
        bt.run_backtest(spark.createDataFrame(raw, schema).drop("close"), ["series_id"], "ts", "close", cfg)
    short = [*raw, *[(20 + k, "NEW", d, "1") for k, d in enumerate(days[:5])]]
    art = run(short)
    assert [tuple(r) for r in art.rejected.collect()] == [("NEW", 5, 8)]
    assert {r.series_id for r in art.final.collect()} == {"IDX"}
    with pytest.raises(ValueError, match="Insufficient rows"):
        run(short, strict=True)


def test_prediction_checks(spark):
    rows = [("s", "2026-01-01", "1"), ("s", "2026-01-02", "2"), ("s", "2026-01-05", "3")]
    norm = lambda r, h=2: bt.normalize_predictions(spark.createDataFrame(r, "series_id string, ts string, yhat string"), ["series_id"], "ts", "yhat", h, "mine")
    assert [r.yhat for r in norm(rows).orderBy("ts").collect()] == [2.0, 3.0]
    with pytest.raises(Exception, match="mine returned 3 predictions; expected at least 4"):
        norm(rows, 4).collect()
    with pytest.raises(Exception, match="mine returned invalid predictions"):
        norm([*rows, ("s", "2026-01-06", "abc")]).collect()
    with pytest.raises(Exception, match="mine returned invalid prediction dates"):
        norm([*rows, ("s", None, "4")]).collect()


def test_rows_without_time_are_refused(spark):
    df = spark.createDataFrame([("s", dt.date(2026, 1, 1), 1.0), ("s", None, 2.0)], "series_id string, ts date, value double")
    with pytest.raises(Exception, match="NULL in the time column ts"):
        ind.lags(df, ["series_id"], "ts", ["value"]).collect()


def test_windows_keep_nulls(spark):
    d = _series(spark, [1, 2, None, 4, 5, 6, 7, 8, 9, 10])
    w = ind.sliding_windows(d, ["series_id"], "ts", "value", 2, 1).orderBy("origin").collect()
    assert len(w) == 8 and w[1].x == [2.0, None] and w[0].y == [None]


def test_reflect_even_and_short(spark):
    got = _col(ind.centred_mean_reflect(_series(spark, [1, 2, 3, 4, 5, 6]), ["series_id"], "ts", "value", width=4), "value_smooth")
    assert got == [1.5, 1.75, 2.5, 3.5, 4.5, 5.25]
    got = _col(ind.centred_mean_reflect(_series(spark, [1, 3]), ["series_id"], "ts", "value", width=7), "value_smooth")
    assert got == pytest.approx([(3 + 3 + 1 + 1 + 3 + 3 + 1) / 7, (3 + 1 + 1 + 3 + 3 + 1 + 1) / 7])


def test_header_rule(spark):
    df = spark.createDataFrame([(1, 2)], ["A (x) B (y)", "a  b"])
    assert cl.clean_headers(df).columns == ["A", "a__b"]


def test_unknown_model_lists_supported():
    with pytest.raises(ValueError, match="Supported models"):
        bt.resolve("nope")


def test_asof(spark):
    ref = _series(spark, [1, 2, 3], start=dt.date(2026, 1, 1), step_days=2)  # Jan 1, 3, 5
    probe = spark.createDataFrame([("s", dt.date(2026, 1, d)) for d in (1, 2, 4, 6)], "series_id string, ts date")
    out = al.asof_backward(probe, ref, ["series_id"], "ts", "value")
    assert _col(out, "value") == [1.0, 1.0, 2.0, 3.0]


def test_all_zero_columns(spark):
    df = spark.createDataFrame([(0.0, 1.0, None), (1e-9, 2.0, 0.0)], "a double, b double, c double")
    assert cl.all_zero_columns(df) == ["a"]


def test_empty_keys_refused(spark):
    with pytest.raises(ValueError):
        ind.lags(_series(spark, [1, 2]), [], "ts", ["value"])


def test_blocked_equals_unblocked(spark):
    """Halo blocks of 7 rows give the same windows as one block per series."""
    vals = [math.sin(i / 3.0) * 10 + i for i in range(100)]
    d = _series(spark, vals, step_days=3)
    a = ind.feature_bundle(d, ["series_id"], "ts", ["value"], block_rows=7, bucket="week").orderBy("ts").toPandas()
    b = ind.feature_bundle(d, ["series_id"], "ts", ["value"]).orderBy("ts").toPandas()
    assert len(a) == len(b) == 81
    for c in a.columns:
        if c not in ("series_id", "ts"):
            assert list(a[c]) == pytest.approx(list(b[c]), rel=1e-12), c
    f = im.ffill_bfill(_series(spark, [None, 1, None, None, 2, None]), ["series_id"], "ts", ["value"], bucket="day")
    assert _col(f, "value") == [1, 1, 1, 1, 2, 2]


def test_ema_across_arrow_batches_matches_pandas(spark):
    """Tiny Arrow batches make buckets and series straddle batch boundaries."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    rows = []
    for k in ("a", "b", "c"):
        vals = rng.normal(size=150).cumsum() + 50
        vals[[5, 77, 78, 79, *range(100, 112)]] = np.nan
        if k == "b":
            vals[:3] = np.nan
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=3 * i), None if np.isnan(v) else float(v))
                 for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ind.ema(df, ["series_id"], "ts", ["value"], spans=[3, 26]).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pdf = pd.DataFrame(rows, columns=["series_id", "ts", "value"]).sort_values(["series_id", "ts"])
    for sp in (3, 26):
        want = pdf.groupby("series_id")["value"].transform(
            lambda s: s.ewm(span=sp, adjust=False).mean())
        merged = pdf.assign(want=want).merge(got, on=["series_id", "ts"])
        assert len(merged) == len(pdf)
        assert np.allclose(merged["want"], merged[f"value_EMA_{sp}"], rtol=1e-12, atol=1e-9, equal_nan=True)


# The published 19-row final table (FIXTURES.md section 4), anchor first.
GOLDEN_FINAL = """2025-12-17 1673.66 1673.6600 1673.6600
2025-12-18 1676.98 1672.5532 1677.4510
2025-12-19 1704.31 1670.6777 1670.8212
2025-12-22 1751.03 1706.3784 1687.7026
2025-12-23 1772.15 1707.8330 1693.8671
2025-12-24 1782.82 1772.2044 1738.7788
2025-12-25 1742.85 1772.9105 1743.8290
2025-12-26 1729.80 1745.1647 1761.3895
2025-12-29 1754.84 1749.0352 1773.2501
2025-12-30 1766.90 1754.7362 1756.6218
2025-12-31 1784.49 1761.4978 1752.2255
2026-01-07 1861.58 1820.2046 1789.9661
2026-01-08 1855.56 1824.8342 1797.3159
2026-01-09 1867.90 1859.5102 1834.2759
2026-01-12 1877.33 1865.6469 1841.9064
2026-01-13 1902.93 1887.5225 1867.2043
2026-01-14 1894.44 1894.7701 1873.6791
2026-01-15 1864.80 1900.0247 1893.6651
2026-01-16 1879.13 1908.1393 1900.1013"""


def test_golden_published_metrics(spark):
    """F15 on the published final table reproduces the published metrics (tolerance 1e-3)."""
    rows = []
    for line in GOLDEN_FINAL.splitlines():
        d, a, b, m = line.split()
        rows.append(("IDX", dt.date.fromisoformat(d), float(a), float(b), float(m)))
    final = spark.createDataFrame(rows, "series_id string, ts date, actual double, baseline double, predicted double")
    res = {r.Model: r for r in mt.model_comparison(final, ["series_id"], "ts", "actual",
                                                   {"ExponentialSmoothing": "baseline", "LSTM": "predicted"},
                                                   n_tests=20, horizon=2).collect()}
    es, lstm = res["ExponentialSmoothing"], res["LSTM"]
    assert es.MAE == pytest.approx(21.9039, abs=1e-3) and es.RMSE == pytest.approx(27.5553, abs=1e-3)
    assert es["Directional Accuracy"] == pytest.approx(10 / 18)
    assert lstm.MAE == pytest.approx(32.5453, abs=1e-3) and lstm.RMSE == pytest.approx(39.4508, abs=1e-3)
    assert lstm["Directional Accuracy"] == pytest.approx(8 / 18)


def test_feature_bundle_across_arrow_batches(spark):
    """Positions numbered inside the EMA pass stay right when units straddle Arrow batches."""
    vals = [math.sin(i / 4.0) * 10 + i * 0.3 for i in range(160)]
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=2 * i), v + j) for j, k in enumerate("xyz")
            for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    ref = ind.feature_bundle(df, ["series_id"], "ts", ["value"]).orderBy("series_id", "ts").toPandas()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = ind.feature_bundle(df, ["series_id"], "ts", ["value"], block_rows=9) \
            .orderBy("series_id", "ts").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(ref) == 3 * (160 - 19)
    for c in got.columns:
        if c not in ("series_id", "ts"):
            assert list(got[c]) == pytest.approx(list(ref[c]), rel=1e-12), c


def test_run_all_models_and_comparison_table(spark):
    """G21 every configured model in one result set; F16 fixed-name table."""
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    df = spark.createDataFrame([("s", d, 100.0 + (i % 5)) for i, d in enumerate(days)],
                               "series_id string, ts date, y double")
    cfg = bt.ForecastConfig(n_tests=4, n_forecasts=2, seasonal_periods=5, n_lags=2)
    art = bt.run_all(df, ["series_id"], "ts", "y", ["drift", "mean", "seasonal_naive"], cfg)
    assert sorted(r.run_model for r in art.metrics.select("run_model").distinct().collect()) == \
        ["drift", "mean", "seasonal_naive"]
    # period-5 pattern: the seasonal naive forecast repeats the values one season back
    fc = art.forecast.where("model = 'seasonal_naive'").orderBy("step").collect()
    assert [r["Future Predictions"] for r in fc] == [100.0, 101.0]
    t = mt.comparison_table(art.final, "ts", "actual", "predicted", ["series_id"])
    assert t.columns == ["series_id", "Date", "Actual", "Predicted"]

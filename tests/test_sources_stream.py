"""Sources, sinks and the incremental upsert stream (A3-A10, H1, H2)."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align as al
from tidemark.sources import files as fl
from tidemark.sources import html as hp
from tidemark.sources import testdata as td
from tidemark.streaming import upsert as up

SMALL = "/root/testdata/sf0.001"


def test_html_rows_and_pager(spark):
    page = ("<table><tr><th>Ngày</th><th>Giá</th></tr><tr><td> 24/04/2026 </td><td><b>1.234,56</b></td><td></td></tr>"
            "<tr class='footer'><td>x</td></tr></table><div>Page 1 of 37</div>"
            "<a href=\"javascript:GoPage(2, 'a', 'b', '740')\">2</a>")
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    rows = hp.table_rows(df).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["Ngày", "Giá"], ["24/04/2026", "1.234,56"]]
    assert [r.is_header for r in rows] == [True, False]
    later = hp.table_rows(df.withColumn("is_first", F.lit(False)), first_page="is_first").collect()
    assert [r.cells for r in later] == [["24/04/2026", "1.234,56"]]
    mixed = spark.createDataFrame([(1, "u", "<table><tr><th>Name</th><td>x</td></tr></table>out of 9 things")], "page_id long, url string, html string")
    assert [r.cells for r in hp.table_rows(mixed).collect()] == [["Name"]]
    assert hp.page_count(mixed).first().total_pages is None  # no pager
    pc = hp.page_count(df).first()
    assert pc.total_pages == 37 and pc.total_rows == 740


def test_guarded_write_refuses_empty(spark):
    out = tempfile.mkdtemp(prefix="tm-out-") + "/clean"
    with pytest.raises(ValueError, match="refusing to overwrite"):
        fl.write_guarded(spark.createDataFrame([], "a int"), out)
    fl.write_guarded(spark.createDataFrame([(1,)], "a int"), out, fmt="parquet")
    assert spark.read.parquet(out).count() == 1


def test_instrument_dir_scan(spark):
    d = tempfile.mkdtemp(prefix="tm-dir-")
    daily = td.daily(spark, SMALL)
    for sym in ("1-URGENT", "2-HIGH"):
        (daily.where(F.col("series_id") == sym).select(F.col("ts").cast("string").alias("Date"),
                                                          F.col("value").cast("string").alias("Close"))
         .coalesce(1).write.option("header", True).csv(f"{d}/{sym}_tmp"))
        import glob
        import shutil
        part = glob.glob(f"{d}/{sym}_tmp/part-*.csv")[0]
        shutil.copy(part, f"{d}/{sym}_historical_data.csv")
    df = fl.read_instrument_dir(spark, d, columns=["Date", "Close"])
    got = {r.symbol: r["count"] for r in df.groupBy("symbol").count().collect()}
    want = {r.series_id: r["count"] for r in daily.where(F.col("series_id").isin("1-URGENT", "2-HIGH"))
            .groupBy("series_id").count().collect()}
    assert got == want


def test_stream_upsert_equals_batch(spark):
    """H1: streaming the history then the update batch gives the batch C9 result; replays are no-ops."""
    root = tempfile.mkdtemp(prefix="tm-stream-")
    src, table = f"{root}/in", f"{root}/table"
    hist = td.daily(spark, SMALL)
    upd = td.updates(spark, SMALL)
    schema = "series_id string, ts date, value double"
    hist.write.parquet(f"{src}/b0")
    q = up.start_upsert_stream(spark, f"{src}/b*", schema, table, ["series_id"], "ts")
    q.awaitTermination()
    upd.write.parquet(f"{src}/b1")
    q = up.start_upsert_stream(spark, f"{src}/b*", schema, table, ["series_id"], "ts")
    q.awaitTermination()
    got = spark.read.parquet(table).drop(up.BATCH_COL, up.STREAM_COL, up.PART_COL)
    want = al.upsert_latest(hist, upd, ["series_id"], "ts")
    # the update batch only rewrote the months it touched
    months = {r[0] for r in spark.read.parquet(table).where(F.col(up.BATCH_COL) == 1)
              .select(up.PART_COL).distinct().collect()}
    assert months == {r[0] for r in upd.select((F.year("ts") * 100 + F.month("ts")).alias("m")).distinct().collect()}
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    before = spark.read.parquet(table).collect()
    stream = spark.read.parquet(table).where(F.col(up.BATCH_COL) == 1).first()[up.STREAM_COL]
    up.upsert_batch(upd, 1, table, ["series_id"], "ts", stream_id=stream)  # replay of an applied batch
    assert sorted(spark.read.parquet(table).collect()) == sorted(before)


def test_upsert_duplicates_restarts_and_new_columns(spark):
    table = tempfile.mkdtemp(prefix="tm-up-") + "/table"
    schema = "series_id string, ts date, value double, _seq long"
    import datetime as dt
    day = dt.date(2026, 1, 5)
    one = lambda rows, **kw: up.upsert_batch(spark.createDataFrame(rows, schema), 0, table, ["series_id"], "ts", **kw)
    read = lambda: spark.read.option("mergeSchema", True).parquet(table)
    one([("s", day, 1.0, 1), ("s", day, 2.0, 2), ("s", day, 1.5, 0)], stream_id="a")
    assert [r.value for r in read().collect()] == [2.0]  # the last row of the first batch, once
    one([("s", day, 9.0, 1)], stream_id="a")
    assert [r.value for r in read().collect()] == [2.0]  # a replay
    one([("s", day, 3.0, 1)], stream_id="b")
    assert [r.value for r in read().collect()] == [3.0]  # another stream starts at batch 0 too
    wider = spark.createDataFrame([("s", day, 4.0, 1, "x")], schema + ", note string")
    up.upsert_batch(wider, 1, table, ["series_id"], "ts", stream_id="b")
    assert [(r.value, r.note) for r in read().collect()] == [(4.0, "x")]


def test_guarded_write_keeps_the_old_output(spark, monkeypatch):
    out = tempfile.mkdtemp(prefix="tm-swap-") + "/clean"
    fl.write_guarded(spark.createDataFrame([(1,)], "a int"), out, fmt="parquet")
    with pytest.raises(ValueError, match="refusing to overwrite"):
        fl.write_guarded(spark.createDataFrame([], "a int"), out, fmt="parquet")
    assert [r.a for r in spark.read.parquet(out).collect()] == [1]
    real = fl._fs(spark, out)

    class Fails:
        """A file system on which the staged folder cannot take its place."""
        def __getattr__(self, name):
            return getattr(real[0], name)

        def rename(self, a, b):
            return False if str(a.toString()).endswith(".staging") else real[0].rename(a, b)

    monkeypatch.setattr(fl, "_fs", lambda s, p: (Fails(), *real[1:]))
    with pytest.raises(OSError, match="could not move"):
        fl.write_guarded(spark.createDataFrame([(2,)], "a int"), out, fmt="parquet")
    assert [r.a for r in spark.read.parquet(out).collect()] == [1]
    monkeypatch.undo()
    fl.write_guarded(spark.createDataFrame([(3,)], "a int"), out, fmt="parquet")
    assert [r.a for r in spark.read.parquet(out).collect()] == [3]


def test_align_inner_long(spark):
    rows = [("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0), ("b", 2, None), ("a", 3, 4.0), ("b", 3, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, ts int, value double")
    assert sorted(r.value for r in al.align_inner_long(df, "symbol", "ts", "value", 2).collect()) == [1.0, 2.0, 4.0, 5.0]


def test_fault_isolated_runner(spark):
    """A failing model is recorded, the others are written, the run raises at the end."""
    from tidemark.plans import jobs
    written = []
    d = td.daily(spark, SMALL)

    def write(model, art):
        written.append((model, art.metrics.count()))

    with pytest.raises(RuntimeError, match="no_such_model"):
        jobs.run_models_isolated(d, ["series_id"], "ts", "value", ["drift", "no_such_model", "mean"], write)
    assert [m for m, _ in written] == ["drift", "mean"]
    assert all(n == 10 for _, n in written)  # 5 series x (baseline, model)
    final, metrics, forecast = jobs.test_predict(d, ["series_id"], "ts", "value", n_tests=4, n_forecasts=2)
    assert forecast.count() == 10 and metrics.count() == 10


def test_headers_and_metadata_helpers(spark):
    """B4 header clean, B5 translation, B20 reject-on-coerce, C10 other columns, B11 instants."""
    from tidemark.functions import text as tx
    from tidemark.operators import clean as cl
    df = spark.createDataFrame([("1", "2", "x")], "`Close (VND)` string, `Khối lượng GD` string, `Other col` string")
    assert cl.clean_headers(df).columns == ["Close", "Khối_lượng_GD", "Other_col"]
    assert cl.translate_headers(df).columns == ["Close (VND)", "Total Volume", "Other col"]
    assert al.other_columns(df.withColumn("new", F.lit(1)), df) == ["new"]
    bad = spark.createDataFrame([("1.5", 1.5), ("abc", None)], "raw string, parsed double")
    with pytest.raises(ValueError, match="parsed=1"):
        cl.assert_parsed(bad, {"raw": "parsed"})
    ts = spark.createDataFrame([("2026-01-01 23:30:00-05:00",), ("2026-01-02",)], "d string")
    got = [r[0] for r in ts.select(tx.parse_instant_utc_date("d")).collect()]
    import datetime as dt
    assert got == [dt.date(2026, 1, 2), dt.date(2026, 1, 2)]


def test_artifacts_round_trip(spark):
    """A9 write three artifacts partitioned by model (dynamic overwrite), A10 read back."""
    root = tempfile.mkdtemp(prefix="tm-art-")
    from tidemark.plans import jobs
    d = td.daily(spark, SMALL)
    final, metrics, forecast = jobs.test_predict(d, ["series_id"], "ts", "value", n_tests=4, n_forecasts=2)
    tag = F.lit("drift")
    fl.write_artifacts(final.withColumn("run_model", tag), metrics.withColumn("run_model", tag),
                       forecast.withColumn("run_model", tag), root)
    # a second model only replaces its own partition
    fl.write_artifacts(final.withColumn("run_model", F.lit("x")), metrics.withColumn("run_model", F.lit("x")),
                       forecast.withColumn("run_model", F.lit("x")), root)
    back = spark.read.parquet(f"{root}/forecast")
    assert sorted(r.run_model for r in back.select("run_model").distinct().collect()) == ["drift", "x"]
    m = spark.read.parquet(f"{root}/metrics")
    assert sorted(r.Model for r in m.select("Model").distinct().collect()) == ["drift", "naive"]
    csv_dir = tempfile.mkdtemp(prefix="tm-csv-") + "/fc"
    forecast.select(F.col("ts").cast("string").alias("Date"), "Future Predictions").coalesce(1) \
        .write.option("header", True).csv(csv_dir)
    art = fl.read_artifact(spark, csv_dir)
    dates = [r.Date for r in art.collect()]
    assert dates == sorted(dates) and len(dates) == 10


def test_stream_clean_then_upsert(spark):
    """H2: stateless cleaning applied to each micro-batch before the keyed upsert."""
    from tidemark.plans.q_clean import clean_quotes
    root = tempfile.mkdtemp(prefix="tm-h2-")
    src, table = f"{root}/in", f"{root}/table"
    raw = spark.createDataFrame(
        [(1, "IDX", "04/24/2026", "1,234.56", "123,456", "1.50 bil"),
         (2, "IDX", "04/25/2026", "---", "130,000", "1.75 bil"),
         (3, "IDX", "04/25/2026", "1,240.00", "130,000", "1.75 bil")],
        "_seq long, symbol string, Date string, `Price` string, `Total Volume` string, `Total Value` string")
    raw.write.parquet(f"{src}/b0")
    q = up.start_upsert_stream(spark, f"{src}/b*", raw.schema, table, ["symbol"], "Date",
                               transform=lambda b: clean_quotes(b))
    q.awaitTermination()
    got = spark.read.parquet(table).orderBy("Date").collect()
    assert [r.Close for r in got] == [1234.56, 1240.0]


def test_null_keys_are_rejected_by_the_check(spark):
    from tidemark.schema import require_non_null_keys
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "series_id string, value double")
    with pytest.raises(ValueError, match="series_id=1"):
        require_non_null_keys(df, ["series_id"])
    require_non_null_keys(df.where("series_id IS NOT NULL"), ["series_id"])

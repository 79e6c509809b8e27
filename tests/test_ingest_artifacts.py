"""Ingest order over unequal files, artifacts as one, and the clean stream with a watermark."""

import datetime as dt
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import clean as cl
from tidemark.sources import files as fl
from tidemark.streaming import upsert as up


def test_keep_first_is_file_order_at_any_split_size(spark):
    root = tempfile.mkdtemp(prefix="tm-ord-")
    first, last, n = {}, {}, 0
    for name, rows in (("a_historical_data.csv", 400), ("b_historical_data.csv", 3), ("c_historical_data.csv", 1500), ("d_historical_data.csv", 40)):
        with open(f"{root}/{name}", "w") as f:
            f.write("Date,Close\n")
            for i in range(rows):
                n += 1
                day = f"day{(i * 7) % 97:03d}"
                f.write(f"{day},{n}\n")
                first.setdefault(day, str(n))
                last[day] = str(n)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, cost in (("300", "1"), ("4000", "1"), ("100000", "1"), ("134217728", "4194304")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            df = fl.read_csv(spark, root, columns=["Date", "Close"]).repartition(7)
            for keep, want in (("first", first), ("last", last)):
                assert {r.Date: r.Close for r in cl.dedupe(df, ["Date"], keep=keep).collect()} == want
            one = cl.dedupe(fl.read_instrument_dir(spark, root, columns=["Date", "Close"]), ["symbol", "Date"], keep="first")
            assert {r.Date: r.Close for r in one.where("symbol = 'a'").collect()} == {d: v for d, v in first.items() if int(v) <= 400}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_ordinal_of_other_data(spark):
    from tidemark.schema import with_ingest_ordinal
    assert dict(with_ingest_ordinal(spark.range(3)).dtypes)["_seq"] == "bigint"


def _table(spark, model, value):
    return spark.createDataFrame([(model, value)], "run_model string, v int")


def test_artifacts_change_together(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="tm-art-")
    read = lambda: {n: sorted((r.run_model, r.v) for r in d.collect()) for n, d in fl.read_artifacts(spark, root).items()}
    write = lambda m, v: fl.write_artifacts(*[_table(spark, m, v + k) for k in range(3)], root)
    with pytest.raises(ValueError, match="no artifacts"):
        fl.read_artifacts(spark, root)
    write("x", 10)
    write("y", 20)
    before = {"final": [("x", 10), ("y", 20)], "metrics": [("x", 11), ("y", 21)], "forecast": [("x", 12), ("y", 22)]}
    assert read() == before
    # a run that ends after any of its steps leaves the three tables as they were
    with pytest.raises(ValueError, match="refusing"):
        fl.write_artifacts(_table(spark, "x", 30), _table(spark, "x", 31), _table(spark, "x", 32).where("v < 0"), root)
    assert read() == before
    real = fl._manifests
    monkeypatch.setattr(fl, "_manifests", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write("x", 40)
    monkeypatch.setattr(fl, "_manifests", real)
    assert read() == before
    taken = iter([[], ["000000000001.json"]])
    monkeypatch.setattr(fl, "_manifests", lambda *a: next(taken, real(*a)))  # another writer was faster
    with pytest.raises(OSError, match="another run"):
        write("x", 50)
    monkeypatch.setattr(fl, "_manifests", real)
    assert read() == before
    write("x", 60)
    after = {n: [("x", 60 + k), v[1]] for k, (n, v) in enumerate(before.items())}
    assert read() == after
    assert fl.vacuum_artifacts(spark, root) > 0 and read() == after


def test_clean_stream_equals_the_batch_within_the_watermark(spark):
    root = tempfile.mkdtemp(prefix="tm-wm-")
    src, out = f"{root}/in", f"{root}/out"
    os.makedirs(src)
    schema = "symbol string, Date string, Price string"
    files = [[("A", "1/1/2026", "1.0"), ("A", "1/2/2026", "2,000.5"), ("B", "1/1/2026", "5")],
             [("A", "1/2/2026", "9"), ("A", "1/3/2026", "3"), ("B", "1/1/2026", "7"), ("B", "bad", "1")],  # repeats, a bad date
             [("A", "1/25/2026", "4")],
             [("A", "1/3/2026", "8"), ("B", "1/24/2026", "6"), ("A", "1/25/2026", "5")]]  # the first is older than the watermark
    transform = lambda d: d.select("symbol", tx.parse_date(F.col("Date"), "M/d/yyyy").alias("ts"),
                                   tx.thousands_number(F.col("Price")).alias("close")).where("ts IS NOT NULL")

    def feed(k):
        with open(f"{src}/{k}.csv", "w") as f:
            f.write("symbol,Date,Price\n" + "".join(f'{s},{d},"{p}"\n' for s, d, p in files[k]))
        q = up.start_clean_stream(spark, src, schema, out, ["symbol"], "ts", "7 days", transform, fmt="csv", checkpoint=f"{root}/ck")
        q.awaitTermination()
        assert q.exception() is None

    for k in range(len(files)):
        feed(k)
        time.sleep(0.05)
    want, seen = set(), set()
    for s, d, p in [r for f in files for r in f]:
        if d != "bad" and (s, d) not in seen:
            seen.add((s, d))
            month, day, year = map(int, d.split("/"))
            want.add((s, dt.date(year, month, day), float(p.replace(",", ""))))
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want

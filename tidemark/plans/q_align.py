"""Registered alignment (C) and missing-data (D) queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as al
from ..operators import impute as im
from ..operators import indicators as ind
from ..sources import testdata as td
from .registry import register

KEYS = ["series_id"]
FLAGS = ["A", "N", "R"]


def by_status(spark, sf, status: str):
    """Order value per (priority, day) restricted to one order status."""
    o = td.table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ts"))
            .agg(F.sum("o_totalprice").alias(f"value_{status.lower()}")))


def _status_sql(status: str) -> str:
    return (f"SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, SUM(o_totalprice) AS "
            f"value_{status.lower()} FROM orders WHERE o_orderstatus = '{status}' GROUP BY 1, 2")


F_SQL, O_SQL = _status_sql("F"), _status_sql("O")


# C1 / C2 / C3 / C7 --------------------------------------------------------------
@register("c1_inner_join", "series_id:s ts:t value_f:d value_o:d",
          f"SELECT * FROM ({F_SQL}) f JOIN ({O_SQL}) o USING (series_id, ts)")
def q_inner(spark, sf):
    """C1 inner equi-join on (series, date) of filled vs open order value."""
    return al.inner_on(by_status(spark, sf, "F"), by_status(spark, sf, "O"), ["series_id", "ts"])


@register("c2_full_outer_join", "series_id:s ts:t value_f:d value_o:d",
          f"SELECT * FROM ({F_SQL}) f FULL OUTER JOIN ({O_SQL}) o USING (series_id, ts)")
def q_outer(spark, sf):
    """C2 full outer equi-join; join keys coalesced."""
    return al.outer_on(by_status(spark, sf, "F"), by_status(spark, sf, "O"), ["series_id", "ts"])


@register("c3_three_way", "series_id:s ts:t value:d value_Lag1:d value_SMA_10:d",
          td.with_views("""SELECT a.series_id, a.ts, a.value, b.value_Lag1, m.value_SMA_10 FROM daily a
JOIN (SELECT series_id, ts, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS value_Lag1 FROM daily) b
  USING (series_id, ts)
JOIN (SELECT series_id, ts, CASE WHEN count(value) OVER w = 10 THEN avg(value) OVER w END AS value_SMA_10 FROM daily
      WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) m
  USING (series_id, ts)""", "daily"))
def q_three(spark, sf):
    """C3 actual JOIN (naive baseline JOIN moving-average model)."""
    d = td.daily(spark, sf)
    base = ind.lags(d, KEYS, "ts", ["value"], lags=[1], block_rows=256).select("series_id", "ts", "value_Lag1")
    model = ind.sma(d, KEYS, "ts", ["value"], windows=[10], block_rows=256).select("series_id", "ts", "value_SMA_10")
    return al.three_way(d, base, model, ["series_id", "ts"])


@register("c7_union", "source:s series_id:s ts:t value:d",
          td.with_views("SELECT 'daily' AS source, * FROM daily UNION ALL SELECT 'ship' AS source, * FROM ship",
                        "daily", "ship"))
def q_union(spark, sf):
    """C7 union by name of two series tables."""
    return al.union_all(td.daily(spark, sf).withColumn("source", F.lit("daily")),
                        td.ship(spark, sf).withColumn("source", F.lit("ship")))


# C4 / C5 ----------------------------------------------------------------------
@register("c4_align_inner", "ts:t A:d N:d R:d",
          td.with_views("""SELECT ts, max(CASE WHEN series_id = 'A' THEN value END) AS "A",
  max(CASE WHEN series_id = 'N' THEN value END) AS "N", max(CASE WHEN series_id = 'R' THEN value END) AS "R"
FROM ship GROUP BY ts HAVING count(DISTINCT series_id) = 3""", "ship"))
def q_align_inner(spark, sf):
    """C4 N-way inner alignment of instruments by date (single pivot)."""
    return al.align_inner(td.ship(spark, sf), "series_id", "ts", "value", FLAGS)


@register("c5_align_outer_filled", "ts:t A:d N:d R:d",
          td.with_views("""SELECT ts, max(CASE WHEN s = 'A' THEN v END) AS "A", max(CASE WHEN s = 'N' THEN v END) AS "N",
  max(CASE WHEN s = 'R' THEN v END) AS "R"
FROM (
  SELECT g.ts, g.s, coalesce(
      last_value(ship.value IGNORE NULLS) OVER (PARTITION BY g.s ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(ship.value IGNORE NULLS) OVER (PARTITION BY g.s ORDER BY g.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v
  FROM (SELECT c.ts, f.s FROM (SELECT DISTINCT ts FROM ship) c, (SELECT unnest(['A', 'N', 'R']) AS s) f) g
  LEFT JOIN ship ON ship.series_id = g.s AND ship.ts = g.ts
) x GROUP BY ts""", "ship"))
def q_align_outer(spark, sf):
    """C5 N-way outer alignment with per-instrument forward/backward fill."""
    return al.align_outer_filled(td.ship(spark, sf), "series_id", "ts", "value", FLAGS)


@register("c4_align_inner_long", "series_id:s ts:t value:d", td.with_views("""u AS (SELECT * FROM daily UNION ALL SELECT * FROM ship)
SELECT u.* FROM u JOIN (SELECT ts FROM u WHERE value IS NOT NULL GROUP BY ts HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM u)) c USING (ts)
WHERE value IS NOT NULL""", "daily", "ship").replace("GROUP BY 1, 2)\nu AS", "GROUP BY 1, 2),\nu AS", 1))
def q_align_inner_long(spark, sf):
    """C4 in long form: the dates that every series of two tables has; symbols read from the data."""
    return al.align_inner_long(td.daily(spark, sf).unionByName(td.ship(spark, sf)), "series_id", "ts", "value")


@register("c5_align_outer_suppliers", "series_id:i ts:t value:d", td.with_views("""g AS (SELECT s.series_id, c.ts, d.value
  FROM (SELECT DISTINCT series_id FROM supplier_daily) s, (SELECT DISTINCT ts FROM supplier_daily) c LEFT JOIN supplier_daily d ON d.series_id = s.series_id AND d.ts = c.ts)
SELECT series_id, ts, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM g""",
    "supplier_daily").replace("GROUP BY 1, 2)\ng AS", "GROUP BY 1, 2),\ng AS", 1))
def q_align_suppliers(spark, sf):
    """C5 in long form over every supplier: all suppliers at all dates, gaps filled per supplier, no pivot."""
    return al.align_outer_long(td.supplier_daily(spark, sf), "series_id", "ts", "value")


# C6 ----------------------------------------------------------------------------
def ship_probes(spark, sf):
    li = td.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    o = td.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_orderpriority").alias("series_id"), F.to_date("l_shipdate").alias("ts")).distinct())


_PROBE_SQL = ("SELECT DISTINCT o_orderpriority AS series_id, CAST(l_shipdate AS DATE) AS ts "
              "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


@register("c6_asof_backward", "series_id:s ts:t value:d",
          td.with_views(f"""SELECT p.series_id, p.ts, d.value FROM ({_PROBE_SQL}) p
ASOF LEFT JOIN daily d ON p.series_id = d.series_id AND p.ts >= d.ts""", "daily"))
def q_asof(spark, sf):
    """C6 as-of lookup: order value of the same priority at or before each ship date."""
    return al.asof_backward(ship_probes(spark, sf), td.daily(spark, sf), KEYS, "ts", "value")


# C8 ----------------------------------------------------------------------------
@register("c8_splice_history", "series_id:s ts:t value:d",
          td.with_views(f"""t AS (SELECT series_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn,
  count(*) OVER (PARTITION BY series_id) AS n FROM daily) q WHERE 2 * rn > n),
p AS (SELECT series_id, ts, value_o AS value FROM ({O_SQL}) o)
SELECT series_id, ts, value FROM (
  SELECT p.*, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn,
         count(*) OVER (PARTITION BY series_id) AS np FROM p) x
JOIN (SELECT series_id, count(*) AS nt FROM t GROUP BY 1) c USING (series_id)
WHERE rn <= np - nt
UNION ALL SELECT * FROM t""", "daily").replace("GROUP BY 1, 2)\nt AS", "GROUP BY 1, 2),\nt AS", 1))
def q_splice(spark, sf):
    """C8 prepend the open-order series' older history to the later half of each daily series (count rule)."""
    d = ind.positions(td.daily(spark, sf), KEYS, "ts")
    target = d.where(2 * F.col("rn") > F.col("rn") + F.col("rn_desc") - 1).drop("rn", "rn_desc")
    proxy = by_status(spark, sf, "O").withColumnRenamed("value_o", "value")
    return al.splice_history(target, proxy, KEYS, "ts")


# C9 ----------------------------------------------------------------------------
@register("c9_upsert_latest", "series_id:s ts:t value:d",
          td.with_views("""SELECT series_id, ts, arg_max(value, r) AS value FROM (
  SELECT *, 0 AS r FROM daily UNION ALL SELECT *, 1 AS r FROM updates) u GROUP BY 1, 2""", "daily", "updates"))
def q_upsert(spark, sf):
    """C9 keyed upsert of the latest batch over history, newest wins."""
    return al.upsert_latest(td.daily(spark, sf), td.updates(spark, sf), KEYS, "ts")


# D1 / D3 ------------------------------------------------------------------------
_CAL_SQL = """cal AS (
  SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts
  FROM (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM daily GROUP BY 1) s),
dense AS (SELECT c.series_id, c.ts, d.value FROM cal c LEFT JOIN daily d USING (series_id, ts)
          WHERE isodow(c.ts) <= 5)"""


@register("d1_d3_densify_fill", "series_id:s ts:t value:d filled:d",
          td.with_views(f"""{_CAL_SQL}
SELECT series_id, ts, value, coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  AS filled FROM dense""", "daily").replace("FROM orders GROUP BY 1, 2)\n", "FROM orders GROUP BY 1, 2),\n", 1))
def q_densify(spark, sf):
    """D3 business-day calendar per series, then D1 forward+backward fill."""
    dense = im.densify_business_days(td.daily(spark, sf), KEYS, "ts")
    return im.ffill_bfill(dense.withColumn("filled", F.col("value")), KEYS, "ts", ["filled"])


# D2 ----------------------------------------------------------------------------
_D2_SQL = td.with_views(f"""{_CAL_SQL},
m AS (SELECT d.series_id, d.ts, d.value AS t, o.value_o AS c,
        sum(CASE WHEN d.value IS NULL OR d.value = 0 THEN 1 ELSE 0 END)
          OVER (PARTITION BY d.series_id ORDER BY d.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb
      FROM dense d LEFT JOIN ({O_SQL}) o USING (series_id, ts)),
n AS (SELECT *, first_value(CASE WHEN c IS NOT NULL THEN {{'c': c, 't': t, 'b': cb}} END IGNORE NULLS)
        OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM m)
SELECT series_id, ts, t AS value,
  CASE WHEN c IS NULL AND nx IS NOT NULL AND t IS NOT NULL AND nx.b = cb THEN nx.c * t / nx.t ELSE c END AS value_o
FROM n""", "daily").replace("FROM orders GROUP BY 1, 2)\n", "FROM orders GROUP BY 1, 2),\n", 1)


@register("d2_proportional_backcast", "series_id:s ts:t value:d value_o:d", _D2_SQL)
def q_backcast(spark, sf):
    """D2 proportional backcast of open-order value from the (densified) daily target."""
    dense = im.densify_business_days(td.daily(spark, sf), KEYS, "ts")
    m = dense.join(by_status(spark, sf, "O"), ["series_id", "ts"], "left")
    return im.proportional_backcast(m, KEYS, "ts", ["value_o"], "value")


# D4 / D5 ------------------------------------------------------------------------
@register("d4_d5_drop_trailing", "series_id:s ts:t value:d value_o:d",
          td.with_views(f"""SELECT m.* FROM (SELECT d.series_id, d.ts, d.value, o.value_o FROM daily d
    LEFT JOIN ({O_SQL}) o USING (series_id, ts)) m
JOIN (SELECT series_id, max(CASE WHEN o.value_o IS NOT NULL THEN d.ts END) AS lv FROM daily d
    LEFT JOIN ({O_SQL}) o USING (series_id, ts) GROUP BY 1) l USING (series_id)
WHERE m.ts <= l.lv""", "daily"))
def q_trailing(spark, sf):
    """D4/D5 drop trailing rows whose target (open-order value) is NULL, per series."""
    m = td.daily(spark, sf).join(by_status(spark, sf, "O"), ["series_id", "ts"], "left")
    return im.drop_trailing_nulls(m, KEYS, "ts", ["value_o"])


# D6 / D7 ------------------------------------------------------------------------
_D6_SQL = td.with_views(f"""{_CAL_SQL},
k AS (SELECT series_id, ts, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS p FROM dense),
e AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN {{'v': value, 'p': p}} END IGNORE NULLS)
    OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pr,
  first_value(CASE WHEN value IS NOT NULL THEN {{'v': value, 'p': p}} END IGNORE NULLS)
    OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM k),
s AS (SELECT series_id, ts, value, CASE
    WHEN value IS NOT NULL THEN value
    WHEN pr IS NOT NULL AND nx IS NOT NULL AND (p - pr.p <= 2 OR nx.p - p <= 2)
      THEN pr.v + (nx.v - pr.v) * CAST(p - pr.p AS DOUBLE) / CAST(nx.p - pr.p AS DOUBLE)
    WHEN pr IS NOT NULL AND p - pr.p <= 2 AND nx IS NULL THEN pr.v
    WHEN nx IS NOT NULL AND nx.p - p <= 2 AND pr IS NULL THEN nx.v END AS s1 FROM e)
SELECT series_id, ts, coalesce(s1, avg(s1) OVER (PARTITION BY series_id ORDER BY ts
    ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS value_filled,
  coalesce(value, 0.0) AS value_zero FROM s""", "daily").replace(
    "FROM orders GROUP BY 1, 2)\n", "FROM orders GROUP BY 1, 2),\n", 1)


@register("d6_d7_interpolate_fill", "series_id:s ts:t value_filled:d value_zero:d", _D6_SQL)
def q_interp(spark, sf):
    """D6 limited linear interpolation then centred rolling-mean fill; D7 zero fill."""
    dense = im.densify_business_days(td.daily(spark, sf), KEYS, "ts")
    d = dense.withColumn("value_zero", F.col("value"))
    d = im.zero_fill(d, ["value_zero"])
    d = im.interpolate_then_rolling(d, KEYS, "ts", "value", limit_linear=2, rolling=5, out="value_filled",
                                    block_rows=256)
    return d.select("series_id", "ts", "value_filled", "value_zero")


# D9 / D10 ----------------------------------------------------------------------
@register("d9_gap_distribution", "series_id:s gap_seconds:i n:i",
          td.with_views("""SELECT series_id, gap_seconds, count(*) AS n FROM (
  SELECT series_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS gap_seconds FROM hourly) g
WHERE gap_seconds IS NOT NULL GROUP BY 1, 2""", "hourly"))
def q_gaps(spark, sf):
    """D9 distribution of gaps between consecutive hourly timestamps."""
    return im.gap_distribution(td.hourly(spark, sf), KEYS, "ts", block_rows=256, bucket="day")


@register("d10_drop_null_target", "series_id:s ts:t value:d value_o:d",
          td.with_views(f"""SELECT d.series_id, d.ts, d.value, o.value_o FROM daily d
LEFT JOIN ({O_SQL}) o USING (series_id, ts) WHERE o.value_o IS NOT NULL""", "daily"))
def q_dropnull(spark, sf):
    """D10 drop rows with a NULL target."""
    m = td.daily(spark, sf).join(by_status(spark, sf, "O"), ["series_id", "ts"], "left")
    return im.drop_null_target(m, "value_o")

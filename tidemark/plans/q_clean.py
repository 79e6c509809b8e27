"""Registered cleaning queries (B-operators, G19/G28) over raw-text views.

The raw views render numbers from the given tables as scraped, locale
formatted text (Vietnamese decimal/grouping marks, money units, missing
marks), the same way in Spark and DuckDB, so the parsers are checked
end to end against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean as cl
from ..sources import testdata as td
from .registry import register


def _vi_grouped(int_col) -> F.Column:
    return F.translate(F.format_number(int_col, 0), ",", ".")


def raw_quotes(spark, sf: str) -> DataFrame:
    """Scraped-style rows, one per order: every cell is text."""
    o = td.table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    vi_price = F.concat(_vi_grouped(F.floor(cents / 100)), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    unit = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(" tỷ")).otherwise(F.lit(" triệu"))
    return o.select(
        F.col("o_orderkey").alias("_seq"),
        F.col("o_orderpriority").alias("symbol"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"),
        F.when(F.col("o_orderstatus") == "P", F.lit("---")).otherwise(vi_price).alias("Price"),
        _vi_grouped(F.col("o_custkey") * 1000 + 7).alias("Total Volume"),
        F.when(F.col("o_orderstatus") == "O", F.lit("  "))
         .otherwise(F.concat(vi_price, unit)).alias("Total Value"),
    )


RAW_QUOTES_SQL = """SELECT o_orderkey AS _seq, o_orderpriority AS symbol, strftime(o_orderdate, '%d/%m/%Y') AS "Date",
  CASE WHEN o_orderstatus = 'P' THEN '---' ELSE vi_price END AS "Price",
  replace(format('{:,}', o_custkey * 1000 + 7), ',', '.') AS "Total Volume",
  CASE WHEN o_orderstatus = 'O' THEN '  '
       ELSE vi_price || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ' tỷ' ELSE ' triệu' END
  END AS "Total Value"
FROM (SELECT *, replace(format('{:,}', CAST(floor(cents / 100) AS BIGINT)), ',', '.') || ',' ||
         lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS vi_price
      FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) a) b"""


def _sql_vi_decimal(x: str) -> str:
    t = f"trim({x})"
    return (f"CASE WHEN contains({t}, ',') AND contains({t}, '.') AND regexp_matches({t}, ',[^.]*$') "
            f"THEN replace(replace({t}, '.', ''), ',', '.') "
            f"WHEN contains({t}, ',') AND NOT contains({t}, '.') THEN replace({t}, ',', '.') ELSE {t} END")


def _sql_vi_integer(x: str) -> str:
    t = f"trim({x})"
    return (f"CASE WHEN contains({t}, '.') AND NOT contains({t}, ',') AND regexp_matches(replace({t}, '.', ''), '^[0-9]+$') "
            f"THEN format('{{:,}}', CAST(replace({t}, '.', '') AS HUGEINT)) ELSE {t} END")


def _sql_vi_money(x: str) -> str:
    t = f"trim({x})"
    stripped = f"trim(CASE WHEN contains({t}, 'tỷ') THEN replace({t}, 'tỷ', '') ELSE replace({t}, 'triệu', '') END)"
    num = f"TRY_CAST({_sql_vi_decimal(stripped)} AS DOUBLE)"
    unit = f"CASE WHEN contains({t}, 'tỷ') THEN ' bil' ELSE ' mil' END"
    return (f"CASE WHEN contains({t}, 'tỷ') OR contains({t}, 'triệu') "
            f"THEN coalesce(format('{{:,.2f}}', {num}) || {unit}, {x}) ELSE {x} END")


_NORMALIZED_SQL = f"""SELECT _seq, symbol,
  coalesce(strftime(try_strptime("Date", '%d/%m/%Y'), '%m/%d/%Y'), "Date") AS "Date",
  {_sql_vi_decimal('"Price"')} AS "Price",
  {_sql_vi_integer('"Total Volume"')} AS "Total Volume",
  {_sql_vi_money('"Total Value"')} AS "Total Value"
FROM ({RAW_QUOTES_SQL}) r"""


@register("b12_b16_normalize_scraped", "_seq:i symbol:s Date:s Price:s Total Volume:s Total Value:s",
          _NORMALIZED_SQL)
def q_normalize(spark, sf):
    """B12-B16 locale normalisation of scraped text columns."""
    return cl.normalize_scraped(raw_quotes(spark, sf))


def _sql_suffix_number(x: str) -> str:
    t = f"replace(trim({x}), ',', '')"
    return (f"CASE WHEN {t} IS NULL OR {t} = '' OR {t} = '---' THEN NULL "
            f"WHEN suffix({t}, ' bil') THEN TRY_CAST(replace({t}, ' bil', '') AS DOUBLE) * 1e9 "
            f"WHEN suffix({t}, ' mil') THEN TRY_CAST(replace({t}, ' mil', '') AS DOUBLE) * 1e6 "
            f"ELSE TRY_CAST({t} AS DOUBLE) END")


def _blank(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\s*$') OR {x} = '---' THEN NULL ELSE {x} END"


_CLEAN_SQL = f"""SELECT symbol, "Date", arg_min(close, _seq) AS "Close",
  arg_min(vol, _seq) AS "Total Volume", arg_min(val, _seq) AS "Total Value"
FROM (
  SELECT _seq, symbol, CAST(try_strptime("Date", '%m/%d/%Y') AS DATE) AS "Date",
    {_sql_suffix_number('c')} AS close, {_sql_suffix_number('v')} AS vol, {_sql_suffix_number('m')} AS val
  FROM (SELECT _seq, symbol, {_blank('"Date"')} AS "Date", {_blank('"Price"')} AS c,
               {_blank('"Total Volume"')} AS v, {_blank('"Total Value"')} AS m
        FROM ({_NORMALIZED_SQL}) n) b
  WHERE "Date" IS NOT NULL AND c IS NOT NULL AND v IS NOT NULL AND m IS NOT NULL
) p
WHERE "Date" IS NOT NULL AND close IS NOT NULL AND vol IS NOT NULL AND val IS NOT NULL
GROUP BY symbol, "Date\""""


def clean_quotes(df: DataFrame, keys=("symbol",), strict: bool = False) -> DataFrame:
    """G19/G28 instrument cleaning: required columns, blanks, parse, rename, dedupe keep first.

    The source drops rows with a missing required field, parses, drops rows
    whose parsed fields are NULL and keeps the first row per date.  Parsing
    maps NULL to NULL, so "first row per date among rows with every parsed
    field present" is the same result; it is computed by the dedupe aggregate
    itself (invalid rows do not compete), which keeps the text expressions out
    of pushed-down filters.  In strict mode the parse is guarded so a row with
    a missing field is dropped rather than raising, as in the source.
    """
    keys = list(keys)
    required = ["Date", "Price", "Total Volume", "Total Value"]
    cl.select_required(df, [*keys, *required], "quote")
    d = cl.blanks_to_null(df.select("_seq", *keys, *required), required)
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(f"`{c}`").isNotNull()

    nums = ["Price", "Total Volume", "Total Value"]
    # stage the prepared text so each parse reads it once per row
    d = d.withColumns({f"_p{i}": tx.prepare_number_text(F.col(f"`{c}`")) for i, c in enumerate(nums)})

    def num(c):
        parsed = tx.suffix_number_prepared(F.col(f"_p{nums.index(c)}"), strict=strict)
        return F.when(complete, parsed) if strict else parsed

    d = d.select("_seq", *keys, tx.parse_date(F.col("Date"), "M/d/yyyy").alias("Date"),
                 num("Price").alias("Close"), num("Total Volume").alias("Total Volume"),
                 num("Total Value").alias("Total Value"))
    valid = F.col("Close").isNotNull() & F.col("`Total Volume`").isNotNull() \
        & F.col("`Total Value`").isNotNull()
    out = cl.dedupe(d, [*keys, "Date"], keep="first", valid=valid).drop("_seq")
    return out.where(F.col("Date").isNotNull())


@register("b17_g28_clean_quotes", "symbol:s Date:t Close:d Total Volume:d value_mil:d",
          "SELECT symbol, \"Date\", \"Close\", \"Total Volume\", \"Total Value\" / 1e6 AS value_mil FROM ("
          + _CLEAN_SQL + ") c")
def q_clean(spark, sf):
    """B1/B2/B6/B7/B10/B17/B3/B9 cleaning job over normalised scraped quotes (value shown in millions)."""
    d = clean_quotes(cl.normalize_scraped(raw_quotes(spark, sf)))
    return d.withColumn("value_mil", F.col("`Total Value`") / 1e6).drop("Total Value")


# B18 / B19 on part prices ------------------------------------------------------
def raw_volumes(spark, sf: str) -> DataFrame:
    p = td.table(spark, sf, "part")
    suffix = F.when(F.col("p_size") < 10, F.lit("M")).when(F.col("p_size") < 30, F.lit("K")).otherwise(F.lit(""))
    return p.select("p_partkey", F.concat(F.format_number("p_retailprice", 2), suffix).alias("vol_text"))


@register("b18_b19_volume_text", "p_partkey:i vol_text:s volume:d plain:d",
          """SELECT p_partkey, vol_text,
  CASE WHEN contains(replace(vol_text, ',', ''), 'M') THEN TRY_CAST(replace(replace(vol_text, ',', ''), 'M', '') AS DOUBLE) * 1e6
       WHEN contains(replace(vol_text, ',', ''), 'K') THEN TRY_CAST(replace(replace(vol_text, ',', ''), 'K', '') AS DOUBLE) * 1e3
  END AS volume,
  TRY_CAST(replace(vol_text, ',', '') AS DOUBLE) AS plain
FROM (SELECT p_partkey, format('{:,.2f}', p_retailprice) ||
        CASE WHEN p_size < 10 THEN 'M' WHEN p_size < 30 THEN 'K' ELSE '' END AS vol_text FROM part) a""")
def q_volume(spark, sf):
    """B18 M/K suffixed volumes and B19 thousands-stripped numbers."""
    d = raw_volumes(spark, sf)
    return d.select("p_partkey", "vol_text", tx.suffix_volume("vol_text").alias("volume"),
                    tx.thousands_number("vol_text").alias("plain"))


# B8 whole-row distinct / B25 minimum history ------------------------------------
@register("b8_distinct_rows", "symbol:s Date:s Price:s _seq:i",
          f"""SELECT symbol, "Date", "Price", min(_seq) AS _seq FROM ({RAW_QUOTES_SQL}) r
GROUP BY symbol, "Date", "Price\"""")
def q_distinct(spark, sf):
    """B8 whole-row distinct over (symbol, Date, Price) keeping the first ordinal."""
    return cl.distinct_rows(raw_quotes(spark, sf).select("symbol", "Date", "Price", "_seq"))


@register("b25_min_history", "series_id:s ts:t value:d",
          td.with_views("""SELECT * FROM supplier_daily WHERE series_id IN
  (SELECT series_id FROM supplier_daily GROUP BY 1 HAVING count(*) >= 60)""", "supplier_daily"))
def q_min_history(spark, sf):
    """B25 keep only series with at least 60 rows."""
    return cl.min_history(td.supplier_daily(spark, sf), ["series_id"], 60)


@register("b22_remove_outliers", "series_id:s ts:t value:d",
          td.with_views("""SELECT series_id, ts, value FROM (
  SELECT series_id, ts, value, lag(value) OVER w AS prev FROM ship WINDOW w AS (PARTITION BY series_id ORDER BY ts)) a
WHERE NOT coalesce(prev = 0 AND value <> 0, false) AND abs(coalesce(value / NULLIF(prev, 0) - 1, 0)) <= 0.03""", "ship"))
def q_outliers(spark, sf):
    """B22 outlier filter: |change vs unfiltered previous row| <= 3%."""
    return cl.remove_outliers(td.ship(spark, sf), ["series_id"], "ts", "value", 0.03)

"""Registered page-parsing queries (A6, A7) over rendered pages, and file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean as cl
from ..session import ensure_checkpoint_dir
from ..sources import files as fl
from ..sources import html as hp
from ..sources import testdata as td
from .registry import register


PER_PAGE = 50


def order_pages(spark, sf):
    """The orders table as a listing of HTML pages: title row, at most ``PER_PAGE`` rows, a footer row with the pager."""
    o = td.table(spark, sf, "orders")
    page = F.floor(F.col("o_orderkey") / PER_PAGE).cast("long")
    tr = F.concat(F.lit("<tr class='r'><td> "), F.col("o_orderkey").cast("string"), F.lit("</td><td><b>"), F.col("o_orderpriority"),
                  F.lit("</b></td>\n<td class=x>"), F.col("o_orderstatus"), F.lit("</td><td></td></tr>"))
    x = o.groupBy(page.alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", tr.alias("tr")))).alias("rows"))  # PER_PAGE at most
    body = F.array_join(F.transform("rows", lambda r: r["tr"]), "")
    last, n = o.agg(F.floor(F.max("o_orderkey") / PER_PAGE).cast("long"), F.count(F.lit(1))).first()
    html = F.concat(F.lit("<table><tr><th>Key</th><th>Priority</th><th>Status</th></tr>"), body,
                    F.lit("<tr class='TableFooter'><td><span>Page "), (F.col("page_id") + 1).cast("string"), F.lit(" of </span><b>"),
                    F.lit(str(int(last or 0) + 1)), F.lit("</b></td><td><a onclick=\"GoPage('g', 'p', 2, "), F.lit(str(n)),
                    F.lit(");\">Next</a></td></tr></table>"))
    return x.select("page_id", (F.col("page_id") == 0).alias("is_first"), html.alias("html"))


@register("a6_html_table_rows", "page_id:i row_no:i cells:s", f"""
WITH o AS (SELECT o_orderkey // {PER_PAGE} AS page_id, row_number() OVER (PARTITION BY o_orderkey // {PER_PAGE} ORDER BY o_orderkey) AS row_no,
  o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus AS cells FROM orders)
SELECT * FROM o UNION ALL SELECT 0, 0, 'Key|Priority|Status' WHERE EXISTS (SELECT 1 FROM o WHERE page_id = 0)""")
def q_rows(spark, sf):
    """A6 rows and cells read back from the orders listing (title row of the first page only, no footer rows)."""
    r = hp.table_rows(order_pages(spark, sf), first_page="is_first")
    return r.select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


@register("a7_pager_counts", "page_id:i total_pages:i total_rows:i", f"""
SELECT DISTINCT o_orderkey // {PER_PAGE} AS page_id, (SELECT max(o_orderkey) // {PER_PAGE} + 1 FROM orders) AS total_pages,
  (SELECT count(*) FROM orders) AS total_rows FROM orders""")
def q_pager(spark, sf):
    """A7 page count from the pager text and total rows from the pager link, per page of the orders listing."""
    return hp.page_count(order_pages(spark, sf)).select("page_id", "total_pages", "total_rows")


# Files: written to the shared folder and read back -------------------------------------------------
def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@register("a1_a3_a8_csv_round_trip", "series_id:s ts:t value:d", td.with_views("SELECT * FROM daily", "daily"))
def q_csv(spark, sf):
    """A3/A8 guarded CSV sink, then A1/A2/A5: a column-limited scan of strings, typed afterwards (the files are
    written when the query is built)."""
    path = _scratch(spark) + "/daily"
    fl.write_guarded(td.daily(spark, sf).select("series_id", "ts", F.col("value").cast("string").alias("value"), F.lit("x").alias("note")), path)
    back = fl.read_csv(spark, path, columns=["series_id", "ts", "value"], ordinal=False)
    return back.select("series_id", F.to_date("ts").alias("ts"), F.col("value").cast("double").alias("value"))


@register("a9_artifacts", "run_model:s series_id:s ts:t value:d", td.with_views("SELECT 'sum' AS run_model, * FROM daily UNION ALL SELECT 'sum2', series_id, ts, 2 * value FROM daily", "daily"))
def q_artifacts(spark, sf):
    """A9 artifact triples of two models, the second rewritten, read back through the newest manifest (written when
    the query is built)."""
    root, d = _scratch(spark), td.daily(spark, sf)
    for model, times in (("sum", 1), ("sum2", 7), ("sum2", 2)):
        rows = d.select(F.lit(model).alias("run_model"), "series_id", "ts", (F.col("value") * times).alias("value"))
        fl.write_artifacts(rows, rows.groupBy("run_model", "series_id").count(), rows.groupBy("run_model", "series_id").agg(F.max("ts").alias("ts")), root)
    return fl.read_artifacts(spark, root)["final"]


@register("b4_b5_b26_headers", "series_id:s Trade_Date:t Close:d Total Volume:d", td.with_views(
    """SELECT series_id, ts AS "Trade_Date", value AS "Close", 2 * value AS "Total Volume" FROM daily""", "daily"))
def q_headers(spark, sf):
    """B4 header clean, B5 translation of a known foreign header, B26 order at the sink."""
    d = td.daily(spark, sf)
    raw = cl.clean_headers(d.select("series_id", F.col("ts").alias("Trade Date (UTC)"), F.col("value").alias("Close (thousands)")))
    known = next(k for k, v in tx.HEADER_TRANSLATIONS.items() if v == "Total Volume")
    return cl.sort_for_sink(cl.translate_headers(raw.withColumn(known, 2 * F.col("Close"))), ["series_id"], "Trade_Date")

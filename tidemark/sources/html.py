"""HTML table rows and pager counts from a raw-pages table (A6, A7), natively.

Scraping itself (browser automation) is not built; the page parsing is
re-aimed as a job over a ``(page_id, url, html)`` table: rows and cells are
pulled out with ``regexp_extract_all`` and ``posexplode`` -- no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_RE = r"(?is)<tr([^>]*)>(.*?)</tr>"
TH_RE = r"(?is)<th(?:\s[^>]*)?>(.*?)</th>"
TD_RE = r"(?is)<td(?:\s[^>]*)?>(.*?)</td>"
TAG_RE = r"(?s)<[^>]*>"


def _is_footer(attrs, footer_class: str):
    return F.lower(attrs).contains(footer_class.lower())


def table_rows(pages: DataFrame, page_col: str = "page_id", html_col: str = "html",
               footer_class: str = "footer", first_page: str | None = None) -> DataFrame:
    """(page, row_no, is_header, cells array<string>) for every table row.

    Rows whose ``<tr>`` carries ``footer_class`` are skipped.  A row's cells are its ``<th>`` cells if it has
    any, else its ``<td>`` cells; their text has tags stripped and is trimmed, and a trailing empty cell is
    dropped.  ``first_page`` names a boolean column: on pages where it is false the first row of the table
    (the title row, repeated on every page of a listing) is skipped.
    """
    keep_first = F.lit(True) if first_page is None else F.coalesce(F.col(first_page), F.lit(False))
    rows = pages.select(page_col, keep_first.alias("_first"), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(ROW_RE), 0))
                        .alias("row_no", "tr"))
    rows = rows.where(F.col("_first") | (F.col("row_no") > 0))
    rows = rows.where(~_is_footer(F.regexp_extract("tr", r"(?is)^<tr([^>]*)>", 1), footer_class))
    head, body = F.regexp_extract_all("tr", F.lit(TH_RE), 1), F.regexp_extract_all("tr", F.lit(TD_RE), 1)
    rows = rows.withColumn("is_header", F.size(head) > 0)
    cells = F.transform(F.when(F.col("is_header"), head).otherwise(body), lambda c: F.trim(F.regexp_replace(c, TAG_RE, "")))
    rows = rows.withColumn("cells", cells)
    last_empty = (F.size("cells") > 0) & (F.element_at("cells", -1) == "")
    rows = rows.withColumn("cells", F.when(last_empty, F.slice("cells", 1, F.size("cells") - 1))
                           .otherwise(F.col("cells")))
    return rows.where(F.size("cells") > 0).select(page_col, "row_no", "is_header", "cells")


def page_count(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Total pages and total rows from the pager: the text ``Page k of N`` (tags stripped), and the fourth
    argument of the ``GoPage(...)`` call of its link; NULL on a page without them."""
    text = F.regexp_replace(F.regexp_replace(F.col(html_col), TAG_RE, " "), r"\s+", " ")
    pages_n = F.regexp_extract(text, r"(?i)\bpage \d+ of (\d+)", 1)
    rows_n = F.regexp_extract(F.col(html_col), r"GoPage\(\s*[^,)]*,\s*[^,)]*,\s*[^,)]*,\s*'?(\d+)", 1)
    return pages.withColumns({
        "total_pages": F.when(pages_n != "", pages_n.cast("long")),
        "total_rows": F.when(rows_n != "", rows_n.cast("long")),
    })

"""Locale-aware parsing of scraped text as native column expressions.

No Python UDF is involved: each function returns a ``Column`` built from
``regexp_*``, ``try_*`` casts and ``format_number``, so it stays inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source data conventions.
# Header translation (Vietnamese -> English), unknown headers kept as is:
HEADER_TRANSLATIONS = {
    "Ngày": "Date",
    "Thay đổi": "Change",
    "Khối lượng GD": "Total Volume",
    "Giá trị GD": "Total Value",
    "KL NN mua": "Foreign Buy Volume",
    "Giá trị NN mua": "Foreign Buy Value",
    "KL NN bán": "Foreign Sell Volume",
    "Giá trị NN bán": "Foreign Sell Value",
}
VOLUME_COLUMNS = ["Total Volume", "Foreign Buy Volume", "Foreign Sell Volume"]
VALUE_COLUMNS = ["Total Value", "Foreign Buy Value", "Foreign Sell Value"]
MISSING_MARK = "---"
UNIT_BILLION_VI = "tỷ"
UNIT_MILLION_VI = "triệu"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank_to_null(col: str | Column) -> Column:
    """Whitespace-only text or the exact missing mark -> NULL."""
    c = _c(col)
    return F.when(c.rlike(r"^\s*$") | (c == F.lit(MISSING_MARK)), F.lit(None).cast("string")).otherwise(c)


def parse_date(col: str | Column, fmt: str = "M/d/yyyy", strict: bool = False) -> Column:
    """Text -> DATE.  Unpadded patterns accept padded input too; two-digit years 69 to 99 are of the 1900s."""
    c = _c(col)
    d = F.to_date(c, fmt) if strict else F.try_to_date(c, fmt)
    if "yy" in fmt and "yyyy" not in fmt:
        d = F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)
    return d


def parse_instant_utc_date(col: str | Column, formats=("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXXX",
                                                        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """Mixed timestamps with offsets -> UTC calendar date (session TZ must be UTC)."""
    c = _c(col)
    return F.to_date(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]))


def vi_date_to_us(col: str | Column) -> Column:
    """dd/mm/yyyy text -> mm/dd/yyyy text; text that does not parse is returned unchanged."""
    c = _c(col)
    return F.coalesce(F.date_format(F.try_to_date(c, "d/M/yyyy"), "MM/dd/yyyy"), c)


def vi_decimal(col: str | Column) -> Column:
    """B13: '1.234,56' -> '1234.56'; '1234,5' -> '1234.5'; others trimmed, unchanged.

    Both source branches (dot-grouped with decimal comma, and comma only) are
    "some comma has no dot after it"; then dots are dropped and commas become
    dots in one ``translate``.
    """
    t = F.trim(_c(col))
    return F.when(t.rlike(r",[^.]*$"), F.translate(t, ",.", ".")).otherwise(t)


def vi_integer(col: str | Column) -> Column:
    """Dot-grouped digits '1.234.567' -> '1,234,567'; others trimmed, unchanged."""
    t = F.trim(_c(col))
    ok = t.rlike(r"^(?=.*[.])[0-9.]*[0-9][0-9.]*$")
    return F.when(ok, F.format_number(F.translate(t, ".", "").cast("decimal(38,0)"), 0)).otherwise(t)


def money_unit(t: Column) -> Column:
    """'bil' / 'mil' / NULL from trimmed money text."""
    return F.when(t.contains(UNIT_BILLION_VI), F.lit("bil")).when(t.contains(UNIT_MILLION_VI), F.lit("mil"))


def money_strip(t: Column) -> Column:
    """Trimmed money text without its unit word."""
    return F.when(t.contains(UNIT_BILLION_VI), F.regexp_replace(t, UNIT_BILLION_VI, "")) \
        .otherwise(F.regexp_replace(t, UNIT_MILLION_VI, ""))


def vi_money(col: str | Column) -> Column:
    """B15: '1.234,5 tỷ' -> '1,234.50 bil', '12 triệu' -> '12.00 mil'; failures keep the input."""
    raw = _c(col)
    t = F.trim(raw)
    unit = F.when(t.contains(UNIT_BILLION_VI), F.lit("bil")).when(t.contains(UNIT_MILLION_VI), F.lit("mil"))
    # literal patterns only: a column-valued pattern is recompiled whenever it changes between rows
    stripped = F.when(unit == "bil", F.regexp_replace(t, UNIT_BILLION_VI, "")) \
        .otherwise(F.regexp_replace(t, UNIT_MILLION_VI, ""))
    num = vi_decimal(stripped).try_cast("double")
    return F.coalesce(F.concat(F.format_number(num, 2), F.lit(" "), unit), raw)


def suffix_number(col: str | Column, strict: bool = False) -> Column:
    """Strip; blank/'---' -> NULL; drop commas; ' bil' x1e9, ' mil' x1e6; else a plain number.

    ``strict`` raises on unparsable text (ANSI cast), otherwise it yields NULL.
    """
    return suffix_number_prepared(prepare_number_text(col), strict)


def prepare_number_text(col: str | Column) -> Column:
    """B17 first step: trimmed text without thousands commas (stage it as a column when
    the parse is applied to many rows, so it is computed once)."""
    return F.translate(F.trim(_c(col)), ",", "")


def suffix_number_prepared(t: Column, strict: bool = False) -> Column:
    """B17 second step on ``prepare_number_text`` output."""
    scale = F.when(t.endswith(" bil"), F.lit(1e9)).when(t.endswith(" mil"), F.lit(1e6))
    text = (F.when(t.isin("", MISSING_MARK), F.lit(None).cast("string"))
            .when(scale == 1e9, F.regexp_replace(t, " bil", ""))
            .when(scale == 1e6, F.regexp_replace(t, " mil", ""))
            .otherwise(t))
    num = text.cast("double") if strict else text.try_cast("double")
    return num * F.coalesce(scale, F.lit(1.0))


def suffix_volume(col: str | Column) -> Column:
    """B18: '557.83M' -> 557830000, '107.03K' -> 107030; anything else -> NULL."""
    t = F.translate(_c(col), ",", "")
    scale = F.when(t.contains("M"), F.lit(1e6)).when(t.contains("K"), F.lit(1e3))
    digits = F.when(scale == 1e6, F.regexp_replace(t, "M", "")).otherwise(F.regexp_replace(t, "K", ""))
    return digits.try_cast("double") * scale


def thousands_number(col: str | Column, strict: bool = False) -> Column:
    """B19: '1,234.5' -> 1234.5."""
    t = F.translate(_c(col), ",", "")
    return t.cast("double") if strict else t.try_cast("double")

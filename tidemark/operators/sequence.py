"""Ordered-series execution that never puts a whole series into one task.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends every row of a series
to one task; one hot series holding a third of the table would then be a third
of the job in one task.  Everything ordered in this package goes through the
three building blocks below instead:

* ``index_rows`` -- global 1-based position ``_rn`` of each row in its series.
  Row numbers are taken inside (series, time bucket) groups, and a tiny
  per-bucket count table (series x buckets rows, partial aggregation) supplies
  the offset of every bucket.
* ``bounded`` -- windows that look at most ``before`` rows back / ``after``
  rows ahead.  Rows are cut into blocks of ``block_rows`` positions; the last
  ``before`` rows of a block are copied into the next block (and the first
  ``after`` rows into the previous one) as halo rows, the window runs per
  (series, block), and halo rows are dropped.  Results equal the per-series
  window for any lookback <= the halo.
* ``scan_last`` / ``scan_first`` / ``scan_both`` / ``scan_sum`` /
  ``scan_product`` / ``ema`` -- unbounded prefix (and suffix) scans.  Each
  (series, time bucket) is scanned locally; a summary row per bucket is
  scanned over the small bucket table to get the value carried into each
  bucket; the carry is joined back.  One full shuffle per scan.

Join sides that are summaries are left to AQE, which broadcasts them only when
their measured size is under the threshold and shuffle-joins them otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..schema import as_list, require_keys

RN = "_rn"
BLK = "_blk"
HALO = "_halo"
TB = "_tb"

DEFAULT_BLOCK_ROWS = 1 << 16
DEFAULT_BUCKET = "month"


def _bucket(ts: str, bucket: str) -> Column:
    """Time bucket of a row; a row without a time has no place in a series and fails the job."""
    none = F.raise_error(F.lit(f"NULL in the time column {ts}"))
    return F.coalesce(F.date_trunc(bucket, F.col(ts)), none.cast("timestamp"))


def index_rows(df: DataFrame, keys: Sequence[str] | str, ts: str, *,
               bucket: str = DEFAULT_BUCKET, tiebreak: Sequence[str] = (),
               counts_from: DataFrame | None = None, local_rn: str | None = None,
               size: str | None = None) -> DataFrame:
    """Add ``_rn``: 1-based position of the row in its series ordered by (ts, tiebreak).

    ``counts_from`` may name a cheaper frame with exactly the same (keys, ts)
    rows (e.g. the input of an opaque Python stage) to take bucket counts from,
    so the expensive frame is not computed twice.  ``local_rn`` names a column
    that already holds the 1-based row number inside (keys, bucket) (e.g. from
    ``ema(emit_local_rn=True)``); the row-number window is then skipped.  ``size``
    names a column for the number of rows of the series (from the same counts).
    """
    keys = require_keys(keys)
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    # an existing bucket column (e.g. left by ``ema(keep_bucket=True)``) keeps the
    # upstream (series, bucket) partitioning usable, so the window needs no exchange
    d = df if TB in df.columns else df.withColumn(TB, _bucket(ts, bucket))
    if local_rn is not None:
        local = d.withColumnRenamed(local_rn, "_lrn")
    else:
        local = d.withColumn("_lrn", F.row_number().over(
            Window.partitionBy(*keys, TB).orderBy(*order)))
    src = d if counts_from is None else counts_from.withColumn(TB, _bucket(ts, bucket))
    counts = src.groupBy(*keys, TB).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy(TB).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, TB, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                            *([F.sum("_cnt").over(Window.partitionBy(*keys)).alias(size)] if size else []))
    return (local.join(offsets, [*keys, TB])
            .withColumn(RN, (F.col("_off") + F.col("_lrn")).cast("long"))
            .drop(TB, "_lrn", "_off"))


def series_sizes(df: DataFrame, keys: Sequence[str] | str, name: str = "_n") -> DataFrame:
    """(keys, n): rows per series; one partial aggregate."""
    keys = require_keys(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_halo(df: DataFrame, keys: Sequence[str], *, before: int = 0, after: int = 0,
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Assign ``_blk`` and duplicate boundary rows as halo copies (``_halo`` = true)."""
    b = max(int(block_rows), int(before), int(after), 1)
    pos0 = F.col(RN) - 1
    own = F.floor(pos0 / b).cast("long")
    pos = pos0 % b
    targets = F.array(
        own,
        F.when(F.lit(before > 0) & (pos >= b - before), own + 1),
        F.when(F.lit(after > 0) & (pos < after) & (own > 0), own - 1),
    )
    return (df.withColumn("_own", own)
            .withColumn(BLK, F.explode(F.filter(targets, lambda x: x.isNotNull())))
            .withColumn(HALO, F.col(BLK) != F.col("_own"))
            .drop("_own"))


def bounded(df: DataFrame, keys: Sequence[str] | str, ts: str,
            compute: Callable[[DataFrame, WindowSpec], DataFrame], *,
            before: int = 0, after: int = 0, block_rows: int = DEFAULT_BLOCK_ROWS,
            bucket: str = DEFAULT_BUCKET, keep_rn: bool = False,
            tiebreak: Sequence[str] = (), counts_from: DataFrame | None = None,
            local_rn: str | None = None) -> DataFrame:
    """Run row windows with lookback <= ``before`` and lookahead <= ``after``.

    ``compute(d, w)`` receives the halo'd frame and ``w`` =
    ``partitionBy(keys, _blk).orderBy(_rn)`` and returns ``d`` with new columns.
    """
    keys = require_keys(keys)
    if RN in df.columns:
        d = df
    else:
        d = index_rows(df, keys, ts, bucket=bucket, tiebreak=tiebreak, counts_from=counts_from,
                       local_rn=local_rn)
    d = with_halo(d, keys, before=before, after=after, block_rows=block_rows)
    w = Window.partitionBy(*keys, BLK).orderBy(RN)
    out = compute(d, w).where(~F.col(HALO)).drop(BLK, HALO)
    return out if keep_rn else out.drop(RN)


# --------------------------------------------------------------------------
# unbounded scans: local per (series, bucket) + carry over the bucket table
# --------------------------------------------------------------------------

def _carry_join(d: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return d.join(carry, [*keys, TB], "left")


def scan_last(df: DataFrame, keys: Sequence[str] | str, ts: str, cols: Sequence[str], *,
              bucket: str = DEFAULT_BUCKET, out: Callable[[str], str] | None = None,
              tiebreak: Sequence[str] = ()) -> DataFrame:
    """Forward fill: last non-null value at or before each row, per series."""
    keys = require_keys(keys)
    cols = as_list(cols)
    out = out or (lambda c: c)
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    d = df.withColumn(TB, _bucket(ts, bucket))
    upto = Window.partitionBy(*keys, TB).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumns({f"_l_{c}": F.last(c, True).over(upto) for c in cols})
    ord_struct = F.struct(*order)
    summary = d.groupBy(*keys, TB).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ord_struct)).alias(f"_s_{c}") for c in cols])
    prior = Window.partitionBy(*keys).orderBy(TB).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, TB, *[F.last(f"_s_{c}", True).over(prior).alias(f"_c_{c}") for c in cols])
    res = _carry_join(local, carry, keys)
    res = res.withColumns({out(c): F.coalesce(F.col(f"_l_{c}"), F.col(f"_c_{c}")) for c in cols})
    drop = [f"_l_{c}" for c in cols] + [f"_c_{c}" for c in cols] + [TB]
    return res.drop(*[x for x in drop if x not in {out(c) for c in cols}])


def scan_first(df: DataFrame, keys: Sequence[str] | str, ts: str, cols: Sequence[str], *,
               bucket: str = DEFAULT_BUCKET, out: Callable[[str], str] | None = None,
               tiebreak: Sequence[str] = ()) -> DataFrame:
    """Backward fill: first non-null value at or after each row, per series."""
    keys = require_keys(keys)
    cols = as_list(cols)
    out = out or (lambda c: c)
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    d = df.withColumn(TB, _bucket(ts, bucket))
    after = Window.partitionBy(*keys, TB).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    local = d.withColumns({f"_l_{c}": F.first(c, True).over(after) for c in cols})
    ord_struct = F.struct(*order)
    summary = d.groupBy(*keys, TB).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ord_struct)).alias(f"_s_{c}") for c in cols])
    later = Window.partitionBy(*keys).orderBy(TB).rowsBetween(1, Window.unboundedFollowing)
    carry = summary.select(*keys, TB, *[F.first(f"_s_{c}", True).over(later).alias(f"_c_{c}") for c in cols])
    res = _carry_join(local, carry, keys)
    res = res.withColumns({out(c): F.coalesce(F.col(f"_l_{c}"), F.col(f"_c_{c}")) for c in cols})
    drop = [f"_l_{c}" for c in cols] + [f"_c_{c}" for c in cols] + [TB]
    return res.drop(*[x for x in drop if x not in {out(c) for c in cols}])


def scan_product(df: DataFrame, keys: Sequence[str] | str, ts: str, col: str, out: str, *,
                 bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """Running product of ``col`` (nulls skipped) from the series start to each row."""
    keys = require_keys(keys)
    d = df.withColumn(TB, _bucket(ts, bucket))
    upto = Window.partitionBy(*keys, TB).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_lp", F.product(F.coalesce(F.col(col), F.lit(1.0))).over(upto))
    summary = d.groupBy(*keys, TB).agg(F.product(F.coalesce(F.col(col), F.lit(1.0))).alias("_bp"))
    prior = Window.partitionBy(*keys).orderBy(TB).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, TB, F.coalesce(F.product("_bp").over(prior), F.lit(1.0)).alias("_cp"))
    return (_carry_join(local, carry, keys)
            .withColumn(out, F.col("_lp") * F.col("_cp"))
            .drop("_lp", "_cp", TB))


# --------------------------------------------------------------------------
# exponential moving average (adjust=False recursion), exact and bucketed
# --------------------------------------------------------------------------

def ema(df: DataFrame, keys: Sequence[str] | str, ts: str, cols: Sequence[str],
        spans: Sequence[int], *, bucket: str = DEFAULT_BUCKET,
        out: Callable[[str, int], str] | None = None, keep_bucket: bool = False,
        emit_local_rn: str | None = None, emit_rn: str | None = None) -> DataFrame:
    """``e_t = (b e + a x_t) / (b + a)`` with ``a = 2/(span+1)`` and ``b = (1-a)^g``, seeded by the first value.

    ``g`` is the number of rows since the last value, so without NULLs this is ``(1-a) e + a x_t`` and a value
    after NULL rows weighs more (weights by absolute position).  A NULL row reports the state; rows before the
    first value are NULL.
    Plan: (1) native per-bucket summary: the first value, the product ``P`` of the keep weights ``b / (b + a)``
    of the later values and their weighted sum ``L`` (weights <= 1, nothing overflows), and the NULL rows at
    both ends; (2) per-series carry over the small bucket table; (3) one Arrow pass per (series, bucket) running
    the recursion from the carried state.
    ``emit_rn`` names a column for the row's 1-based position in its series, from the counts of the same summary;
    rows without a key, which have none, are then left out.
    """
    keys = require_keys(keys)
    cols = as_list(cols)
    spans = [int(s) for s in spans]
    out = out or (lambda c, s: f"{c}_EMA_{s}")
    alphas = {s: 2.0 / (s + 1.0) for s in spans}
    # one exchange by (series, bucket) feeds both the summaries and the recursion pass
    d = df.withColumn(TB, _bucket(ts, bucket)).repartition(*keys, TB)

    # (1) bucket summaries, native
    rows = Window.partitionBy(*keys, TB).orderBy(ts)
    earlier, later = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(1, Window.unboundedFollowing)
    s = d.withColumn("_rnb", F.row_number().over(rows))
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("_rnb"))
        s = s.withColumn(f"_g_{c}", at - F.max(at).over(earlier))  # NULL at the first value of a bucket
        aggs += [F.count(F.col(c)).alias(f"_n_{c}"), F.min_by(F.col(c), at).alias(f"_x0_{c}"),
                 (F.min(at) - 1).alias(f"_lead_{c}"), (F.max(F.col("_rnb")) - F.max(at)).alias(f"_trail_{c}")]
    for c in cols:
        for sp in spans:
            a = alphas[sp]
            w = F.pow(F.lit(1.0 - a), F.col(f"_g_{c}"))
            keep = F.when(w.isNotNull(), F.log(F.greatest(w / (w + a), F.lit(1e-300))))
            s = s.withColumn(f"_k_{c}_{sp}", keep)
            s = s.withColumn(f"_s_{c}_{sp}", F.exp(F.coalesce(F.sum(f"_k_{c}_{sp}").over(later), F.lit(0.0))))
            aggs += [F.exp(F.coalesce(F.sum(f"_k_{c}_{sp}"), F.lit(0.0))).alias(f"_P_{c}_{sp}"),
                     F.coalesce(F.sum(F.col(c) * (a / (w + a)) * F.col(f"_s_{c}_{sp}")), F.lit(0.0)).alias(f"_L_{c}_{sp}")]
    summary = s.groupBy(*keys, TB).agg(*aggs)

    # (2) carry over buckets: the bucket table (series x buckets rows) is
    # hash-partitioned by series and sorted, then streamed; the state of the
    # current series is carried across Arrow batch boundaries.
    carry_fields = [f"_c_{c}_{sp}" for c in cols for sp in spans] + [f"_b_{c}" for c in cols] + ["_off"] * bool(emit_rn)
    carry_schema = ", ".join([*(f"`{k}` {t}" for k, t in _key_types(df, keys)), f"{TB} timestamp"]
                             + [f"{f} double" for f in carry_fields])

    def _carry(batches):
        last_key, off = None, 0
        state, blank = {c: [None] * len(spans) for c in cols}, dict.fromkeys(cols, 0)
        for pdf in batches:
            if pdf.empty:
                continue
            n = len(pdf)
            res = pdf[[*keys, TB]].copy()
            starts = _unit_starts(pdf, keys, last_key).tolist()
            cols_out = {f: [0.0] * n for f in carry_fields}
            col = {f: pdf[f].tolist() for f in pdf.columns if f not in (*keys, TB)}
            cnt = col["_cnt"]
            if emit_rn:
                offs = cols_out["_off"]
                for i in range(n):
                    off = 0 if starts[i] else off
                    offs[i] = float(off)
                    off += int(cnt[i])
            for c in cols:
                known, first, lead, trail, gaps = (col[f"_n_{c}"], col[f"_x0_{c}"], col[f"_lead_{c}"], col[f"_trail_{c}"], cols_out[f"_b_{c}"])
                per = [(j, 1.0 - alphas[sp], alphas[sp], col[f"_P_{c}_{sp}"], col[f"_L_{c}_{sp}"], cols_out[f"_c_{c}_{sp}"]) for j, sp in enumerate(spans)]
                st, bl = state[c], blank[c]
                for i in range(n):
                    if starts[i]:
                        st, bl = [None] * len(spans), 0
                    gaps[i] = float(bl)
                    some = known[i] > 0
                    for j, keep_w, a, prod, part, held in per:
                        now = st[j]
                        held[i] = float("nan") if now is None else now
                        if some:
                            x0 = first[i]
                            if now is not None:
                                w = keep_w ** (bl + lead[i] + 1)
                                x0 = (w * now + a * x0) / (w + a)
                            st[j] = prod[i] * x0 + part[i]
                    bl = int(trail[i]) if some else bl + int(cnt[i])
                state[c], blank[c] = st, bl
            for f, v in cols_out.items():
                res[f] = v
            last_key = tuple(pdf[k].iloc[-1] for k in keys)
            yield res

    carry = (summary.repartition(*keys).sortWithinPartitions(*keys, TB)
             .mapInPandas(_carry, carry_schema))

    # (3) recursion per (series, bucket) from the carried state.  Partitions are
    # hash-partitioned by (series, bucket) and sorted, then streamed as bounded
    # Arrow batches: one vectorised grouped ewm per batch over many units, with
    # the state carried across a batch boundary when a unit straddles it.
    joined = d.join(carry, [*keys, TB], "left")
    base_fields = [f for f in joined.schema.fields if f.name not in carry_fields]
    out_names = [out(c, sp) for c in cols for sp in spans]
    keep = [f.name for f in base_fields if f.name not in out_names]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base_fields
                            if f.name not in out_names] + [f"`{n}` double" for n in out_names]
                           + [f"`{n}` long" for n in (emit_local_rn, emit_rn) if n])
    unit_cols = [*keys, TB]

    def _run(batches):
        last_unit, last_state, last_blank, last_count = None, {}, {}, 0
        for pdf in batches:
            if emit_rn:
                pdf = pdf[pdf["_off"].notna()].reset_index(drop=True)
            if pdf.empty:
                continue
            starts = _unit_starts(pdf, unit_cols, None)
            first_rows = np.flatnonzero(starts)
            code = np.cumsum(starts) - 1
            continues = last_unit is not None and tuple(pdf[k].iloc[0] for k in unit_cols) == last_unit
            res = pdf[keep].copy()
            lrn = np.arange(len(pdf)) - first_rows[code] + 1
            if continues:
                lrn[code == 0] += last_count
            if emit_local_rn:
                res[emit_local_rn] = lrn.astype("int64")
            if emit_rn:
                res[emit_rn] = lrn.astype("int64") + pdf["_off"].to_numpy(dtype="int64")
            for c in cols:
                x = pdf[c].to_numpy(dtype="float64")
                known = np.flatnonzero(~np.isnan(x))
                units, at = np.unique(code[known], return_index=True)
                at = known[at]  # each unit's first value
                blank = pdf[f"_b_{c}"].to_numpy(dtype="float64")[first_rows].copy()  # NULL rows just before each unit
                if continues:
                    blank[0] = last_blank[c]
                gap = blank[units] + at - first_rows[units] + 1
                y, begin = np.repeat(x[:, None], len(spans), axis=1), []
                for i, sp in enumerate(spans):
                    start = pdf[f"_c_{c}_{sp}"].to_numpy(dtype="float64")[first_rows].copy()
                    if continues:
                        start[0] = last_state[(c, sp)]
                    w = (1.0 - alphas[sp]) ** gap
                    met = (w * start[units] + alphas[sp] * x[at]) / (w + alphas[sp])
                    y[at, i] = np.where(np.isnan(start[units]), x[at], met)
                    begin.append(start)
                e = _ewm(y, first_rows, code, spans)
                for i, sp in enumerate(spans):
                    vals = np.where(np.isnan(e[:, i]), begin[i][code], e[:, i])
                    res[out(c, sp)] = vals
                    last_state[(c, sp)] = vals[-1]
                last = known[-1] if known.size and code[known[-1]] == code[-1] else None
                last_blank[c] = len(x) - 1 - last if last is not None else blank[-1] + len(x) - first_rows[-1]
            last_unit = tuple(pdf[k].iloc[-1] for k in unit_cols)
            last_count = int(lrn[-1])
            yield res

    ordered = joined.sortWithinPartitions(*unit_cols, ts)
    res = ordered.mapInPandas(_run, out_schema)
    return res if keep_bucket else res.drop(TB)


#: Rows of the longest unit up to which a step takes one row of every unit; longer ones run unit by unit.
SHORT_UNIT = 64


def _ewm(y: np.ndarray, first_rows: np.ndarray, code: np.ndarray, spans: Sequence[int]) -> np.ndarray:
    """Column i: pandas' ``ewm(span=spans[i], adjust=False, ignore_na=False).mean()`` of ``y[:, i]`` in every unit."""
    n = len(y)
    size = np.diff(np.append(first_rows, n))
    if size.max() > SHORT_UNIT:
        return np.column_stack([pd.Series(y[:, i]).groupby(code, sort=False).ewm(span=sp, adjust=False, ignore_na=False).mean().to_numpy()
                                for i, sp in enumerate(spans)])
    a = np.array([2.0 / (sp + 1.0) for sp in spans])
    order = np.argsort(-size, kind="stable")
    at, live = first_rows[order], np.searchsorted(-size[order], -np.arange(size.max()), "left")
    e, state, old = np.empty_like(y), np.full((len(size), len(spans)), np.nan), np.ones((len(size), len(spans)))
    for k, m in enumerate(live):  # the k-th rows of the m units that are so long
        x, s, w = y[at[:m] + k], state[:m], old[:m] * (1.0 - a)
        w = np.where(np.isnan(s), 1.0, w)
        met = np.where(s == x, s, (w * s + a * x) / (w + a))
        seen = ~np.isnan(x)
        state[:m] = np.where(seen, np.where(np.isnan(s), x, met), s)
        old[:m] = np.where(seen, 1.0, w)
        e[at[:m] + k] = state[:m]
    return e


def _unit_starts(pdf: pd.DataFrame, cols: Sequence[str], prev_last: tuple | None) -> np.ndarray:
    """Boolean array: row i starts a new unit (contiguous run of equal ``cols`` values)."""
    n = len(pdf)
    starts = np.zeros(n, dtype=bool)
    starts[0] = True
    for c in cols:
        v = pdf[c].to_numpy()
        if n > 1:
            starts[1:] |= v[1:] != v[:-1]
    if prev_last is not None and tuple(pdf[c].iloc[0] for c in cols) == prev_last:
        starts[0] = False
    return starts


def _key_types(df: DataFrame, keys: Sequence[str]) -> list[tuple[str, str]]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(k, types[k]) for k in keys]


def scan_sum(df: DataFrame, keys: Sequence[str] | str, ts: str, col: str, out: str, *,
             bucket: str = DEFAULT_BUCKET, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Running sum of ``col`` (nulls as 0) from the series start to each row."""
    keys = require_keys(keys)
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    d = df.withColumn(TB, _bucket(ts, bucket))
    upto = Window.partitionBy(*keys, TB).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_ls", F.sum(F.coalesce(F.col(col), F.lit(0))).over(upto))
    summary = d.groupBy(*keys, TB).agg(F.sum(F.coalesce(F.col(col), F.lit(0))).alias("_bs"))
    prior = Window.partitionBy(*keys).orderBy(TB).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, TB, F.coalesce(F.sum("_bs").over(prior), F.lit(0)).alias("_cs"))
    return (_carry_join(local, carry, keys)
            .withColumn(out, F.col("_ls") + F.col("_cs"))
            .drop("_ls", "_cs", TB))


def scan_both(df: DataFrame, keys: Sequence[str] | str, ts: str, cols: Sequence[str], *,
              bucket: str = DEFAULT_BUCKET, prev: Callable[[str], str] | None = None,
              nxt: Callable[[str], str] | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Last non-null value at or before, and first non-null value at or after, each row --
    both directions in one (series, bucket) pass with one summary and two carries."""
    keys = require_keys(keys)
    cols = as_list(cols)
    prev = prev or (lambda c: f"{c}_prev")
    nxt = nxt or (lambda c: f"{c}_next")
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    d = df.withColumn(TB, _bucket(ts, bucket))
    w = Window.partitionBy(*keys, TB).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    local = d.withColumns({**{f"_lp_{c}": F.last(c, True).over(upto) for c in cols},
                           **{f"_lf_{c}": F.first(c, True).over(after) for c in cols}})
    ord_struct = F.struct(*order)
    summary = d.groupBy(*keys, TB).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ord_struct)).alias(f"_sl_{c}") for c in cols],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ord_struct)).alias(f"_sf_{c}") for c in cols])
    prior = Window.partitionBy(*keys).orderBy(TB).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(TB).rowsBetween(1, Window.unboundedFollowing)
    carry = summary.select(*keys, TB, *[F.last(f"_sl_{c}", True).over(prior).alias(f"_cl_{c}") for c in cols],
                           *[F.first(f"_sf_{c}", True).over(later).alias(f"_cf_{c}") for c in cols])
    res = _carry_join(local, carry, keys)
    res = res.withColumns({**{prev(c): F.coalesce(F.col(f"_lp_{c}"), F.col(f"_cl_{c}")) for c in cols},
                           **{nxt(c): F.coalesce(F.col(f"_lf_{c}"), F.col(f"_cf_{c}")) for c in cols}})
    tmp = [f"_{p}_{c}" for p in ("lp", "lf", "cl", "cf") for c in cols] + [TB]
    return res.drop(*tmp)


def next_row(df: DataFrame, keys: Sequence[str] | str, ts: str, col: str, out: str, first: str, *,
             bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """``out``: ``col`` (ascending with ``ts``, not NULL) of the series' next row, NULL on the last; ``first``: whether
    the row is the series' first.  One (series, bucket) pass; a bucket's last row takes the next bucket's least."""
    keys = require_keys(keys)
    d = df.withColumn(TB, _bucket(ts, bucket))
    w = Window.partitionBy(*keys, TB).orderBy(ts)
    local = d.withColumns({"_ln": F.lead(col).over(w), "_lf": F.row_number().over(w) == 1})
    series = Window.partitionBy(*keys).orderBy(TB)
    carry = d.groupBy(*keys, TB).agg(F.min(col).alias("_least")).select(
        *keys, TB, F.lead("_least").over(series).alias("_cn"), (F.row_number().over(series) == 1).alias("_cf"))
    return (_carry_join(local, carry, keys)
            .withColumns({out: F.coalesce("_ln", "_cn"), first: F.col("_lf") & F.col("_cf")})
            .drop("_ln", "_lf", "_cn", "_cf", TB))

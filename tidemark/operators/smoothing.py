"""Holt linear trend and additive Holt-Winters (G7-G9) as streamed state machines.

The recursions need one value after the other, so a series is read in order, but never as a whole: with
given parameters it runs as a parallel scan of affine maps over blocks of rows (``smooth_fixed``).  For the search
rows stream through ``mapInPandas`` over partitions sorted by (series, parameter chunk, time), and the only state
is level, trend and one season per parameter cell of the chunk.  Series and chunks of the parameter grid run
in parallel.  One pass gives every backtest fold: at each fold's origin the errors so far pick the chunk's
best cell and its forecast is emitted; the best chunk is an aggregate over a few rows.

Parameters are chosen per series and fold from a grid by one-step squared error.  A missing value leaves the
state to its own forecast.  A series of fewer than two seasons (Holt: two rows) has no start: it gives NULL
fitted values and no forecast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_keys
from . import sequence as seq
from .backtest import ForecastConfig, origins, register_scan

GRID = np.round(np.arange(0.05, 1.0, 0.1), 2)
CELLS_PER_CHUNK = 125


def grid(period: int) -> np.ndarray:
    """(cells, 3): alpha, beta, gamma; gamma is 0 without a season."""
    axes = (GRID, GRID, GRID if period > 1 else np.zeros(1))
    return np.stack([x.ravel() for x in np.meshgrid(*axes, indexing="ij")], 1)


class Smoother:
    """Level, trend and season of many parameter cells of one series; ``period`` 1 is Holt's linear trend."""

    def __init__(self, cells: np.ndarray, period: int):
        self.a, self.b, self.g = cells.T
        self.m, self.t, self.first, self.ready = period, 0, [], False

    def start(self) -> bool:
        """Initial state from the first two seasons (Holt: the first two values)."""
        y, m = np.asarray(self.first), self.m
        if len(y) < 2 * m:
            return False
        y = np.where(np.isnan(y), np.nanmean(y) if not np.isnan(y).all() else 0.0, y)
        k = len(self.a)
        level = y[:m].mean()
        self.level, self.trend = np.full(k, level), np.full(k, (y[m:2 * m].mean() - level) / m)
        if m == 1:
            self.level = self.level - self.trend  # so that the first value is met exactly
        self.season = np.tile(y[:m] - level if m > 1 else np.zeros(1), (k, 1))
        self.sse, self.ready = np.zeros(k), True
        return True

    def step(self, y: float) -> np.ndarray:
        """One-step forecast of every cell, before ``y`` is learned."""
        i = self.t % self.m
        s = self.season[:, i]
        f = self.level + self.trend + s
        if y != y:
            y = f
        elif self.t >= self.m:
            self.sse = self.sse + (y - f) ** 2
        level = self.a * (y - s) + (1 - self.a) * (self.level + self.trend)
        self.trend = self.b * (level - self.level) + (1 - self.b) * self.trend
        if self.m > 1:
            self.season[:, i] = self.g * (y - level) + (1 - self.g) * s
        self.level = level
        self.t += 1
        return f

    def forecast(self, cell: int, h: int) -> list[float]:
        return [float(self.level[cell] + k * self.trend[cell] + self.season[cell, (self.t + k - 1) % self.m]) for k in range(1, h + 1)]


def fit(y: Sequence[float], period: int) -> tuple[Smoother, int]:
    """Smoother over the whole grid after ``y``, and its best cell."""
    s = Smoother(grid(period), period)
    s.first = list(map(float, y[:2 * period]))
    if not s.start():
        raise ValueError(f"needs at least two full seasons ({2 * period} rows), got {len(y)}")
    for v in y:
        s.step(float(v))
    return s, int(np.argmin(s.sse))


def _typed(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)


def scan_forecasts(rows: DataFrame, keys: list[str], order: str, value: str, mark: str, period: int, h: int) -> DataFrame:
    """(keys, mark, sse, cell array, f array) of the best cell at every row whose ``mark`` is not null."""
    cells = grid(period)
    chunks = [cells[a:a + CELLS_PER_CHUNK] for a in range(0, len(cells), CELLS_PER_CHUNK)]
    nk = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s, waiting = None, None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name=None):
                key, y, at = r[:nk + 1], r[nk + 1], r[nk + 2]
                if key != now:
                    now, s, waiting = key, Smoother(chunks[key[-1]], period), []
                if not s.ready:
                    s.first.append(float("nan") if y is None else float(y))
                    waiting.append((y, at))
                    if len(waiting) < 2 * period or not s.start():
                        continue
                    todo, waiting = waiting, []
                else:
                    todo = [(y, at)]
                for v, mark_at in todo:
                    s.step(float("nan") if v is None else float(v))
                    if mark_at is not None and mark_at == mark_at and s.t >= 2 * period:
                        best = int(np.argmin(s.sse))
                        out.append((*key[:-1], int(mark_at), float(s.sse[best]), [float(x[best]) for x in (s.a, s.b, s.g)], s.forecast(best, h)))
            yield pd.DataFrame(out, columns=[*keys, "mark", "sse", "cell", "f"])

    x = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))).alias("_chunk"), F.col(value).cast("double").alias("_y"),
                    F.col(mark).cast("int").alias("_mark"), F.col(order).alias("_o"))
    x = x.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_o")
    got = x.select(*keys, "_chunk", "_y", "_mark").mapInPandas(run, f"{_typed(rows, keys)}, mark int, sse double, cell array<double>, f array<double>")
    best = F.min_by(F.struct("sse", "cell", "f"), F.struct("sse", "cell"))
    return got.groupBy(*keys, "mark").agg(best.alias("_b")).select(*keys, "mark", "_b.*")


def _register(name: str, period) -> None:
    @register_scan(name, need_rows=lambda cfg: cfg.n_folds * cfg.n_forecasts + 2 * period(cfg))
    def forecast(pos: DataFrame, keys: list[str], value: str, cfg: ForecastConfig) -> DataFrame:
        h = cfg.n_forecasts
        at = F.when(((F.col("rn_desc") - 1) % h == 0) & (F.col("rn_desc") <= cfg.n_folds * h + 1), F.floor((F.col("rn_desc") - 1) / h) - 1)
        got = scan_forecasts(pos.withColumn("_at", at), keys, "rn", value, "_at", period(cfg), h)
        steps = got.select(*keys, F.col("mark").alias("fold"), F.posexplode("f").alias("_p", "yhat"))
        return steps.withColumn("step", F.col("_p") + 1).drop("_p").join(origins(pos, keys, value, cfg), [*keys, "fold"])


_register("holt", lambda cfg: 1)
_register("holt_winters", lambda cfg: cfg.seasonal_periods)


class Lanes:
    """One parameter cell's recursion on many states at once: lane k starts from the k-th unit vector and sees only
    zeros, the last lane starts from zero and sees the values.  A step is affine in the state (level, trend, season
    of each phase), so after a block the lanes are the columns of its map: state after = A @ state before + b."""

    def __init__(self, cell: tuple[float, float, float], period: int):
        self.a, self.b, self.g, self.m = *cell, period
        eye = np.eye(period + 2, period + 3)
        self.level, self.trend, self.season = eye[0].copy(), eye[1].copy(), eye[2:].copy()

    def run(self, y: np.ndarray, phase: int) -> np.ndarray:
        a, b, g, m = self.a, self.b, self.g, self.m
        seen = np.zeros(m + 3)
        for v in y:
            s = self.season[phase]
            ahead = self.level + self.trend
            if v == v:
                seen[-1] = v
                now = seen
            else:
                now = ahead + s  # a missing value is its own forecast
            level = a * (now - s) + (1 - a) * ahead
            self.trend = b * (level - self.level) + (1 - b) * self.trend
            if m > 1:
                self.season[phase] = g * (now - level) + (1 - g) * s
            self.level = level
            phase = (phase + 1) % m
        return np.vstack([self.level, self.trend, self.season])


def default_block(period: int) -> int:
    """Rows a block, so that its map is small beside its rows."""
    return max(4096, 8 * (period + 2) ** 2)


def smooth_fixed(df: DataFrame, keys, ts: str, col: str, period: int, alpha="alpha", beta="beta", gamma="gamma",
                 block_rows: int | None = None, bucket: str = seq.DEFAULT_BUCKET, initial: DataFrame | None = None) -> DataFrame:
    """``df`` with fitted, level, trend and season for given parameters (numbers, or columns constant in a series).

    A parallel scan: blocks of rows reduce to affine maps of the state, a series' maps (one a block) run over its
    start state in order, and the blocks run their rows from the states so carried.  No task holds a series.
    ``initial`` (keys, state) gives the states before the first rows (level, trend, seasons) instead of the first
    two seasons' means.
    """
    keys = require_keys(keys)
    names = df.columns
    rows = block_rows or default_block(period)
    par = [F.col(p) if isinstance(p, str) else F.lit(float(p)) for p in (alpha, beta, gamma)]
    value = F.nanvl(F.col(col).cast("double"), F.lit(None))
    x = seq.index_rows(df, keys, ts, bucket=bucket).withColumns({**{f"_p{i}": c.cast("double") for i, c in enumerate(par)}, "_y": value})
    x = x.withColumn(seq.BLK, F.floor((F.col(seq.RN) - 1) / rows).cast("long"))
    key_types = _typed(df, keys)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:  # the first two seasons of a series
        y = pdf.sort_values(seq.RN)["_y"].to_numpy(dtype=float)
        s = Smoother(np.array([[0.5, 0.5, 0.5]]), period)
        s.first = y.tolist()
        state = [*s.level, *s.trend, *s.season[0]] if s.start() else None
        return pd.DataFrame([[*pdf[keys].iloc[0], state]], columns=[*keys, "_state"])

    if initial is None:
        start = x.where(F.col(seq.RN) <= 2 * period).select(*keys, seq.RN, "_y").groupBy(*keys).applyInPandas(first, f"{key_types}, _state array<double>")
    else:
        start = initial.select(*[F.col(k).alias(k) for k in keys], F.col("state").alias("_state"))

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:  # one block
        pdf = pdf.sort_values(seq.RN)
        lanes = Lanes(tuple(pdf[["_p0", "_p1", "_p2"]].iloc[0]), period)
        got = lanes.run(pdf["_y"].to_numpy(dtype=float), int(pdf[seq.RN].iloc[0] - 1) % period)
        return pd.DataFrame([[*pdf[keys].iloc[0], pdf[seq.BLK].iloc[0], got.tobytes()]], columns=[*keys, seq.BLK, "_map"])

    slim = x.select(*keys, seq.BLK, seq.RN, "_y", "_p0", "_p1", "_p2")
    maps = slim.groupBy(*keys, seq.BLK).applyInPandas(reduce, f"{key_types}, {seq.BLK} long, _map binary")
    ordered = maps.join(start, keys, "left").repartition(*keys).sortWithinPartitions(*keys, seq.BLK).select(*keys, seq.BLK, "_map", "_state")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for *key, blk, raw, first_state in pdf.itertuples(index=False, name=None):
                if key != now:
                    now, state = key, None if first_state is None else np.asarray(first_state, dtype=float)
                out.append((*key, blk, None if state is None else state.tolist()))
                if state is not None:
                    step = np.frombuffer(raw).reshape(period + 2, period + 3)
                    state = step[:, :-1] @ state + step[:, -1]
            yield pd.DataFrame(out, columns=[*keys, seq.BLK, "_state"])

    carried = ordered.mapInPandas(carry, f"{key_types}, {seq.BLK} long, _state array<double>")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{c} double" for c in OUT])

    def run(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:  # one block and its one state
        pdf = pdf.sort_values(seq.RN)
        state = None if states.empty else states["_state"].iloc[0]
        if state is None:
            return pdf[names].assign(**dict.fromkeys(OUT, np.nan))
        (a, b, g), phase = pdf[["_p0", "_p1", "_p2"]].iloc[0].tolist(), int(pdf[seq.RN].iloc[0] - 1) % period
        level, trend, *season = np.asarray(state, dtype=float).tolist()
        got = []
        for y in pdf["_y"].to_numpy(dtype=float).tolist():
            s = season[phase]
            f = level + trend + s
            if y != y:
                y = f
            was = level
            level = a * (y - s) + (1 - a) * (level + trend)
            trend = b * (level - was) + (1 - b) * trend
            if period > 1:
                season[phase] = g * (y - level) + (1 - g) * s
            got.append((f, level, trend, season[phase]))
            phase = (phase + 1) % period
        return pdf[names].assign(**dict(zip(OUT, np.array(got).T)))

    out = x.groupBy(*keys, seq.BLK).cogroup(carried.groupBy(*keys, seq.BLK)).applyInPandas(run, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in OUT})


OUT = ["fitted", "level", "trend", "season"]


def fitted_components(df: DataFrame, keys, ts: str, col: str, period: int, rounds: int = 0, **kw) -> DataFrame:
    """Fitted, level, trend and season with each series' best parameters (alpha, beta, gamma).

    They come from the grid; with ``rounds`` a search goes on from there, with an estimated initial state.
    """
    keys = require_keys(keys)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    marked = df.join(last, keys).withColumn("_mark", F.when(F.col(ts) == F.col("_last"), 0))
    best = scan_forecasts(marked, keys, ts, col, "_mark", period, 1).select(
        *keys, *[F.get("cell", F.lit(i)).alias(c) for i, c in enumerate(("alpha", "beta", "gamma"))])
    initial = None
    if rounds:
        from .smoothing_fit import optimise
        found = optimise(df, keys, ts, col, period, best, rounds, **kw)
        best, initial = found.select(*keys, "alpha", "beta", "gamma"), found.select(*keys, "state")
    filled = df.join(best, keys, "left")
    for c in ("alpha", "beta", "gamma"):
        filled = filled.withColumn(c, F.coalesce(c, F.lit(0.5)))  # of a series too short to start; its fitted values are NULL
    return smooth_fixed(filled, keys, ts, col, period, initial=initial, **kw)

"""Fitted Holt and Holt-Winters parameters with an estimated initial state.

For given alpha, beta, gamma the one-step errors are affine in the initial state, so their sum of squares is a
quadratic form in it, and the best initial state is a least-squares solution.  A block of rows reduces, for each trial
of the three parameters, to the affine map of its state and the quadratic form of its errors; a series' blocks are
composed in order (one small matrix each), which gives every trial's best state and sum of squares exactly.  No task
holds a series, and one pass serves all series and trials.

Over the three parameters a pattern search runs from a start, usually the best cell of the grid: trials lie one step
away along each axis and diagonal inside the bounds, the best one is the next centre, and the step halves when the
centre stays best.  A round is one Spark pass.  The sum of squares never rises, so it is at most the grid's.

Errors of the first season do not count, as in the grid search; missing values have no error and leave the state to
its own forecast.  Series of fewer than two seasons have no fit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_keys
from ..session import cut_lineage
from . import sequence as seq
from .smoothing import Smoother, _typed, default_block

BOUNDS = (1e-4, 1.0 - 1e-4)
STEP, LEAST_STEP, ROUNDS = 0.05, 1e-3, 10


def around(centre: np.ndarray, step: float, period: int) -> np.ndarray:
    """The centre and the trials around it, inside the bounds."""
    axes = 3 if period > 1 else 2
    moves = [m for m in itertools.product((-1, 0, 1), repeat=axes) if sum(map(abs, m)) in (1, axes)]
    trials = [np.array(centre, dtype=float)]
    for m in moves:
        x = trials[0].copy()
        x[:axes] = np.clip(x[:axes] + step * np.array(m), *BOUNDS)
        trials.append(x)
    return np.unique(np.array(trials), axis=0)


def block_forms(y: np.ndarray, cells: np.ndarray, period: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(maps, forms) of rows ``start`` .. (0-based) of a series for every cell, over the vector (state, 1).

    ``maps`` (cells, m + 3, m + 3) takes the state before the block to the one after; ``forms`` is the sum of
    squares of the errors as a quadratic form of the state before.
    """
    m, c = period, len(cells)
    a, b, g = (cells[:, k, None] for k in range(3))
    eye = np.broadcast_to(np.eye(m + 3), (c, m + 3, m + 3)).copy()
    level, trend, season = eye[:, 0].copy(), eye[:, 1].copy(), eye[:, 2:2 + m].copy()
    one = np.zeros(m + 3)
    one[-1] = 1.0
    forms, errors = np.zeros((c, m + 3, m + 3)), []
    for t, v in enumerate(y, start):
        i = t % m
        s = season[:, i]
        ahead = level + trend
        if v == v:
            now = v * one
            if t >= m:
                errors.append(ahead + s - now)
                if len(errors) == 256:
                    e = np.stack(errors, 1)
                    forms += e.transpose(0, 2, 1) @ e
                    errors = []
        else:
            now = ahead + s
        new = a * (now - s) + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * trend
        if m > 1:
            season[:, i] = g * (now - new) + (1 - g) * s
        level = new
    if errors:
        e = np.stack(errors, 1)
        forms += e.transpose(0, 2, 1) @ e
    maps = np.concatenate([level[:, None], trend[:, None], season, np.broadcast_to(one, (c, 1, m + 3))], axis=1)
    return maps, forms


def best_state(form: np.ndarray, guess: np.ndarray) -> tuple[float, np.ndarray]:
    """(least sum of squares, state) of a quadratic form, the solution nearest to ``guess``."""
    h, q = form[:-1, :-1], form[:-1, -1]
    state = guess - np.linalg.pinv(h, rcond=1e-10, hermitian=True) @ (h @ guess + q)
    z = np.r_[state, 1.0]
    return float(max(z @ form @ z, 0.0)), state


def optimise(df: DataFrame, keys, ts: str, col: str, period: int, start: DataFrame, rounds: int = ROUNDS,
             block_rows: int | None = None, bucket: str = seq.DEFAULT_BUCKET) -> DataFrame:
    """(keys, alpha, beta, gamma, state, sse): the parameters found from ``start`` (keys, alpha, beta, gamma).

    ``state`` is level, trend and the seasons before the first row.  One row a series; a checkpoint a round.
    """
    keys = require_keys(keys)
    m, rows = int(period), block_rows or default_block(period)
    value = F.nanvl(F.col(col).cast("double"), F.lit(None))
    placed = seq.index_rows(df.select(*keys, ts, col), keys, ts, bucket=bucket)
    x = cut_lineage(placed.select(*keys, seq.RN, value.alias("_y"), F.floor((F.col(seq.RN) - 1) / rows).cast("long").alias(seq.BLK)))  # read every round
    types = _typed(df, keys)

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:  # the first two seasons
        s = Smoother(np.array([[0.5, 0.5, 0.5]]), m)
        s.first = pdf.sort_values(seq.RN)["_y"].to_numpy(dtype=float).tolist()
        state = [[*pdf[keys].iloc[0], [*s.level, *s.trend, *s.season[0]]]] if s.start() else []
        return pd.DataFrame(state, columns=[*keys, "_guess"])

    first = cut_lineage(x.where(F.col(seq.RN) <= 2 * m).groupBy(*keys).applyInPandas(guess, f"{types}, _guess array<double>"))
    blocks = cut_lineage(x.groupBy(*keys, seq.BLK).agg(F.count(F.lit(1)).alias("_k")).drop("_k").join(first, keys))  # a row a block

    def reduce(pdf: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:  # one block and its series' centre
        if todo.empty or pdf.empty:
            return pd.DataFrame(columns=[*keys, "_cell", seq.BLK, "_map", "_form", "_guess"])
        pdf = pdf.sort_values(seq.RN)
        centre, step = todo[["alpha", "beta", "gamma"]].iloc[0].to_numpy(dtype=float), float(todo["_step"].iloc[0])
        cells = around(centre, step, m)
        maps, forms = block_forms(pdf["_y"].to_numpy(dtype=float), cells, m, int(pdf[seq.RN].iloc[0]) - 1)
        base = [*pdf[keys].iloc[0]]
        return pd.DataFrame([[*base, c.tolist(), pdf[seq.BLK].iloc[0], a.tobytes(), f.tobytes(), todo["_guess"].iloc[0]] for c, a, f in zip(cells, maps, forms)],
                            columns=[*keys, "_cell", seq.BLK, "_map", "_form", "_guess"])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, so_far, form, near = None, None, None, None

        def done():
            sse, state = best_state(form, np.asarray(near, dtype=float))
            return (*now[0], *now[1], state.tolist(), sse)

        names = [*keys, "alpha", "beta", "gamma", "state", "sse"]
        for pdf in batches:
            out = []
            for *key, cell, blk, raw, f, g in pdf.itertuples(index=False, name=None):
                at = (tuple(key), tuple(cell))
                if at != now:
                    if now is not None:
                        out.append(done())
                    now, so_far, form, near = at, np.eye(m + 3), np.zeros((m + 3, m + 3)), g
                form = form + so_far.T @ np.frombuffer(f).reshape(m + 3, m + 3) @ so_far
                so_far = np.frombuffer(raw).reshape(m + 3, m + 3) @ so_far
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([done()], columns=names)

    at = start.select(*keys, *[F.least(F.greatest(F.col(c).cast("double"), F.lit(BOUNDS[0])), F.lit(BOUNDS[1])).alias(c) for c in ("alpha", "beta", "gamma")]) \
        .withColumn("_step", F.lit(STEP))
    best = F.min_by(F.struct("alpha", "beta", "gamma", "state", "sse"), F.struct("sse", "alpha", "beta", "gamma"))
    same = (F.abs(F.col("_b.alpha") - F.col("alpha")) + F.abs(F.col("_b.beta") - F.col("beta")) + F.abs(F.col("_b.gamma") - F.col("gamma"))) < 1e-12
    for k in range(rounds):
        todo = blocks.join(at.where(F.col("_step") >= LEAST_STEP), keys)
        todo = todo.select(*[F.col(c).alias(c) for c in todo.columns])  # columns of their own beside those of x
        parts = x.groupBy(*keys, seq.BLK).cogroup(todo.groupBy(*keys, seq.BLK)).applyInPandas(
            reduce, f"{types}, _cell array<double>, {seq.BLK} long, _map binary, _form binary, _guess array<double>")
        tried = parts.repartition(*keys).sortWithinPartitions(*keys, "_cell", seq.BLK).mapInPandas(
            compose, f"{types}, alpha double, beta double, gamma double, state array<double>, sse double")
        found = at.join(tried.groupBy(*keys).agg(best.alias("_b")), keys, "left")
        step = F.when(F.col("_b").isNull(), F.col("_step")).when(same, F.col("_step") / 2).otherwise(F.col("_step"))
        kept = [F.coalesce(F.col(f"_b.{c}"), F.col(c)).alias(c) for c in ("alpha", "beta", "gamma")]
        last = [F.coalesce(F.col(f"_b.{c}"), F.col(c) if k else F.lit(None)).alias(c) for c in ("state", "sse")]
        at = cut_lineage(found.select(*keys, *kept, step.alias("_step"), *last))
    return at.drop("_step")

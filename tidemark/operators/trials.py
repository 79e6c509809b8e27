"""Hyper-parameter search by seeded trials with successive halving.

A trial is a draw from a space of categorical, integer and log-uniform ranges.  For the windowed regressions one pass
of sums of products with the largest number of lags serves every trial: fewer lags are a part of the same normal
equations, and a penalty only changes the small solve.  All trials of all series are therefore rows made by one Spark
job, from one small row a series (its sums and its last validation windows).

Successive halving: all trials are scored on the newest few validation origins, the better third on three times as
many, and so on until the last ones have seen all.  The same seed gives the same trials; the cells of a grid can be put
in front of the draws.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_keys
from . import regress as rg


@dataclass(frozen=True)
class Categorical:
    values: tuple

    def draw(self, rng: np.random.Generator):
        return self.values[int(rng.integers(len(self.values)))]


@dataclass(frozen=True)
class Integer:
    """Whole numbers low .. high, both included."""

    low: int
    high: int

    def draw(self, rng: np.random.Generator) -> int:
        return int(rng.integers(self.low, self.high + 1))


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def __post_init__(self):
        if not 0 < self.low <= self.high:
            raise ValueError("a log-uniform range needs 0 < low <= high")

    def draw(self, rng: np.random.Generator) -> float:
        return float(np.exp(rng.uniform(np.log(self.low), np.log(self.high))))


#: Penalty (scaled ridge, or least squares), lags and strength.
SPACE = {"penalty": Categorical(("ridge", "none")), "lags": Integer(1, 10), "alpha": LogUniform(1e-3, 1e3)}


def sample(space: dict, n: int, seed: int = 0, first: Sequence[dict] = ()) -> list[dict]:
    """``n`` trials: those of ``first``, then draws; equal ones are drawn again a few times."""
    rng, out = np.random.default_rng(seed), [dict(t) for t in first][:n]
    seen = {tuple(sorted(t.items())) for t in out}
    for _ in range(20 * n):
        if len(out) == n:
            break
        t = {k: space[k].draw(rng) for k in sorted(space)}
        if tuple(sorted(t.items())) not in seen:
            seen.add(tuple(sorted(t.items())))
            out.append(t)
    return out


def halving(n_trials: int, n_origins: int, factor: int = 3) -> list[tuple[int, int]]:
    """(trials, origins) of the rounds; the last one sees all origins."""
    rounds = max(0, int(np.floor(np.log(max(n_trials, 1)) / np.log(factor) + 1e-9)))
    return [(max(1, n_trials // factor ** k), max(1, -(-n_origins // factor ** (rounds - k)))) for k in range(rounds + 1)]


def search(df: DataFrame, keys, ts: str, value: str, horizon: int = 2, n_trials: int = 10, seed: int = 0, origins: int = 27,
           space: dict | None = None, first: Sequence[dict] = (), **kw) -> DataFrame:
    """(keys, trial, penalty, lags, alpha, origins, mae, best): every trial with the origins it was scored on.

    Validation origins are the last ``origins`` whose targets are known; training targets lie before all of theirs.
    ``mae`` is over those origins and all steps; ``best`` marks the winner among those that saw all (ties: the
    earlier trial).  A series too short for training has NULL errors and no best trial.
    """
    keys, h = require_keys(keys), int(horizon)
    trials = sample(space or SPACE, n_trials, seed, first)
    most = max(t["lags"] for t in trials)
    win = rg.windows(df, keys, ts, value, most, h, **kw)
    held = (F.col("rn") > F.col("n") - h - origins) & (F.col("rn") <= F.col("n") - h)
    sums = rg._moments(win.where(F.col("rn") <= F.col("n") - 2 * h - origins), keys).groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "v")).alias("_e"))
    late = win.where(held & ~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()))
    late = late.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rn", "x", "y")), asc=False).alias("_o"))  # ``origins`` rows at most
    packed = df.select(*keys).distinct().join(sums, keys, "left").join(late, keys, "left").select(
        *keys, *[F.col(f"_e.{f}").alias(f"_{f}") for f in ("i", "j", "v")], F.col("_o.x").alias("_x"), F.col("_o.y").alias("_y"))
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names, p = ["trial", "penalty", "lags", "alpha", "origins", "mae", "best"], 1 + most

    def run(batches):
        for pdf in batches:  # one row a series
            out = []
            for *key, i, j, v, xs, ys in pdf.itertuples(index=False, name=None):
                known = i is not None and xs is not None
                errors = [(None, 0)] * len(trials)
                alive = list(range(len(trials))) if known else []
                if known:
                    m = np.zeros((p, p + h))
                    m[np.asarray(i, int), np.asarray(j, int)] = v
                    xtx, x, y = np.triu(m[:, :p]) + np.triu(m[:, :p], 1).T, np.stack([np.asarray(a, float) for a in xs]), np.stack([np.asarray(a, float) for a in ys])
                    miss = {}
                    for t in alive:
                        k = 1 + trials[t]["lags"]
                        beta = rg.ridge(xtx[:k, :k], m[:k, p:], trials[t]["alpha"] if trials[t]["penalty"] == "ridge" else 0.0)
                        miss[t] = np.abs(x[:, :k] @ beta - y).mean(axis=1)  # newest origin first
                    for n, seen in halving(len(trials), len(x)):
                        alive = sorted(alive, key=lambda t: (errors[t][0] or 0.0, t))[:n]
                        for t in alive:
                            errors[t] = (float(miss[t][:seen].mean()), min(seen, len(x)))
                whole = [t for t in alive if errors[t][1] == len(xs)] if known else []
                best = min(whole, key=lambda t: (errors[t][0], t)) if whole else None
                out += [(*key, t, c["penalty"], c["lags"], c["alpha"], errors[t][1], errors[t][0], t == best) for t, c in enumerate(trials)]
            yield pd.DataFrame(out, columns=[*keys, *names])

    return packed.mapInPandas(run, f"{types}, trial int, penalty string, lags int, alpha double, origins int, mae double, best boolean")

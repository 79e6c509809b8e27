"""Registered queries (Spark builder + DuckDB oracle) and composed jobs."""

from .registry import REGISTRY, oracle_queries, spark_queries  # noqa: F401


def load_all() -> None:
    """Import every query module so the registry is filled."""
    from . import q_align, q_backtest, q_clean, q_jobs, q_model, q_sources, q_windows  # noqa: F401

"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a DataFrame over the driver
tables (or views derived from them); each oracle is the same question in
DuckDB SQL.  Floating columns are rounded to 6 places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # Importing the modules fills the registry.
    from tabscope.plans import q_profile, q_linear, q_rules, q_models, q_robust  # noqa: F401

"""Registry of queries over the driver tables, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# sums run in any order, so a value that lies exactly between two roundings is moved off the tie on both sides
NUDGE = 1.7e-09


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6, dates: str = ""):
    """Register `fn(spark, sf_dir)`; the named double columns are rounded and dates become text on both sides."""
    cols, days = doubles.split(), dates.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            shown = {c: F.round(F.col(c) + F.lit(NUDGE), digits) + F.lit(0.0) for c in cols} | {c: F.col(c).cast("string") for c in days}
            return df.withColumns(shown) if shown else df
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            swaps = ", ".join([f"round({c} + {NUDGE}, {digits}) + 0.0 AS {c}" for c in cols] + [f"CAST({c} AS VARCHAR) AS {c}" for c in days])
            ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if swaps else sql
        return fn
    return wrap

"""Where queries and their SQL are registered.

Doubles are rounded to six digits in both, since sums of floats depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.adapter import Grid, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Callable[[Grid], DataFrame]], Callable[[Grid], DataFrame]]:
    """Registers a function of the grid tables under its own name."""

    def add(f: Callable[[Grid], DataFrame]) -> Callable[[Grid], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = f(Grid(spark, sf_dir))
            return d.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add

"""The query registry behind ``__spark_entry__``: name -> Spark query and name -> DuckDB oracle.

Every query reads the driver's tables (or data Spark derives from them) over whole tables. Doubles
are rounded to 6 dp on both sides so value hashes compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles
from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an optional oracle."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # wide nested projections: skip constraint inference (planning time, see session.py)
            spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
            ship_package(spark)  # pandas UDFs import fundlens in the workers
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return deco


def load_all() -> None:
    """Import every query module (each registers on import)."""
    from . import queries, queries_io, queries_models, queries_prep  # noqa: F401

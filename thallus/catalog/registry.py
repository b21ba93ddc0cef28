"""Registration, and rounding shared by both sides of a comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import with_fixtures
from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def query(name: str, sql: str | None = None, places: int = PLACES, doubles: str = ""):
    """Register ``build(tables)`` under ``name``; ``sql`` is its twin over the fixture names.

    ``doubles`` names the twin's floating-point columns, which are rounded as ours are.
    """

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(Tables(spark, sf_dir)), places)

        QUERIES[name] = run
        if sql is not None:
            twin = with_fixtures(sql)
            if doubles:
                cleaned = ", ".join(f'round("{c}", {places}) + 0e0 AS "{c}"' for c in doubles.split())
                twin = f"SELECT * REPLACE ({cleaned}) FROM ({twin})"
            ORACLES[name] = twin
        return build

    return register


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles rounded, and negative zero as zero, so that two engines can be compared."""
    return df.select(*[
        (F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes
    ])

"""Registered queries: a DataFrame job and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"s": "string", "i": "int", "l": "bigint", "d": "double", "b": "boolean"}
_DUCK = {"s": "VARCHAR", "i": "INTEGER", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}
SCALE = 1_000_000.0


def _spark_col(name: str, kind: str):
    c = F.col(name).cast(_SPARK[kind])
    if kind == "d":
        c = F.floor(F.round(c, 9) * SCALE + 0.5) / SCALE
    return c.alias(name)


def _duck_col(name: str, kind: str) -> str:
    c = f"CAST({name} AS {_DUCK[kind]})"
    if kind == "d":
        c = f"floor(round({c}, 9) * {SCALE:.1f}::DOUBLE + 0.5::DOUBLE) / {SCALE:.1f}::DOUBLE"
    return f"{c} AS {name}"


def register(
    name: str,
    cols: str,
    fn: Callable[[SparkSession, str], DataFrame],
    sql: str | None = None,
) -> None:
    """``cols``: 'name:kind …' with kinds s, i, l, d, b; both sides get these types.

    Doubles are rounded to nine and then to six places on both sides, so that noise
    in the last bits does not decide a tie.
    """
    spec = [c.split(":") for c in cols.split()]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return fn(spark, d).select(*[_spark_col(*c) for c in spec])

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = f"SELECT {', '.join(_duck_col(*c) for c in spec)}\nFROM (\n{sql}\n) result"

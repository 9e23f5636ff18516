"""Runs, registries and defaults: small keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times, the larger `tie`."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(when, tie)).alias("_r")).select(key, "_r.*")


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    return rows.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def merge_defaults(values: DataFrame, defaults: DataFrame, overrides: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Overrides first, then given values, then defaults."""
    named = lambda df, n: df.select(key, F.col(value).alias(n))
    out = named(values, "_v").join(named(defaults, "_d"), key, "full").join(named(overrides, "_o"), key, "full")
    return out.select(key, F.coalesce("_o", "_v", "_d").alias(value))


def flagged(rows: DataFrame, present: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether each key is among those present."""
    return rows.join(present.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def newest_version(rows: DataFrame, name: str, version: str) -> DataFrame:
    """The version that is largest as a number."""
    return rows.groupBy(name).agg(F.max_by(version, F.col(version).try_cast("int")).alias(version))


def first_of(df: DataFrame, candidates: list[str], alias: str) -> DataFrame:
    """The first of several possible columns that the table has and that is not null."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        raise ValueError(f"none of {candidates} is a column")
    return df.withColumn(alias, F.coalesce(*there))


def spread_sample(rows: DataFrame, n: int, x: str, y: str, cells: int, order: str) -> DataFrame:
    """n rows spread over the plane: the first of each cell of a grid, then the second, and so on."""
    span = rows.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    cell = lambda c, lo, hi: F.least(F.lit(cells - 1), F.floor((F.col(c) - F.col(lo)) * cells / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0))))
    placed = rows.crossJoin(F.broadcast(span)).withColumn("_c", F.coalesce(cell(x, "_x0", "_x1"), F.lit(0)) * cells + F.coalesce(cell(y, "_y0", "_y1"), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_c").orderBy(order))
    return placed.withColumn("_n", nth).orderBy("_n", "_c").limit(n).drop("_x0", "_x1", "_y0", "_y1", "_c", "_n")


def best(rows: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The k candidates of the lowest score."""
    return rows.orderBy(score, tie).limit(k)

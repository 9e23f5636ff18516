"""Operators about order: batches, prefixes, boundaries, high-water marks.

Each takes the columns that name a run; within one, `order` is the order of arrival.  A window works on one run at
a time, so runs are what is spread out; a single run of unbounded length belongs into the streaming operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batches(rows: DataFrame, size: int, order: str = "arrival", run: tuple[str, ...] = (), keep_rest: bool = False) -> DataFrame:
    """Every `size` arrivals are a batch (batch_no from 0); the last one goes unless it is full."""
    w = Window.partitionBy(*run).orderBy(order)
    out = rows.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))
    if keep_rest:
        return out
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(*run, "batch_no"))).where(F.col("_n") == size).drop("_n")


def overlapping(batched: DataFrame, width: int, overlap: int, ports: int) -> DataFrame:
    """Groups of `width` batches that share `overlap` with the next group, dealt to ports in turn.

    A batch belongs to every group whose start, a multiple of width - overlap, is at most width - 1 before it."""
    step = width - overlap
    last = F.floor(F.col("batch_no") / step)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("batch_no") - (width - 1)) / step))
    return batched.withColumn("group_no", F.explode(F.sequence(first, last))).withColumn("port", F.pmod("group_no", F.lit(ports)).cast("int"))


def in_order_prefix(packets: DataFrame, number: str = "packet_no", run: tuple[str, ...] = ()) -> DataFrame:
    """Packets up to the first missing number, from 0; of a number that comes twice, the first arrival counts.

    A number is in the prefix if it equals its own rank among the distinct numbers."""
    first = packets.withColumn("_k", F.row_number().over(Window.partitionBy(*run, number).orderBy("arrival"))).where("_k = 1").drop("_k")
    w = Window.partitionBy(*run).orderBy(number)
    return first.withColumn("_rank", F.row_number().over(w) - 1).where(F.col(number) == F.col("_rank")).drop("_rank")


def high_water(rows: DataFrame, value: str, order: str, run: tuple[str, ...] = ()) -> DataFrame:
    """The largest value before each row."""
    w = Window.partitionBy(*run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("seen", F.max(value).over(w))


def scan_split(rows: DataFrame, number: str, order: list[str], run: tuple[str, ...] = ()) -> DataFrame:
    """scan_seq: a number below the one before it begins a new scan.

    Numbers rise within a scan, so the number before is the scan's largest; streams whose batches overtake each other
    need the stateful form, which keeps the largest number itself."""
    w = Window.partitionBy(*run).orderBy(*order)
    restart = F.col(number) < F.lag(number).over(w)
    return rows.withColumn("_new", F.coalesce(restart, F.lit(False)).cast("int")).withColumn("scan_seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def islands(rows: DataFrame, number: str, run: tuple[str, ...] = ()) -> DataFrame:
    """Runs of consecutive numbers: first, last and n of each; one island means that a write is contiguous."""
    w = Window.partitionBy(*run).orderBy(number)
    marked = rows.select(*run, number).distinct().withColumn("_island", F.col(number) - F.row_number().over(w))
    return marked.groupBy(*run, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_island")


def ring(rows: DataFrame, iteration: str, slots: int) -> DataFrame:
    """The newest row of each slot of a ring of `slots` iterations."""
    cols = [c for c in rows.columns]
    return rows.groupBy(F.pmod(iteration, F.lit(slots)).alias("slot")).agg(F.max_by(F.struct(*cols), iteration).alias("_r")).select("slot", "_r.*")


def travel(rows: DataFrame, value: str, order: str, run: tuple[str, ...] = ()) -> DataFrame:
    """First and last value in order, and the sign of the way between."""
    out = rows.groupBy(*run).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return out.withColumn("way", F.signum(F.col("last") - F.col("first")).cast("int"))


def strided(rows: DataFrame, number: str, stride: int) -> DataFrame:
    """Every stride-th frame, with its place in the compact buffer."""
    return rows.where(F.col(number) % stride == 0).withColumn("row", F.floor(F.col(number) / stride).cast("bigint"))


def kept_rows(n: int, stride: int) -> int:
    return (n - 1) // stride + 1


def check_first(rows: DataFrame, number: str, allow_join: bool = False) -> DataFrame:
    """Fails, when it runs, unless the first batch starts at number 0 or joining in mid-scan is allowed."""
    first = rows.agg(F.min(number).alias("first"))
    if allow_join:
        return first
    return first.select(F.when(F.col("first") != 0, F.raise_error(F.concat(F.lit("the first batch starts at frame "), F.col("first").cast("string")))).otherwise(F.col("first")).alias("first"))

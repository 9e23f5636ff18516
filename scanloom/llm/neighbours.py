"""The next row in a global order, without a global sort in one task."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._rt import row_hash, shuffle_partitions


def _longs(xs: list[int]) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")


class Order:
    """Descending doc_id over all rows, held as parts (pid) of a range partition and places (rn) in them.

    The parts' bounds are approximate quantiles of the ids, so parts are even whatever the ids are; an id that fills
    several parts (or the rows without one) is cut further by the texts' hashes.  Bounds and the list of parts in
    use, some for each shuffle partition, are all that the driver holds.  Rows without doc_id come last; rows of one
    doc_id stand in the order of their texts' hashes, and equal rows follow each other, in one part.  After the last
    row comes the first."""

    def __init__(self, docs: DataFrame):
        """docs: doc_id (an integer, which is checked at once) and text."""
        if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
            raise ValueError("the order of rows goes by whole numbers: doc_id must be one")
        self.docs = docs
        self.tasks = 4 * shuffle_partitions(docs.sparkSession)
        parts = 4 * self.tasks
        row = docs.select(
            F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 20 * parts).alias("q"),
            F.count("*").alias("n"),
            F.count("doc_id").alias("with_id"),
        ).first()
        points = Counter(row["q"] or [])
        many = {x: n for x, n in points.items() if n > 1}
        self.bounds = sorted({*points, *(x + 1 for x in many)})
        #: Into how many parts each range of ids is cut by hash, first those without id, then those below all bounds.
        self.cuts = [max(1, round(parts * (row["n"] - row["with_id"]) / max(1, row["n"]))), 1, *(many.get(b, 1) for b in self.bounds)]
        tops = docs.select(self._pid().alias("pid"), "doc_id").groupBy("pid").agg(F.max("doc_id").alias("top"))
        self.tops = [(r["pid"], r["top"]) for r in tops.collect()]
        pids = sorted((p for p, _ in self.tops), reverse=True)
        spark = docs.sparkSession
        follows = list(zip(pids[-1:] + pids[:-1], pids, strict=True))  # (part, the part after it)
        self.follows = spark.createDataFrame(follows, "pid int, _head int")
        self.heads = spark.createDataFrame(self.tops, "pid int, _top long")

    def _range(self) -> Column:
        """0 without an id, else 1 and how many bounds are not above the id, found in two steps: which group of bounds, then which in it."""
        if not self.bounds:
            return F.when(F.col("doc_id").isNull(), 0).otherwise(1)
        group = max(1, int(len(self.bounds) ** 0.5))
        groups = [self.bounds[i : i + group] for i in range(0, len(self.bounds), group)]
        up_to = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
        coarse = up_to(_longs([g[0] for g in groups]))
        fine = up_to(F.get(F.array(*map(_longs, groups)), coarse - 1))
        return F.when(F.col("doc_id").isNull(), 0).when(F.col("doc_id") < self.bounds[0], 1).otherwise(1 + (coarse - 1) * group + fine)

    def _pid(self) -> Column:
        """Parts in the order of ids, and within one range of ids in the order of hashes."""
        most = max(self.cuts)
        part = F.coalesce(self._range(), F.lit(0))  # never null, so no filter sets one use of the shuffled texts apart from another
        if most == 1:
            return part
        high = F.shiftright(row_hash(F.col("text")), 32) + (1 << 31)  # 0 to 2 ** 32 - 1
        return (part * most + F.shiftrightunsigned(high * F.get(_longs(self.cuts), part), 32)).cast("int")

    def rows(self) -> DataFrame:
        """pid, rn, doc_id, text, and following: the next row's text."""
        w = Window.partitionBy("pid").orderBy(F.col("doc_id").desc_nulls_last(), row_hash(F.col("text")).desc())
        rows = self.docs.select(self._pid().alias("pid"), "doc_id", "text").repartition(self.tasks, "pid").withColumn("rn", F.row_number().over(w)).withColumn("_next", F.lead("text").over(w))
        # the first text of each part, for the row that stands before it
        first = (
            self.docs.select(self._pid().alias("pid"), "doc_id", "text")
            .join(F.broadcast(self.heads), "pid")
            .where(F.col("doc_id").eqNullSafe(F.col("_top")))
            .groupBy("pid")
            .agg(F.max_by("text", row_hash(F.col("text"))).alias("_first"))
        )
        ends = F.broadcast(self.follows).join(first.select(F.col("pid").alias("_head"), "_first"), "_head").select("pid", "_first")
        return rows.join(ends, "pid", "left").withColumn("following", F.coalesce("_next", "_first")).drop("_next", "_first")

    def with_next(self, rows: DataFrame, value: str, name: str) -> DataFrame:
        """Adds the value of the next row to a table that has pid and rn; for values much smaller than texts."""
        led = rows.withColumn("_next", F.lead(F.struct(value)).over(Window.partitionBy("pid").orderBy("rn")))
        first = rows.where("rn = 1").select(F.col("pid").alias("_head"), F.struct(value).alias("_first"))
        ends = F.broadcast(self.follows).join(first, "_head").select("pid", "_first")
        return led.join(ends, "pid", "left").withColumn(name, F.coalesce("_next", "_first")[value]).drop("_next", "_first")

"""Mixing groups of documents to token targets by entropy balancing, in DataFrame functions only.

Of all rates between 0 and `most` that give each group its words, those of least relative entropy to 1 are
min(most, exp(lam * x)), x a document's size in means of its group.  lam solves the convex dual, one number a group, by
Newton steps that are aggregates over the table of (group, size) counts.  Rates are then rounded into copies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._rt import Scratch, fresh, ranked, text_or_empty

#: Words of texts.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a class (equal group and size) that are numbered together, about.
TOGETHER = 256


@dataclass(frozen=True)
class MixParams:
    """weights: of the groups in their order, repeating; share: of all words, what the mix takes; most: how often a document
    is taken at most; tolerance: of a group's words against its target, before rounding."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    tolerance: float = 1e-9
    rounds: int = 100

    def __post_init__(self):
        if self.most < 1 or not 0 <= self.share <= self.most:
            raise ValueError("a mix cannot take more than `most` times its documents")


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def _key(group: str) -> Column:
    """A group as a text that is never null, in the order of code points, the null group last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(group).cast("string")), F.lit("1"))


def targets(groups: DataFrame, params: MixParams, scratch: Scratch) -> DataFrame:
    """Adds target to groups (key, n, words): shares by weight, stopped at `most` times a group's words.

    What is stopped leaves more to the others: the level per unit of weight rises until it stops no further group.  Each
    round is one aggregate; the driver holds the level."""
    w = F.get(F.array(*[F.lit(float(x)) for x in params.weights]), ((F.col("rank") - 1) % len(params.weights)).cast("int"))
    groups = scratch.write(ranked(groups, [F.col("key")], scratch).select("key", "n", "words", w.alias("w"), (F.col("words") * params.most).alias("top")), "groups")
    row = groups.agg(F.sum("words").alias("words"), F.sum("w").alias("w")).first()
    total = params.share * (row["words"] or 0)
    level, stopped = total / (row["w"] or 1.0), -1
    while True:
        over = F.col("w") * level > F.col("top")
        row = groups.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("top"))).alias("top"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if row["n"] == stopped or not row["w"]:
            break
        stopped, level = row["n"], (total - (row["top"] or 0)) / row["w"]
    return groups.select("key", "n", "words", F.least(F.col("w") * level, F.col("top").cast("double")).alias("target"))


def _rate(params: MixParams) -> Column:
    """The rate of a class (size) given its group's lam; empty documents keep the rate 1."""
    x = F.col("size") / F.col("mean")
    bent = F.least(F.lit(float(params.most)), F.exp(F.col("lam") * x))
    return F.when(F.col("size") == 0, 1.0).when(F.col("target") >= F.col("words") * params.most, float(params.most)).when(F.col("target") <= 0, 0.0).otherwise(bent)


def balance(classes: DataFrame, groups: DataFrame, params: MixParams, scratch: Scratch) -> DataFrame:
    """Adds lam and mean to groups (key, n, words, target); classes: key, size, n.

    Newton steps on the logarithm of a group's words, all groups at once, between bounds that each step narrows: a step
    that leaves them is halved.  Sums are decimal, so that no order of rows changes them and reruns agree."""
    solvable = (F.col("target") > 0) & (F.col("target") < F.col("words") * params.most)
    empty = F.lit(None).cast("double")
    state = groups.select(
        "key", "n", "words", "target", (F.col("words") / F.col("n")).alias("mean"), F.when(solvable, F.log(F.col("target") / F.col("words"))).alias("lam"), empty.alias("lo"), empty.alias("hi"), (~solvable).alias("done")
    )
    state = scratch.write(state, "balance")
    exact = lambda c: F.sum(c.cast("decimal(38,8)")).cast("double")
    rate = _rate(params)
    for _ in range(params.rounds):
        if state.where("not done").isEmpty():
            break
        joined = classes.select("key", "size", F.col("n").alias("_n")).join(state.where("not done"), "key")
        words = F.col("_n") * F.col("size") * rate
        sums = joined.groupBy("key").agg(exact(words).alias("g"), exact(F.when(rate < params.most, words * F.col("size") / F.col("mean"))).alias("d"))
        under = F.col("g") < F.col("target")
        lo, hi = F.when(under, F.col("lam")).otherwise(F.col("lo")), F.when(under, F.col("hi")).otherwise(F.col("lam"))
        newton = F.when((F.col("g") > 0) & (F.col("d") > 0), F.col("lam") + (F.log("target") - F.log("g")) * F.col("g") / F.col("d"))
        middle = F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), (F.col("_lo") + F.col("_hi")) / 2).when(F.col("_hi").isNull(), F.abs(F.col("_lo")) + 1).otherwise(-F.abs(F.col("_hi")) - 1)
        inside = F.col("_next").isNotNull() & (F.col("_lo").isNull() | (F.col("_next") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_next") < F.col("_hi")))
        met = F.abs(F.col("g") - F.col("target")) <= params.tolerance * F.col("target")
        # a bracket that no double divides is as good as met
        closed = F.col("_lo").isNotNull() & F.col("_hi").isNotNull() & (F.col("_hi") - F.col("_lo") <= 1e-14 * F.greatest(F.abs("_lo"), F.abs("_hi")))
        step = state.where("not done").join(sums, "key").withColumns({"_lo": lo, "_hi": hi, "_next": newton, "_met": met})
        step = step.select("key", "n", "words", "target", "mean", F.when(F.col("_met") | closed, F.col("lam")).when(inside, F.col("_next")).otherwise(middle).alias("lam"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("_met") | closed).alias("done"))
        after = scratch.write(state.where("done").unionByName(step), "balance")
        scratch.drop(state)
        state = after
    return state.drop("lo", "hi", "done")


def rounded(classes: DataFrame, groups: DataFrame, params: MixParams) -> DataFrame:
    """key, size, n, words, target, rate, base, extra: each document of a class gets `base` copies and `extra` of its
    documents one more.

    Extra copies are the steps of the running sum of fractions, by size: that keeps a group's words within its longest
    document of the target.  What is still missing or too much is then made good by documents of ever smaller octaves of
    size, so that about half of the smallest document remains.  A group is a row for each size that it has here, its octaves
    64 at most."""
    rated = classes.join(groups.select("key", "words", "target", "mean", "lam"), "key").withColumn("rate", _rate(params))
    rated = rated.withColumn("base", F.floor("rate")).withColumn("_part", F.col("n") * (F.col("rate") - F.floor("rate")))
    upto = F.sum("_part").over(Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rated = rated.withColumn("_upto", upto).withColumn("extra", F.floor(F.col("_upto") + 0.5) - F.floor(F.col("_upto") - F.col("_part") + 0.5))
    rated = rated.withColumn("extra", F.least(F.greatest(F.col("extra"), F.lit(0).cast("bigint")), F.col("n")))
    more = F.col("n") * (params.most - F.col("base")) - F.col("extra")  # how many copies the class could still give
    rated = rated.withColumn("_more", F.least(more, F.col("n") - F.col("extra"))).withColumn("_less", F.col("extra"))
    octave = F.floor(F.log2(F.col("size")))
    spare = rated.where("size > 0").groupBy("key", octave.alias("o")).agg(F.max(F.struct("_more", "size")).alias("add"), F.max(F.struct("_less", "size")).alias("cut"))
    taken = rated.groupBy("key").agg(F.first("target").alias("target"), F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).alias("taken"))
    lists = spare.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("o", "add", "cut")), asc=False).alias("octaves")).join(taken, "key")

    def step(s: Column, o: Column) -> Column:
        up = s["miss"] >= 0
        size = F.when(up, o["add"]["size"]).otherwise(o["cut"]["size"])
        want = F.round(s["miss"] / size).cast("bigint")
        by = F.greatest(F.least(want, o["add"]["_more"]), -o["cut"]["_less"])
        return F.struct((s["miss"] - by * size).alias("miss"), F.concat(s["moves"], F.array(F.struct(size.alias("size"), by.alias("by")))).alias("moves"))

    start = F.struct((F.col("target") - F.col("taken")).alias("miss"), F.array().cast("array<struct<size: bigint, by: bigint>>").alias("moves"))
    moves = lists.select("key", F.explode(F.aggregate("octaves", start, step)["moves"]).alias("m")).where("m.by != 0").select("key", "m.size", "m.by")
    return rated.join(moves, ["key", "size"], "left").select("key", "size", "n", "words", "target", "rate", "base", (F.col("extra") + F.coalesce("by", F.lit(0))).alias("extra"))


def mix(docs: DataFrame, params: MixParams = MixParams(), scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), rate, copies of every document; copies * size words are
    what the mix takes of it, never more than params.most times.

    Documents of one source and size have one rate; which of them get the extra copy is by a hash of doc_id, so reruns
    agree.  They are numbered in parts of about 256, so no source and no size meets in one task.  Null and blank texts
    have no words: they are taken once.  A source that would need more than `most` times its words gets that.  Rows of one
    doc_id are documents of their own.  No documents: no rows.  Other columns are not read."""
    scratch = scratch or Scratch(docs.sparkSession)
    sized = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("source"), _key(group_col).alias("key"), n_words(text_col).alias("size")), "sizes")
    classes = scratch.write(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "classes")
    groups = classes.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("words"))
    groups = scratch.write(balance(classes, targets(groups, params, scratch), params, scratch), "rates")
    plan = scratch.write(rounded(classes, groups, params), "copies")
    part = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.ceil(F.col("n") / TOGETHER))
    planned = scratch.write(sized.join(plan, ["key", "size"]).withColumn("part", part), "planned")
    # only classes of which some documents get the extra copy are numbered
    counts = planned.where("extra > 0 AND extra < n").groupBy("key", "size", "part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = planned.where("extra > 0 AND extra < n").join(counts.select("key", "size", "part", before.alias("_before")), ["key", "size", "part"])
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    numbered = numbered.withColumn("copies", F.col("base") + F.when(F.col("_before") + place <= F.col("extra"), 1).otherwise(0))
    others = planned.where("NOT (extra > 0 AND extra < n)").withColumn("copies", F.col("base") + F.when(F.col("extra") >= F.col("n"), 1).otherwise(0))
    columns = ["doc_id", "source", "size", F.col("words").alias("source_size"), "target", "rate", "copies"]
    return numbered.select(*columns).unionByName(others.select(*columns))


def repeated(docs: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: each row as often as its copies say, numbered from 1 in the column `copy`."""
    (name,) = fresh(docs.columns, "copy")
    return docs.where(F.col(copies) > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))

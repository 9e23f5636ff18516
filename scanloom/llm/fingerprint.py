"""Document fingerprints by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x09-\x0D\x20]+"


@dataclass(frozen=True)
class FingerprintParams:
    samples: int = 32
    seed: int = 7


def term_counts(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """One row per key and term: n is how often the word occurs.  Terms are runs without white space."""
    w = texts.select(*key, F.explode(F.split(text_col, WORD_BREAK)).alias("term")).where("term != ''")
    return w.select(*key, F.xxhash64("term").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("n"))


def _sample(term: Column, ln_w: Column, k: int, seed: int) -> Column:
    """ln a of the k-th sample's term, kept in the high half of a long above 32 bits that name the drawn (term, level).

    r and c are Gamma(2, 1), minus the logarithm of a product of two uniform numbers, and b is uniform:
    t = floor(ln w / r + b), ln a = ln c - r (t - b + 1).  Three hashes of the term give five uniform numbers."""
    draw = random.Random(seed * 1_000_003 + k)
    h = [F.xxhash64(term.bitwiseXOR(F.lit(draw.getrandbits(63)))) for _ in range(3)]
    high = lambda x: (F.shiftrightunsigned(x, 32).cast("double") + 0.5) * 2.0**-32
    low = lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) * 2.0**-32
    r, c, b = -F.log(high(h[0]) * low(h[0])), -F.log(high(h[1]) * low(h[1])), high(h[2])
    t = F.floor(ln_w / r + b)
    ln_a = F.log(c) - r * (t - b + 1.0)  # between -200 and 10
    return F.shiftleft(((ln_a + 512.0) * 2.0**20).cast("long"), 32).bitwiseOR((h[2] + t).bitwiseAND(F.lit(0xFFFFFFFF)))


def drawn(terms: DataFrame, key: list[str], params: FingerprintParams) -> DataFrame:
    """key and the least sample m0, m1, ... over each key's terms (term, n)."""
    ln_w = F.log(F.col("n").cast("double"))
    return terms.groupBy(*key).agg(*[F.min(_sample(F.col("term"), ln_w, k, params.seed)).alias(f"m{k}") for k in range(params.samples)])


def names(samples: list[Column]) -> Column:
    """The signature: the names (32-bit numbers) of the drawn samples; null if there are none."""
    return F.when(samples[0].isNotNull(), F.array(*[m.bitwiseAND(F.lit(0xFFFFFFFF)) for m in samples]))


def signatures(terms: DataFrame, key: list[str], params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """key and sig: two keys agree in a place with the probability that is the generalised Jaccard likeness
    sum(min) / sum(max) of their term weights `n`."""
    return drawn(terms, key, params).select(*key, names([F.col(f"m{k}") for k in range(params.samples)]).alias("sig"))


def pair_signatures(pairs: DataFrame, key: list[str], params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """key, sig_a and sig_b of two texts that share their beginning: `both` is the words they share, up to a word's
    end; `a` and `b` are the rest of each.  Terms with the same weight in both are sampled once."""
    part = lambda mask, c: F.struct(F.lit(mask).alias("mask"), F.col(c).alias("text"))
    parts = pairs.select(*key, F.explode(F.array(part(3, "both"), part(1, "a"), part(2, "b"))).alias("x")).select(*key, "x.mask", "x.text")
    w = parts.select(*key, "mask", F.explode(F.split("text", WORD_BREAK)).alias("term")).where("term != ''")
    n = w.select(*key, "mask", F.xxhash64("term").alias("term")).groupBy(*key, "term").agg(F.sum(F.col("mask").bitwiseAND(F.lit(1))).alias("na"), F.sum(F.shiftright("mask", 1)).alias("nb"))
    of = lambda mask, c: F.struct(F.lit(mask).alias("mask"), F.col(c).alias("n"))
    split = F.when(F.col("na") == F.col("nb"), F.array(of(3, "na"))).when(F.col("nb") == 0, F.array(of(1, "na"))).when(F.col("na") == 0, F.array(of(2, "nb"))).otherwise(F.array(of(1, "na"), of(2, "nb")))
    terms = n.select(*key, "term", F.explode(split).alias("x")).select(*key, "x.mask", "term", "x.n")
    m = [f"m{k}" for k in range(params.samples)]
    least = lambda bit, c: F.min(F.when(F.col("mask").bitwiseAND(F.lit(bit)) > 0, F.col(c)))
    both = drawn(terms, [*key, "mask"], params).groupBy(*key).agg(*[least(1, c).alias(f"a{c}") for c in m], *[least(2, c).alias(f"b{c}") for c in m])
    return both.select(*key, names([F.col(f"a{c}") for c in m]).alias("sig_a"), names([F.col(f"b{c}") for c in m]).alias("sig_b"))


def as_text(sig: Column) -> Column:
    """Eight hex digits a sample; a text without terms has the empty fingerprint."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal places of two signatures; 1 for two texts without terms, 0 if only one has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(samples)))


def fingerprint(docs: DataFrame, key: list[str], text_col: str = "text", params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """key, sig and fingerprint of each key's text; keys whose text is null, empty or without words are absent.

    Equal texts have equal fingerprints.  Rows that repeat a key add up to one text's terms."""
    sig = signatures(term_counts(docs, key, text_col), key, params)
    return sig.withColumn("fingerprint", as_text(F.col("sig")))

"""Benchmark decontamination: a prefix-filtered join of rare shingles, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rt import Scratch, row_hash, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words, as a Java pattern.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of benchmark shingles goes to all executors only up to this many rows (of 8 to 200 bytes); beyond it, Spark shuffles both sides.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class DecontaminateParams:
    window: int = 13
    shingle: int = 3
    #: A document is contaminated if it has hits and share_inverse * n_hit >= n_words.
    share_inverse: int = 20


def words(text: Column) -> Column:
    """Lower-cases A-Z alone and takes the words."""
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), NOT_WORD), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id and the words of each of its windows: `window` words, or all of them if there are fewer."""
    w = items.select(F.col("item_id"), words(text_or_empty()).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).distinct()


def _token(w: Column, at: Column, k: int) -> Column:
    """The shingle of k words at a place (0-based); past the end the words are null."""
    return F.xxhash64(F.lit(k), *[F.get(w, at + i) for i in range(k)])


def _tokens(w: Column, n: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - k), lambda i: _token(w, i, k))


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontaminateParams = DecontaminateParams(), scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, th (its text's hash), n_words, n_hit (words inside any occurrence of a window of an item),
    n_items, item_ids (array of strings, sorted), contaminated.

    A window holds all its shingles wherever it occurs, so its rarest shingle (by its count in all the
    documents, then by hash) is the one necessary prefix token.  A document's places of such tokens give
    candidates; the token's place within the window and the document's length bound them, and the words
    themselves decide.  Null and empty texts have no words and are clean.  Null item ids are ignored; items
    of the same text are separate items.  Rows that repeat a doc_id count apart unless their texts are
    equal too, and each row stays in the result.  Other columns are not read.  An empty benchmark leaves
    all documents clean.
    """
    k = params.shingle
    scratch = scratch or Scratch(docs.sparkSession)
    base = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", row_hash(F.col("text")).alias("th"), words(F.col("text")).alias("w"))
    by_item = item_windows(benchmark.select("item_id", "text").where("item_id is not null"), params.window)
    wins = by_item.select("win").distinct().select("win", F.xxhash64("win").alias("win_hash"), F.size("win").alias("len"))

    # every shingle of every window, with its place; a window of fewer words than a shingle is one shingle
    kinds = [r[0] for r in wins.select(F.least(F.lit(k), F.col("len")).alias("k")).distinct().collect()]  # at most `shingle` numbers
    of_kind = [wins.where(F.least(F.lit(k), F.col("len")) == j).select("win", "win_hash", "len", F.posexplode(_tokens(F.col("win"), F.col("len"), j)).alias("at", "token")) for j in sorted(kinds)]
    if of_kind:
        shingles = of_kind[0]
        for x in of_kind[1:]:
            shingles = shingles.unionAll(x)
    else:
        shingles = wins.select("win", "win_hash", "len", F.lit(0).alias("at"), F.lit(0).cast("long").alias("token")).where("false")
    vocabulary = shingles.select("token").distinct()
    n_tokens, n_windows = vocabulary.count(), wins.count()

    placed = base.select("doc_id", "th", "w", F.posexplode("w").alias("p", "word"))
    if len(kinds) > 1:
        tokens = placed.select("doc_id", "th", "w", "p", F.explode(F.array(*[_token(F.col("w"), F.col("p"), j) for j in sorted(kinds)])).alias("token"))
    else:
        tokens = placed.select("doc_id", "th", "w", "p", _token(F.col("w"), F.col("p"), (kinds or [k])[0]).alias("token"))

    counts = tokens.select("token").join(_sized(vocabulary, n_tokens), "token").groupBy("token").agg(F.count("*").alias("n"))
    # the rarest shingle of each window; shingles that no document has are the rarest and end the search for their window
    rarest = (
        shingles.join(counts, "token", "left")
        .groupBy("win_hash", "win", "len")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("rare"))
        .where("rare.n > 0")
        .select("win_hash", "win", "len", "rare.token", "rare.at")
    )
    fits = (F.col("p") >= F.col("at")) & (F.col("p") - F.col("at") + F.col("len") <= F.size("w"))
    same_words = F.slice("w", F.col("p") - F.col("at") + 1, F.col("len")) == F.col("win")
    place = ["doc_id", "th", (F.col("p") - F.col("at")).alias("s"), "len", "win_hash", "win"]
    if n_windows <= BROADCAST_ROWS:
        found = tokens.join(F.broadcast(rarest), "token").where(fits).where(same_words).select(*place)
    else:
        # places alone are shuffled by their token; the words come to the candidates that are left, once a document
        at = tokens.select("doc_id", "th", "p", "token").join(rarest.select("token", "win_hash", "len", "at"), "token").where(F.col("p") >= F.col("at"))
        at = at.groupBy("doc_id", "th").agg(F.collect_set(F.struct("p", "at", "len", "win_hash")).alias("places")).select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "places")
        here = base.dropDuplicates(["doc_id", "th"]).join(at, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))).select("doc_id", "th", "w", F.explode("places").alias("x")).select("doc_id", "th", "w", "x.*").where(fits)
        here = here.select("doc_id", "th", "p", "at", "len", "win_hash", F.slice("w", F.col("p") - F.col("at") + 1, F.col("len")).alias("win"))
        found = here.join(wins.select("win_hash", "win"), ["win_hash", "win"], "left_semi").select(*place)
    found = scratch.write(found.distinct(), "hits")
    covered = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(x["s"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], x["s"] + x["len"]).alias("end"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    hits = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "len")).alias("spans"))
    hits = hits.select("doc_id", "th", F.aggregate(F.array_sort("spans"), zero, covered)["n"].alias("n_hit"))
    items = (
        found.select("doc_id", "th", "win_hash", "win")
        .distinct()
        .join(by_item.select("item_id", F.xxhash64("win").alias("win_hash"), "win"), ["win_hash", "win"])
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    per_doc = hits.select("doc_id", "th", "n_hit").join(items.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "item_ids"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
    per_doc = per_doc.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "n_hit", "item_ids")
    sized = base.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    joined = sized.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "th",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit * params.share_inverse >= F.col("n_words"))).alias("contaminated"),
    )

"""Importance resampling towards a target: packed streams of feature buckets are counted by sorting, gains gathered per document."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rt import Scratch, ranked, runs, separators, slices, text_buffers, text_or_empty, word_spans, worker_state

#: Bytes that stand between words: all of ASCII but digits and letters.
BETWEEN = separators((*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))
#: Words of more bytes are hashed one by one, shorter ones together.
LONG = 64


@dataclass(frozen=True)
class ResampleParams:
    """buckets: how many features are told apart; least_words and percent: of the documents with so many words, so many
    hundredths are drawn; seed: of the noise."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7

    def __post_init__(self):
        if not 0 < self.buckets <= 1 << 16:
            raise ValueError("a bucket is a 16-bit number")


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The register of crc32 after the bytes of each span, given what it was before."""
    table = worker_state("crc_table", _crc_table)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state, at, size = before[order], starts[order], size[order]
    whole = int(np.searchsorted(-size, -LONG, side="left"))  # the long ones come first
    for i in range(whole):
        state[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    state_, at_, size_ = state[whole:], at[whole:], size[whole:]
    for k in range(int(size_[0]) if len(size_) else 0):
        m = int(np.searchsorted(-size_, -k, side="left"))
        s = state_[:m]
        state_[:m] = table[(s ^ data[at_[:m] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def bucket_streams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets as uint16 of all features, where those of each text begin and the last ends): the words of each text, and
    each word with the next one."""
    table = worker_state("crc_table", _crc_table)
    capital = (data >= 0x41) & (data <= 0x5A)
    data = np.where(capital, data + 32, data).astype(np.uint8)
    starts, ends, text = word_spans(data, offsets, BETWEEN)
    n = len(starts)
    words = np.bincount(text, minlength=len(offsets) - 1) if n else np.zeros(len(offsets) - 1, np.int64)
    features = np.maximum(2 * words - 1, 0)
    place = np.concatenate(([0], np.cumsum(features)))
    out = np.empty(place[-1], np.uint16)
    if n:
        first = _crc(data, starts, ends, np.full(n, 0xFFFFFFFF, np.uint32))
        own = place[text] + 2 * (np.arange(n) - np.concatenate(([0], np.cumsum(words)))[text])
        out[own] = (~first) % np.uint32(buckets)
        left = np.flatnonzero(text[1:] == text[:-1])
        spaced = table[(first[left] ^ np.uint32(0x20)) & np.uint32(255)] ^ (first[left] >> np.uint32(8))
        out[own[left] + 1] = (~_crc(data, starts[left + 1], ends[left + 1], spaced)) % np.uint32(buckets)
    return out, place


def packed(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids, offsets, stream: a row for about a megabyte of text, with the ids of its documents, where the features of each
    begin in the stream and where the last end, and the stream itself, two bytes a feature."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                stream, place = bucket_streams(*text_buffers(batch.column("text")), buckets)
                ids, n = batch.column("doc_id"), batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, n + 1], pa.int32()), pa.array(place.astype(np.int64))), pa.array([stream.tobytes()], pa.binary())],
                    names=["ids", "offsets", "stream"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"ids array<{kind}>, offsets array<bigint>, stream binary")


def bucket_counts(packs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: each stream sorted and cut into runs, the runs of a task added up, then all tasks'."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("stream"):
                stream = np.sort(np.frombuffer(raw.as_buffer(), np.uint16), kind="stable")
                first, length = runs(stream)
                total[stream[first]] += length
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    rows = packs.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in the target and in the source."""
    b = len(source)
    over, under = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1) * over / ((s + 1) * under))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(packs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight (the floored mean of the gains of a document's features; 0 without any)."""
    kind = packs.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, offsets, raw in zip(batch.column("ids"), batch.column("offsets"), batch.column("stream"), strict=True):
                place = offsets.values.to_numpy()
                n, total = np.diff(place), np.zeros(len(place) - 1, np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    total[some] = np.add.reduceat(gain[np.frombuffer(raw.as_buffer(), np.uint16)], place[some])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_features", "weight"])

    return packs.mapInArrow(run, f"doc_id {kind}, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(), scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank of every document; rank numbers the drawn ones and is null elsewhere.

    Documents draw without replacement by score: weight and Gumbel noise of their doc_id.  Only documents with at least
    `least_words` words take part.  Equal scores go by doc_id (null last), then by weight and features; rows that are equal
    in all of that are drawn one after the other.  A null text has no words, and a null doc_id draws the noise of an empty
    one.  An empty target has no features: its shares are then all equal.  No documents: no rows.  Other columns are not
    read.  A stream is never larger than one text's, or about a megabyte of texts'."""
    scratch = scratch or Scratch(docs.sparkSession)
    packs = scratch.write(packed(docs, params.buckets, id_col, text_col), "streams")
    wanted = bucket_counts(packed(target.select(F.lit(0).alias("doc_id"), target_text_col), params.buckets, "doc_id", target_text_col), params.buckets)
    found = weights(packs, gains(bucket_counts(packs, params.buckets), wanted))
    name = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.write(found.withColumn("n_words", F.floor((F.col("n_features") + 1) / 2)).withColumn("score", F.col("weight") + noise), "scores")
    scratch.drop(packs)
    able = scored.where(F.col("n_words") >= params.least_words)
    n = able.count() * params.percent // 100
    placed = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()], scratch)
    out = placed.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return out.unionByName(scored.where(F.col("n_words") < params.least_words).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the documents that resample() drew, with their rank; a doc_id of several rows keeps all of them, as often
    as it was drawn."""
    taken = found.where("rank IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("rank"))
    return docs.join(taken, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")

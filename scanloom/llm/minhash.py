"""MinHash near-dedup: BagMinHash signatures of word shingles, banding, and exact checks of multiset overlap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _rt
from .line_dedup import cell_levels

_U = np.uint64


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    #: Two texts are near-duplicates if sum(min) / sum(max) of their shingle counts is at least num / den.
    num: int = 4
    den: int = 5
    bands: int = 16
    rows: int = 4
    seed: int = 1
    #: Rounds in which each bucket is held against one of its texts, before what is left is joined.
    rounds: int = 1

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def shingles(batch, params: NearDupParams, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, shingle, count) of each distinct shingle, and the number of texts.  A text of fewer words, but not
    none, is one shingle."""
    data, offsets = _rt.text_buffers(batch.column(text_col))
    s, e, doc = _rt.word_spans(data, offsets, _rt.separators(_rt.ASCII_SPACE))
    texts = len(offsets) - 1
    empty = np.zeros(0, np.int64)
    if not len(s):
        return empty, empty.astype(_U), empty, texts
    words = _rt.spans_hash(data, s, e)
    count = np.bincount(doc, minlength=texts)
    last = np.cumsum(count)
    k = params.shingle
    at = np.arange(len(s))
    fits = at + k <= last[doc]
    fits[(last - count)[(count > 0) & (count < k)]] = True
    start = at[fits]
    h, of = _rt.spans_hash(words, start, np.minimum(start + k, last[doc[start]]), 1), doc[start]
    both = _rt.mix(h + of.astype(_U) * _U(0xD6E8FEB86659FD93))
    order = np.argsort(both)
    first, n = _rt.runs(both[order])
    kept = order[first]
    return of[kept], h[kept], n, texts


def bag_min_hash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, texts: int, params: NearDupParams) -> np.ndarray:
    """Each text's signature: the earliest point in each slot, over the Poisson processes of its weighted shingles.

    A shingle's weights are cut into [0, 1), [1, 2), [2, 4), [4, 8), ...; each piece has a process of its own, of a
    rate as wide as the piece, whose points fall on a slot and on a place in the piece.  A text has the points below
    its weight, so two texts agree in a slot with the probability of their weighted Jaccard likeness.  Points come
    in order of time, and a process ends once it is later than all slots of its text."""
    m = params.slots
    pieces = [(doc, h, count, np.zeros(len(h), np.int64), np.ones(len(h), np.int64))]
    low = 1
    while len(more := np.flatnonzero(count > low)):
        doc, h, count = doc[more], h[more], count[more]
        pieces.append((doc, h, count, np.full(len(h), low), np.full(len(h), low)))
        low *= 2
    doc, h, count, low, width = (np.concatenate(x) for x in zip(*pieces))
    state = _rt.mix(h ^ _rt.mix(low.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(params.seed)))
    time = np.zeros(len(h))
    out = np.full(texts * m, np.inf)
    while len(state):
        state = _rt.mix(state + _U(0xA0761D6478BD642F))
        draw = _rt.mix(state ^ _U(0xE7037ED1A0B428DB))
        time = time - np.log(((state >> _U(11)).astype(float) + 0.5) * 2.0**-53) / width
        slot = (draw >> _U(40)).astype(np.int64) % m
        place = low + (((draw & _U(0xFFFFFFFF)).astype(float) * 2.0**-32) * width).astype(np.int64)
        has = place < count
        np.minimum.at(out, doc[has] * m + slot[has], time[has])
        latest = out.reshape(texts, m).max(axis=1)
        on = time < latest[doc]
        doc, state, time, count, low, width = doc[on], state[on], time[on], count[on], low[on], width[on]
    return out.reshape(texts, m)


def _names(doc: np.ndarray, h: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's multiset of shingles."""
    a, b = np.zeros(texts, _U), np.zeros(texts, _U)
    np.add.at(a, doc, _rt.mix(h + count.astype(_U) * _U(0x8EBC6AF09C88C6E3)))
    np.add.at(b, doc, _rt.mix((h ^ _U(0x589965CC75374CC3)) * _U(5) + count.astype(_U)))
    return a, b


def _signed(docs: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id, th, a and b (names of the multiset), size (shingles) and the hashes of the bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        _rt.drop_large()
        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                doc, h, count, texts = shingles(batch, params)
                a, b = _names(doc, h, count, texts)
                size = np.bincount(doc, count, minlength=texts).astype(np.int64)
                bits = bag_min_hash(doc, h, count, texts, params).view(_U).reshape(texts * params.bands, params.rows)
                band = np.zeros(len(bits), _U)
                for i in range(params.rows):
                    band = _rt.mix(band * _U(3) + bits[:, i])
                band = _rt.mix(band + np.tile(np.arange(params.bands, dtype=_U), texts))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64)), params.bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(size), lists], names=["doc_id", "th", "a", "b", "size", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, th long, a long, b long, size long, bands array<long>")


def _texts(docs: DataFrame, wanted, params: NearDupParams) -> DataFrame:
    """v (names of the multiset) and the text of rows whose key is marked as wanted (a few others may come along)."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            kept = whole.filter(pa.array(_rt.marked(wanted.value, whole.column("k").to_numpy().view(_U))))
            for batch in _rt.slices(kept, "text"):
                a, b = _names(*shingles(batch, params))
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]), batch.column("text")], names=["v", "text"])

    return docs.select(_row_key("doc_id", "th").alias("k"), "text").mapInArrow(run, "v struct<a:long,b:long>, text string")


def _row_key(doc_id: str, th: str) -> Column:
    return F.xxhash64(doc_id, th)


def _texts_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, params: NearDupParams, scratch: _rt.Scratch) -> DataFrame:
    """The texts of all nodes (v, w) of the pairs, written once for both sides."""
    used = pairs.select("v").unionAll(pairs.select("w")).distinct()
    keys = nodes.join(used, "v", "left_semi").select(_row_key("first.doc_id", "first.th").alias("k"))
    wanted = docs.sparkSession.sparkContext.broadcast(_rt.bitmap(keys, "k"))
    return scratch.write(_texts(docs, wanted, params), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, params: NearDupParams) -> DataFrame:
    """The pairs (v, w) whose multisets of shingles overlap enough, counted on the texts."""
    both = pairs.join(texts.select("v", F.col("text").alias("vt")), "v").join(texts.select(F.col("v").alias("w"), F.col("text").alias("wt")), "w")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _rt.slices(whole, "vt"):
                found = []
                for col in ("vt", "wt"):
                    row, h, count, n = shingles(batch, params, col)
                    found.append((_rt.mix(h + row.astype(_U) * _U(0xD6E8FEB86659FD93)), row, count, np.bincount(row, count, minlength=n)))
                (x, row, c, n), (y, _, d, m) = found
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                common = np.bincount(row[i], np.minimum(c[i], d[j]), minlength=len(n))
                yield batch.filter(pa.array(common * (params.num + params.den) >= (n + m) * params.num)).select(["v", "w"])

    return both.select("v", "w", "vt", "wt").mapInArrow(run, "v struct<a:long,b:long>, w struct<a:long,b:long>").distinct()


#: Cells of the counts of shingles that order them, 2 ** CELL_BITS bytes for any input.
CELL_BITS = 22


def _occurrences(batch, params: NearDupParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of each occurrence of each shingle, the first, second, ... being apart, and the texts' sizes."""
    row, h, count, texts = shingles(batch, params)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(row, count), _rt.mix(np.repeat(h, count) + nth.astype(_U) * _U(0xD1342543DE82EF95)), np.bincount(row, count, minlength=texts).astype(np.int64)


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, params: NearDupParams, scratch: _rt.Scratch) -> DataFrame:
    """All pairs (v < w) of the nodes (v, root) of different classes that may match, by an exact prefix filter.

    A node's shingles, each occurrence for itself, are ordered by how many of these nodes have them (by level of the
    count of a cell of hashes, then by hash: one order for all); of two that match, one of the first
    n - ceil(n num / den) + 1 of each is common.  Only those leave a task, and of them none that is found nowhere else, so
    a crowd that shares a part too small for a match makes no pairs."""
    own = texts.join(nodes.select("v"), "v", "left_semi").dropDuplicates(["v"])
    own = scratch.write(own, "open")
    levels = own.sparkSession.sparkContext.broadcast(cell_levels(own.select("text"), lambda batch: _occurrences(batch, params)[1], CELL_BITS))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                of, e, n = _occurrences(batch, params)
                level = levels.value[(e >> _U(64 - CELL_BITS)).astype(np.int64)]
                by = np.lexsort((e, level, of))
                of, e, level = of[by], e[by], level[by]
                pos = np.arange(len(of)) - (np.cumsum(n) - n)[of]
                keep = np.flatnonzero((pos < (n + (-n * params.num) // params.den + 1)[of]) & (level > 0))
                of = of[keep]
                yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(pos[keep].astype(np.int32)), pa.array(e[keep].view(np.int64))], names=["v", "n", "pos", "e"])

    prefix = own.mapInArrow(run, "v struct<a:long,b:long>, n int, pos int, e long")
    prefix = scratch.write(prefix.join(nodes, "v"), "prefixes")
    other = prefix.select("e", F.col("v").alias("w"), F.col("root").alias("wroot"), F.col("n").alias("m"), F.col("pos").alias("wpos"))
    sizes = (F.col("n") * params.den >= F.col("m") * params.num) & (F.col("m") * params.den >= F.col("n") * params.num)
    places = (1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("wpos")) - 1) * (params.num + params.den) >= (F.col("n") + F.col("m")) * params.num
    return prefix.join(other, "e").where((F.col("v") < F.col("w")) & (F.col("root") != F.col("wroot")) & sizes & places).select("v", "w").distinct()


def components(links: DataFrame, scratch: _rt.Scratch) -> DataFrame:
    """v and root, the least node that links lead to, for each node of the links (v, w).

    Each round takes the least label among neighbours and then the label's own label; chains of n links end in
    about log n rounds.  Nothing but the number of changes comes to the driver."""
    both = scratch.write(links.select("v", "w").unionByName(links.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "links")
    labels = scratch.write(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    written = labels
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "root"), "w").groupBy("v").agg(F.min("root").alias("m"))
        low = labels.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        of = low.select(F.col("v").alias("root"), F.col("root").alias("next"))
        new = scratch.write(low.join(of, "root", "left").select("v", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        scratch.drop(written)
        written = new
        if new.where("was != root").limit(1).count() == 0:
            return new.select("v", "root")
        labels = new.select("v", "root")


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(), scratch: _rt.Scratch | None = None) -> DataFrame:
    """doc_id, th, class_doc_id and class_th (the row that stands for the class: least doc_id, null first, then
    text hash), n_links (verified links found at the row's multiset), kept (whether the row is that one).

    Texts with the same multiset of shingles are one node.  Nodes that share a bucket of a band are candidates: in
    each round every bucket is held against the text that shares the most buckets, and texts already in its class
    are left out.  Texts of buckets that the rounds leave with several classes are joined once more by an exact
    prefix filter.  Links are exact: the counts of all shingles are compared.  Classes are the connected components
    of links; a pair of likeness 0.8 shares no bucket in 2 of 10,000 cases, and a class is then kept together by its
    other links, if it has any.

    Null and empty texts, and texts of white space, stand alone.  Rows that repeat doc_id and text share their
    result.  docs: doc_id, th, text."""
    scratch = scratch or _rt.Scratch(docs.sparkSession)
    signed = scratch.write(_signed(docs, params), "signed")
    v = F.struct("a", "b").alias("v")
    nodes = scratch.write(signed.where("size > 0").groupBy(v).agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("bands").alias("bands"), F.first("size").alias("size")), "nodes")
    buckets = nodes.select("v", "size", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    in_full = scratch.write(buckets.join(scratch.write(full, "buckets"), "bucket"), "members")
    weight = scratch.write(in_full.groupBy("v").agg(F.sum("c").alias("weight")), "weights")
    members = in_full.select("bucket", "v", "size").join(weight, "v")
    fits = (F.col("size") * params.den >= F.col("lead.size") * params.num) & (F.col("lead.size") * params.den >= F.col("size") * params.num)

    links = tested = roots = led = None
    for _ in range(params.rounds):
        named = members.withColumn("root", F.col("v")) if roots is None else members.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        # the heaviest text that has not led this bucket yet
        fresh = named if led is None else named.join(led, ["bucket", "v"], "left_anti")
        lead = scratch.write(fresh.groupBy("bucket").agg(F.max(F.struct("weight", "v", "root", "size")).alias("lead")), "leads")
        now = lead.select("bucket", F.col("lead.v").alias("v"))
        led = now if led is None else led.unionByName(now)
        pairs = named.join(lead, "bucket").where((F.col("root") != F.col("lead.root")) & fits).select("v", F.col("lead.v").alias("w")).distinct()
        if tested is not None:
            known = tested.unionByName(tested.select(F.col("w").alias("v"), F.col("v").alias("w")))
            pairs = pairs.join(known, ["v", "w"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        found = scratch.write(_verified(pairs, _texts_of(pairs, nodes, docs, params, scratch), params), "found")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = components(links, scratch)
    # what has not led a bucket, where that is of several classes
    named = members.join(led, ["bucket", "v"], "left_anti").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    still_open = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    rest = scratch.write(named.join(still_open, "bucket", "left_semi").select("v", "root").distinct(), "rest")
    if rest.limit(1).count():
        texts = _texts_of(rest.select("v", F.col("v").alias("w")), nodes, docs, params, scratch)
        pairs = scratch.write(_prefix_pairs(rest, texts, params, scratch), "pairs")
        links = links.unionByName(scratch.write(_verified(pairs, texts, params), "found"))
        roots = components(links, scratch)
    ends = links.select("v").unionByName(links.select(F.col("w").alias("v"))).groupBy("v").agg(F.count("*").alias("n_links"))
    of_node = nodes.select("v", "first").join(roots, "v", "left").join(ends, "v", "left").select("v", "first", F.coalesce("root", "v").alias("root"), "n_links")
    heads = of_node.groupBy("root").agg(F.min("first").alias("head"))
    of_node = of_node.join(heads, "root").select("v", "head", "n_links")
    me = F.struct("doc_id", "th")
    out = signed.select("doc_id", "th", v).join(of_node, "v", "left").withColumn("head", F.coalesce("head", me))
    return out.select("doc_id", "th", F.col("head.doc_id").alias("class_doc_id"), F.col("head.th").alias("class_th"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("head") == me).alias("kept"))


def with_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text: Column = _rt.text_or_empty(text_col)
    return docs.select("doc_id", _rt.row_hash(text).alias("th"), text.alias("text"))


def near_dedup(docs: DataFrame, params: NearDupParams = NearDupParams(), text_col: str = "text", scratch: _rt.Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, but one of each class of near-duplicates."""
    own, inner = scratch or _rt.Scratch(docs.sparkSession), _rt.Scratch(docs.sparkSession)
    classes = near_duplicates(with_keys(docs, text_col), params, inner)
    gone = own.write(classes.where("not kept").select("doc_id", "th").distinct(), "gone")
    inner.release()
    d, t, h = _rt.fresh(docs.columns, "gone_id", "gone_th", "th")
    gone = gone.select(F.col("doc_id").alias(d), F.col("th").alias(t))
    keyed = docs.withColumn(h, _rt.row_hash(_rt.text_or_empty(text_col)))
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left_anti").drop(h)

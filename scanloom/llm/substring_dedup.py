"""Substring dedup by recompression: equal passages get equal symbols, shared symbols reveal long repeats."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rt

_FAR = 1 << 40
_U = np.uint64


@dataclass(frozen=True)
class SubstringParams:
    #: Words of a window; a window's words go if they start anywhere else too.
    window: int = 35
    #: Rounds of recompression; one names runs, then pairs.
    rounds: int = 3


@dataclass
class Symbols:
    """Symbols of all texts in order.  [start, end) are the words that one stands for; [left, right) those that
    decide that it stands there: a symbol is the same wherever these words are."""

    name: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray


def _salt(level: int, what: int) -> np.uint64:
    return _rt.mix(np.array([level * 16 + what + 1], _U))[0]


def _around(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """left of the symbol before and right of the one behind; beyond all words at a text's ends."""
    n = len(s.name)
    before, behind = np.full(n, -_FAR), np.full(n, _FAR)
    same = s.doc[1:] == s.doc[:-1]
    before[1:][same] = s.left[:-1][same]
    behind[:-1][same] = s.right[1:][same]
    return before, behind


def recompress(s: Symbols, level: int) -> Symbols:
    """One round: runs of one symbol get a name, then the pairs of a left and a right symbol.

    Names and sides are hashes of what a symbol is made of, so all tasks agree without a dictionary; a symbol is
    left or right by one bit, hence no two pairs overlap."""
    if not len(s.name):
        return s
    # runs: a run, also of one, depends on its neighbours being different
    starts = np.flatnonzero(np.concatenate(([True], (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1]))))
    ends = np.concatenate((starts[1:], [len(s.name)])) - 1
    before, behind = _around(s)
    name, long = s.name[starts], ends > starts
    name[long] = _rt.mix(name[long] + (ends - starts)[long].astype(_U) * _salt(level, 0))
    s = Symbols(name, s.end[ends], np.minimum(before[starts], s.left[starts]), np.maximum(behind[ends], s.right[ends]), s.doc[starts])
    # pairs: an unpaired left symbol depends on the next one, an unpaired right symbol on the one before
    right_side = _rt.mix(s.name ^ _salt(level, 1)) >> _U(63) == 1
    n = len(s.name)
    opens = np.zeros(n, bool)
    opens[:-1] = ~right_side[:-1] & right_side[1:] & (s.doc[1:] == s.doc[:-1])
    closes = np.zeros(n, bool)
    closes[1:] = opens[:-1]
    before, behind = _around(s)
    left = np.where(right_side & ~closes, np.minimum(before, s.left), s.left)
    right = np.where(~right_side & ~opens, np.maximum(behind, s.right), s.right)
    kept = np.flatnonzero(~closes)
    name, end, left, right, doc = s.name[kept], s.end[kept], left[kept], right[kept], s.doc[kept]
    pair = np.flatnonzero(opens[kept])
    second = kept[pair] + 1
    name[pair] = _rt.mix(name[pair] * _U(3) + _rt.mix(s.name[second]) + _salt(level, 2))
    end[pair] = s.end[second]
    left[pair] = np.minimum(left[pair], s.left[second])
    right[pair] = np.maximum(right[pair], s.right[second])
    return Symbols(name, end, left, right, doc)


def anchors(words: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, params: SubstringParams) -> tuple[np.ndarray, ...]:
    """Groups all windows into runs of neighbours that have the same anchor: (key, region, start, length).

    A window's anchor is a symbol whose deciding words all lie in the window: of the highest level there is,
    the one of the least name, the first of equal ones.  So equal windows have equal anchors at equal places.
    key names the anchor and its deciding words, region all words of the run's windows."""
    n, w = len(words), params.window
    s = Symbols(words, np.arange(1, n + 1), np.arange(n), np.arange(1, n + 1), doc)
    found = []
    for level in range(params.rounds + 1):
        if level:
            s = recompress(s, level)
        fits = np.flatnonzero(s.right - s.left <= w)
        if not len(fits):
            break
        found.append((np.full(len(fits), params.rounds - level, np.int64), s.name[fits], s.left[fits], s.right[fits], s.doc[fits]))
    if not found:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z.astype(_U), z, z
    level, name, left, right, of = (np.concatenate(x) for x in zip(*found))
    del found, s
    # the windows that hold the symbol: a range of starts
    low = np.maximum(right - w, first[of])
    high = np.minimum(left, first[of] + count[of] - w)
    ok = np.flatnonzero(low <= high)
    level, name, left, right, low, high = level[ok], name[ok], left[ok], right[ok], low[ok], high[ok]
    key = level.astype(_U) << _U(60) | name >> _U(4)
    # the best symbol of each start: each range is two blocks of a power of two, and blocks pass down to halves
    power = np.floor(np.log2(high - low + 1)).astype(np.int64)
    none, index = np.uint64(0xFFFFFFFFFFFFFFFF), np.arange(len(key))
    best_key = best = None
    for p in range(int(power.max(initial=0)), -1, -1):
        keys, at = np.full(n, none), np.full(n, len(key))
        here = np.flatnonzero(power == p)
        for place in (low[here], high[here] - (1 << p) + 1):
            np.minimum.at(keys, place, key[here])
        for place in (low[here], high[here] - (1 << p) + 1):
            least = keys[place] == key[here]
            np.minimum.at(at, place[least], index[here][least])
        if best is not None:
            half = 1 << p
            for shift in (0, half):
                a, b = best_key[: n - shift], best[: n - shift]
                c, d = keys[shift:], at[shift:]
                better = (a < c) | ((a == c) & (b < d))
                np.copyto(c, a, where=better)
                np.copyto(d, b, where=better)
        best_key, best = keys, at
    starts, size = _rt.runs(best)
    some = best[starts] < len(key)
    starts, size = starts[some], size[some]
    sym = best[starts]
    full = _rt.mix(_rt.spans_hash(words, left[sym], right[sym], 1) + key[sym])
    return full, _rt.spans_hash(words, starts, starts + size + w - 1, 0), starts, size


def _words(batch, text_col: str):
    data, offsets = _rt.text_buffers(batch.column(text_col))
    s, e, doc = _rt.word_spans(data, offsets, _rt.separators(_rt.ASCII_SPACE))
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    return data, s, e, doc, first, count


def _runs_of(docs: DataFrame, params: SubstringParams) -> DataFrame:
    """key, region, doc_id, th, p (word place of the first window), n (windows)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                data, s, e, doc, first, count = _words(batch, "text")
                key, region, start, size = anchors(_rt.spans_hash(data, s, e), doc, first, count, params)
                if len(key):
                    of = doc[start]
                    take = pa.array(of)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(region.view(np.int64)), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array((start - first[of]).astype(np.int32)), pa.array(size.astype(np.int32))],
                        names=["key", "region", "doc_id", "th", "p", "n"],
                    )

    return docs.mapInArrow(run, f"key long, region long, doc_id {kind}, th long, p int, n int")


def _windows_of(docs_with_runs: DataFrame, params: SubstringParams) -> DataFrame:
    """key, window (hash of the words of each window of the runs), doc_id, th, p."""
    kind = docs_with_runs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                data, s, e, doc, first, count = _words(batch, "text")
                words = _rt.spans_hash(data, s, e)
                lists = batch.column("runs")
                of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                key, p, n = (flat.field(i).to_numpy() for i in range(3))
                key, of, start = np.repeat(key, n), np.repeat(of, n), np.repeat(p.astype(np.int64), n)
                if not len(key):
                    continue
                start += np.arange(len(start)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
                at = start + first[of]
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(_rt.spans_hash(words, at, at + params.window).view(np.int64)), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(start.astype(np.int32))],
                    names=["key", "window", "doc_id", "th", "p"],
                )

    return docs_with_runs.mapInArrow(run, f"key long, window long, doc_id {kind}, th long, p int")


def _cut(docs_with_spans: DataFrame) -> DataFrame:
    kind = docs_with_spans.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                data, s, e, doc, first, count = _words(batch, "text")
                spans = batch.column("spans")
                change = np.zeros(len(s) + 1, np.int64)
                of = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
                flat = spans.flatten()
                if len(flat):
                    np.add.at(change, flat.field(0).to_numpy() + first[of], 1)
                    np.add.at(change, flat.field(1).to_numpy() + first[of], -1)
                gone = np.cumsum(change)[:-1] > 0
                kept = np.flatnonzero(~gone)
                removed = np.bincount(doc[gone], minlength=len(count))
                # bytes of the kept words, each with a space behind it but the last of a text
                size = e[kept] - s[kept] + 1
                ends = np.cumsum(size)
                index = np.repeat(s[kept] - (ends - size), size) + np.arange(int(size.sum()))
                space = ends - 1
                index[space] = 0
                out = data[index] if len(index) else np.zeros(0, np.uint8)
                out[space] = 32
                total = np.bincount(doc[kept], size, minlength=len(count)).astype(np.int64)
                borders = np.cumsum(total)
                drop = borders[total > 0] - 1
                out = np.delete(out, drop)
                offsets = np.concatenate(([0], np.cumsum(np.maximum(total - 1, 0)))).astype(np.int64)
                text = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(removed.astype(np.int64)), text], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs_with_spans.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, params: SubstringParams = SubstringParams(), text_col: str = "text", scratch: _rt.Scratch | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are runs without ASCII white space.  A word goes if it lies in a window of `window` words whose words
    also start anywhere else, in the same document or another, on the input.  Three questions are asked, each of
    what the one before left: which anchors occur twice; which runs of windows occur twice as a whole; and, where
    runs of one anchor differ (at the ends of repeats), which single windows do.  An anchor's name, a run's words
    and a window's words are 64-bit hashes, and two places must agree in the anchor and one of the others.

    Null and empty texts have no words; texts shorter than a window stay whole.  Rows that repeat a doc_id are
    documents of their own, equal rows are repeats of each other.  Other columns are not read.  No rows: no rows.
    """
    scratch = scratch or _rt.Scratch(docs.sparkSession)
    base = docs.select("doc_id", _rt.text_or_empty(text_col).alias("text"))
    base = base.select("doc_id", _rt.row_hash(F.col("text")).alias("th"), "text")
    w = params.window
    every = scratch.write(_runs_of(base, params), "runs")
    # a table of its own, so that the join below reads two plain shuffles and Spark can split a frequent anchor
    twice = scratch.write(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "twice")
    shared = scratch.write(every.join(twice, "key", "left_semi"), "shared")
    regions = scratch.write(shared.groupBy("key", "region").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "p", "n")).alias("one")), "regions")
    # all runs of a whole region that occurs twice
    whole = shared.join(regions.where("c > 1").select("key", "region"), ["key", "region"], "left_semi").select("doc_id", "th", F.col("p").alias("a"), (F.col("p") + F.col("n") + (w - 1)).alias("b"))
    # anchors with a run that has no whole match: one run of each of their regions is taken apart
    mixed = regions.groupBy("key").agg(F.min("c").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1").select("key")
    apart = regions.join(mixed, "key", "left_semi").select("one.doc_id", "one.th", F.struct("key", "one.p", "one.n").alias("run")).groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs"))
    same_row = lambda x: F.col("doc_id").eqNullSafe(F.col(f"{x}_id")) & (F.col("th") == F.col(f"{x}_th"))
    apart = apart.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "runs")
    windows = scratch.write(_windows_of(base.join(apart, same_row("r")).select("doc_id", "th", "text", "runs"), params), "windows")
    again = windows.groupBy("key", "window").agg(F.count("*").alias("c")).where("c > 1").select("key", "window")
    single = windows.join(again, ["key", "window"], "left_semi").select("doc_id", "th", F.col("p").alias("a"), (F.col("p") + w).alias("b"))
    spans = whole.unionByName(single).groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    return _cut(base.join(spans, same_row("s"), "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans")))

"""Line dedup: an exact set-similarity join of lines by their rarest words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rt

_U = np.uint64


@dataclass(frozen=True)
class LineDedupParams:
    """Two lines match if common / union of their word sets is at least num / den."""

    num: int = 4
    den: int = 5
    #: Words that occur more often than this are keyed together with a later word of their line.
    frequent: int = 1 << 15
    #: The counts of words are kept by 2 ** cell_bits cells of their hashes: a byte each is what all workers get.
    cell_bits: int = 24
    #: A set that has more than `most` candidates in a key, as in a crowd of like lines, is held against the `first`
    #: earliest of them, and against all only where these do not decide.
    most: int = 64
    first: int = 4
    #: About as many sets of one pair of frequent words make a part, of which a task holds one.
    split: int = 1 << 15

    def __post_init__(self):
        if not 0 < self.num <= self.den:
            raise ValueError("a likeness is above 0 and 1 at most")

    def needed(self, total):
        """The least overlap of two sets with `total` words together: ceil(total num / (num + den))."""
        return -(-total * self.num // (self.num + self.den))


# ---------------------------------------------------------------- rarity
#: Cells whose counts are added up together.
_RANGE = 1 << 16


def level(count):
    """A count in steps of a quarter of a power of two, from 1 up; 0 for what occurs once, or never."""
    return np.where(count > 1, np.minimum(4 * np.log2(np.maximum(count, 1)) - 2, 255).astype(np.int64), 0)


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64)


def word_levels(docs: DataFrame, params: LineDedupParams) -> np.ndarray:
    """The level of each cell's count over all words of all texts, one byte each."""

    def words(batch):
        data, offsets = _rt.text_buffers(batch.column("text"))
        return _rt.spans_hash(data, *_rt.word_ends(data, offsets))

    return cell_levels(docs.select("text"), words, params.cell_bits)


def cell_levels(texts: DataFrame, hashes, bits: int) -> np.ndarray:
    """The level of each cell's count over the hashes of all texts (hashes: of a batch), one byte each.

    A task adds up its hashes in one array and sends it by ranges of cells, so a word is one number of each task
    however often it occurs; the driver gets the bytes, as many for any input."""
    size = min(_RANGE, 1 << bits)

    def count(batches):
        import pyarrow as pa

        _rt.drop_large()
        total = np.zeros(1 << bits, np.uint32)
        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                at = np.sort(_cells(hashes(batch), bits).astype(np.uint32))
                first, n = _rt.runs(at)
                total[at[first]] += n.astype(np.uint32)
        for part in range((1 << bits) // size):
            own = total[part * size : (part + 1) * size]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], names=["part", "at", "n"]
                )

    def add(batches):
        import pyarrow as pa

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, n in zip(batch.column("part").to_pylist(), batch.column("at"), batch.column("n"), strict=True):
                own = totals.setdefault(part, np.zeros(size, np.uint64))
                own[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint32)
        for part, own in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level(own.astype(float)).astype(np.uint8).tobytes()], pa.binary())], names=["part", "levels"])

    counted = texts.mapInArrow(count, "part int, at binary, n binary").repartition("part").mapInArrow(add, "part int, levels binary")
    out = np.zeros(1 << bits, np.uint8)
    for part, levels in zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True):
        out[part * size : (part + 1) * size] = np.frombuffer(levels, np.uint8)
    return out


# ---------------------------------------------------------------- lines
def _line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines start (a text's last line, if empty, falls together with the next text), and the first line of each text."""
    starts = np.union1d(offsets[:-1], np.flatnonzero(data == 0x0A) + 1)
    return starts, np.searchsorted(starts, offsets[:-1])


def rare_first(line: np.ndarray, h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line from rare to frequent: (line, hash, level), by level and then by hash."""
    by = None
    if len(h) and line[-1] < 1 << 20:  # one number holds line, level and a part of the hash
        key = line.astype(_U) << _U(44)
        key |= levels.astype(_U) << _U(36)
        key |= h & _U((1 << 36) - 1)
        by = np.argsort(key)
        key, ordered = key[by], h[by]
        if ((key[1:] == key[:-1]) & (ordered[1:] != ordered[:-1])).any():
            by = None
    if by is None:
        by = np.lexsort((h, levels, line))
        ordered = h[by]
    line, levels = line[by], levels[by]
    first = np.ones(len(h), bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | (line[1:] != line[:-1])
    return line[first], ordered[first], levels[first]


def least_common(n, params: LineDedupParams):
    """How many words a set of n has in common with any match, at least: those with the smallest."""
    return params.needed(n + -(-n * params.num // params.den))


def prefix(n, params: LineDedupParams):
    """How many of a set's rarest words hold at least one that any match has too; none where only equal sets match."""
    return np.where(n * (params.den - params.num) < params.num, 0, n - least_common(n, params) + 1)


def _prefix_keys(line, h, levels, at, n, params: LineDedupParams):
    """Of each line: how many of its rarest words occur nowhere else; the words of which a match must have one, from
    there on, as indexes; and (index, key, pos) of pairs for the frequent ones among the first `prefix` words.

    If the first common word is frequent, so are all that follow, and the next common word is among the first
    prefix + 1: such a word is keyed together with each later one, which keeps the groups of frequent words small.  Sets
    that may have one word only in common with a match are keyed by single frequent words too."""
    frequent = level(np.array([float(params.frequent)]))[0]
    most = prefix(n, params)
    pos = np.arange(len(h)) - np.repeat(at, n)
    inside = pos < np.repeat(most, n)
    single = np.flatnonzero(inside & (levels > 0) & ((levels <= frequent) | (np.repeat(least_common(n, params), n) < 2)))
    skip = np.bincount(line[inside & (levels == 0)], minlength=len(at))
    hot = np.flatnonzero(inside & (levels > frequent))
    later = np.minimum(most, n - 1)[line[hot]] - pos[hot]  # how many later words up to place `prefix`
    first = np.repeat(hot, later)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
    return skip, single, first, _rt.mix(h[first] * _U(3) + _rt.mix(h[second])), pos[first]


def _lines(docs: DataFrame, levels, params: LineDedupParams) -> DataFrame:
    """A row for each line that has words: doc_id, th, line, n (words), a and b (names of its set), bits (each word
    flips one of 64), skip (words that are nowhere else), keys (of the words that follow in the prefix, in order) and
    pairs (key and place of pairs of frequent words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def lists(of, values, lines):
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(lines + 1)).astype(np.int32)), pa.array(values))

        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                data, offsets = _rt.text_buffers(batch.column("text"))
                s, e = _rt.word_ends(data, offsets)
                if not len(s):
                    continue
                starts, firsts = _line_starts(data, offsets)
                where = np.searchsorted(starts, s, side="right") - 1
                new = np.concatenate(([True], where[1:] != where[:-1]))
                doc = np.searchsorted(offsets, s[new], side="right") - 1
                place = where[new] - firsts[doc]
                h = _rt.spans_hash(data, s, e)
                line, h, lev = rare_first(np.cumsum(new) - 1, h, levels.value[_cells(h, params.cell_bits)])
                at, n = _rt.runs(line)
                mixed = _rt.mix(h + _U(0x51ED270B))
                a, b = np.add.reduceat(mixed, at), np.add.reduceat((mixed ^ mixed >> _U(32)) * _U(0xA24BAED4963EE407), at)
                bits = np.bitwise_xor.reduceat(_U(1) << (mixed & _U(63)), at)
                skip, single, first, key, pos = _prefix_keys(line, h, lev, at, n, params)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take),
                        batch.column("th").take(take),
                        *(pa.array(x.astype(np.int32)) for x in (place, n)),
                        *(pa.array(x.view(np.int64)) for x in (a, b, bits)),
                        pa.array(skip.astype(np.int32)),
                        lists(line[single], h[single].astype(np.uint32).view(np.int32), len(at)),
                        lists(line[first], (key & _U(0xFFFFFFFF00000000) | pos.astype(_U)).view(np.int64), len(at)),
                    ],
                    names=["doc_id", "th", "line", "n", "a", "b", "bits", "skip", "keys", "pairs"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, th long, line int, n int, a long, b long, bits long, skip int, keys array<int>, pairs array<long>")


# ---------------------------------------------------------------- candidates
def _sets(lines: DataFrame) -> DataFrame:
    """a, b, the place of a set's first line (d, t, l), c (lines) and ord, which grows with that place."""
    sets = lines.groupBy("a", "b").agg(F.min(F.struct("doc_id", "th", "line")).alias("first"), F.count("*").alias("c"))
    flat = sets.select("a", "b", F.col("first.doc_id").alias("d"), F.col("first.th").alias("t"), F.col("first.line").alias("l"), "c")
    return flat.orderBy("d", "t", "l").withColumn("ord", F.monotonically_increasing_id())


def _is_first():
    """Whether a line of a set stands at the set's first place; none of its lines has a lower doc_id."""
    same_doc = (F.col("doc_id") <= F.col("d")) | (F.col("doc_id").isNull() & F.col("d").isNull())
    return (F.col("th") == F.col("t")) & (F.col("line") == F.col("l")) & F.coalesce(same_doc, F.lit(False))


def _at_first(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Those rows of a, b, doc_id, th, line and others that are of a set's first line, with ord in place of these."""
    s = sets.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "d", "t", "l", "ord")
    return rows.join(s, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")) & _is_first()).drop("a", "b", "doc_id", "th", "line", "sa", "sb", "d", "t", "l")


_OF_LINE = ("a", "b", "doc_id", "th", "line")


def _key_rows(lines: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """key, bits and pn (the place of the key's word, and n), with cols: for each word, and for each pair of frequent words."""
    pn = lambda pos: F.shiftleft(pos.cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("pn")
    words = lines.select(*cols, "bits", "n", "skip", F.posexplode("keys").alias("i", "key")).select(*cols, "key", "bits", pn(F.col("i") + F.col("skip")))
    pairs = lines.select(*cols, "bits", "n", F.explode("pairs").alias("k"))
    return words, pairs.select(*cols, F.shiftright("k", 32).cast("int").alias("key"), "bits", pn(F.col("k").bitwiseAND(F.lit(0xFFFFFFFF))))


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of hot keys with `unit`, the part of the key they fall into.  Rows that are `wanted` go into the other
    parts too, as guests: they are held against that part's own rows."""
    part = rows.join(hot, "key").withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")))
    if "wanted" not in rows.columns:
        return part.select(*rows.columns, F.col("part").alias("unit"))
    units = F.when(F.col("wanted"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))
    return part.withColumn("unit", F.explode(units)).select(*rows.columns, "unit", (F.col("unit") != F.col("part")).alias("guest"))


#: Groups of up to so many sets are compared together, larger ones in blocks.
BLOCK = 1 << 8
#: About as many rows, and pairs, are looked at together.
_ROWS, _PAIRS = 1 << 17, 1 << 20


class Sieve:
    """Candidates among rows of whole groups, each taken in the order of ord: by size, by the places of the key, and by
    the bits in which two sets differ (no more than the words in which they do)."""

    def __init__(self, columns: dict, keys: tuple[str, ...], params: LineDedupParams):
        """A column `wanted` marks the sets whose candidates are wanted, all of them; without it, all sets' first ones."""
        by = np.lexsort((columns["ord"], *(columns[k] for k in reversed(keys))))
        columns = {c: v[by] for c, v in columns.items()}
        self.ord, self.bits = columns["ord"], columns["bits"].view(_U)
        self.n, self.pos = columns["pn"] & 0xFFFFFFFF, columns["pn"] >> 32
        self.params, self.wanted, self.guest = params, columns.get("wanted"), columns.get("guest")
        self.starts = np.concatenate(([0], np.flatnonzero(_changes(columns, keys)) + 1))
        self.sizes = np.diff(np.append(self.starts, len(self.ord)))

    def _passing(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows i, j that may match; j stands before i."""
        p = self.params
        n, m = self.n[i], self.n[j]
        keep = np.flatnonzero((n * p.den >= m * p.num) & (m * p.den >= n * p.num) & (self.ord[j] < self.ord[i]))
        i, j, n, m = i[keep], j[keep], n[keep], m[keep]
        least = p.needed(n + m)
        keep = np.flatnonzero(np.minimum(n - self.pos[i], m - self.pos[j]) >= least)
        i, j, n, m, least = i[keep], j[keep], n[keep], m[keep], least[keep]
        differ = np.bitwise_count(self.bits[i] ^ self.bits[j]).astype(np.int64)
        keep = (n + m - differ) // 2 >= least
        return i[keep], j[keep]

    def _small(self):
        """(i, j) of all small groups, by i and then by ord of j."""
        of = np.flatnonzero((self.sizes > 1) & (self.sizes <= BLOCK))
        starts, sizes = self.starts[of], self.sizes[of]
        count = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # rows before each in its group
        rows = np.repeat(starts, sizes) + count
        if self.wanted is not None:
            count, rows = count[self.wanted[rows]], rows[self.wanted[rows]]
        total = np.concatenate(([0], np.cumsum(count)))
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS, side="right")) - 1)
            c = count[lo:hi]
            i = np.repeat(rows[lo:hi], c)
            j = np.repeat(rows[lo:hi] - c - (np.cumsum(c) - c), c) + np.arange(len(i))
            if self.guest is not None:
                own = ~self.guest[j]
                i, j = i[own], j[own]
            yield self._passing(i, j)
            lo = hi

    def _large(self):
        """As _small, of the other groups; of a set in a crowd, no more candidates than it takes to see that it is in one."""
        for k in np.flatnonzero(self.sizes > BLOCK):
            group = np.arange(self.starts[k], self.starts[k] + self.sizes[k])
            others = group if self.guest is None else group[~self.guest[group]]
            mine = group if self.wanted is None else group[self.wanted[group]]
            for x in range(0, len(mine), BLOCK):
                rows = mine[x : x + BLOCK]
                before = np.searchsorted(others, rows)  # how many of the others stand before each row
                got, found = np.zeros(len(rows), np.int64), []
                for y in range(0, int(before[-1]), BLOCK):
                    on = np.flatnonzero((before > y) & ((got <= self.params.most) | (self.wanted is not None)))
                    if not len(on):
                        break
                    count = np.minimum(before[on] - y, BLOCK)
                    each = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    i, j = self._passing(np.repeat(rows[on], count), others[each + y])
                    got += np.bincount(np.searchsorted(rows, i), minlength=len(rows))
                    found.append((i, j))
                    if self.wanted is not None and sum(len(f[0]) for f in found) > _PAIRS:
                        yield tuple(map(np.concatenate, zip(*found)))
                        found = []
                if found:
                    i, j = map(np.concatenate, zip(*found))
                    by = np.argsort(i, kind="stable")
                    yield i[by], j[by]

    def pairs(self):
        """(ord, earlier ord, whether there may be more) of the candidates of all sets, or of the wanted ones."""
        for found in (self._small(), self._large()):
            for i, j in found:
                if self.wanted is not None:
                    yield self.ord[i], self.ord[j], np.zeros(len(i), bool)
                    continue
                at, size = _rt.runs(i)
                crowd = np.repeat(size > self.params.most, size)
                keep = ~crowd | (np.arange(len(i)) - np.repeat(at, size) < self.params.first)
                yield self.ord[i[keep]], self.ord[j[keep]], crowd[keep]


def _changes(columns: dict, keys: tuple[str, ...]) -> np.ndarray:
    """Whether a group ends behind each row but the last."""
    out = columns[keys[0]][1:] != columns[keys[0]][:-1]
    for k in keys[1:]:
        out = out | (columns[k][1:] != columns[k][:-1])
    return out


def _whole_groups(batches, keys: tuple[str, ...]):
    """The columns of about _ROWS rows at a time, cut between groups."""
    held, size = [], 0
    for batch in batches:
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        size += batch.num_rows
        if size >= _ROWS:
            both = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            ends = np.flatnonzero(_changes(both, keys))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield {c: v[:cut] for c, v in both.items()}
            held, size = [{c: v[cut:] for c, v in both.items()}], size - cut
    if size:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _pairs(rows: DataFrame, keys: tuple[str, ...], params: LineDedupParams) -> DataFrame:
    """ord, xord, more: of each set the candidates xord of each of its keys, and whether there may be others.

    Where rows have a column `wanted`, all candidates of the sets it marks.  A task holds a group's rows, of 40 bytes."""

    def run(batches):
        import pyarrow as pa

        for columns in _whole_groups(batches, keys):
            for a, xa, more in Sieve(columns, keys, params).pairs():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(xa), pa.array(more)], names=["ord", "xord", "more"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "ord long, xord long, more boolean")


#: Bytes of one row in a blob: key, ord, bits, n and pos, each kind for itself.
_WIDTHS = (("key", np.int32), ("ord", np.int64), ("bits", np.int64), ("n", np.int32), ("pos", np.int32))
_ROW = sum(np.dtype(kind).itemsize for _, kind in _WIDTHS)


def _packed(columns: list[np.ndarray], lo: int, hi: int) -> bytes:
    return b"".join(c[lo:hi].tobytes() for c in columns)


def _unpacked(blobs) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {name: [] for name, _ in _WIDTHS}
    for blob in blobs:
        rows, at = len(blob) // _ROW, 0
        for name, kind in _WIDTHS:
            parts[name].append(np.frombuffer(blob, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
    out = {name: np.concatenate(x) for name, x in parts.items()}
    return {"key": out["key"], "ord": out["ord"], "bits": out["bits"], "pn": out["pos"].astype(np.int64) << 32 | out["n"]}


def _word_pairs(at_first: DataFrame, params: LineDedupParams) -> DataFrame:
    """As _pairs, for the keys of words: a range of keys travels as one row of a task, for all sets it has read."""
    spark = at_first.sparkSession
    ranges = 4 * _rt.shuffle_partitions(spark)

    def pack(batches):
        import pyarrow as pa

        borders = (np.arange(ranges + 1, dtype=np.uint64) << _U(32)) // _U(ranges)

        def out(held):
            at, count = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            key, ord_, bits, n, skip = (np.concatenate([h[k] for h in held]) for k in range(2, 7))
            of = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count) + skip[of]
            by = np.argsort(key.view(np.uint32))
            of = of[by]
            columns = [key[by], ord_[of], bits[of], n[of].astype(np.int32), pos[by].astype(np.int32)]
            cuts = np.searchsorted(columns[0].view(np.uint32), borders)
            own = np.flatnonzero(np.diff(cuts))
            blobs = [_packed(columns, int(cuts[r]), int(cuts[r + 1])) for r in own]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(blobs, pa.binary())], names=["range", "blob"])

        held, size = [], 0
        for batch in batches:
            lists = batch.column("keys")
            offsets = lists.offsets.to_numpy()
            number = lambda c: batch.column(c).to_numpy()
            held.append((offsets[:-1], np.diff(offsets), lists.flatten().to_numpy(), number("ord"), number("bits"), number("n"), number("skip")))
            size += len(held[-1][2])
            if size > 1 << 19:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    def compare(batches):
        import pyarrow as pa

        def whole_ranges():
            held, size, last = [], 0, None
            for batch in batches:
                for r, blob in zip(batch.column("range").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                    if r != last and size >= _ROWS:
                        yield _unpacked(held)
                        held, size = [], 0
                    held.append(blob)
                    size, last = size + len(blob) // _ROW, r
            if size:
                yield _unpacked(held)

        for columns in whole_ranges():
            for a, xa, more in Sieve(columns, ("key",), params).pairs():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(xa), pa.array(more)], names=["ord", "xord", "more"])

    packed = at_first.select("ord", "bits", "n", "skip", "keys").mapInArrow(pack, "range int, blob binary")
    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(compare, "ord long, xord long, more boolean")


def _distinct(found: DataFrame) -> DataFrame:
    return found.groupBy("ord", "xord").agg(F.max("more").alias("more"))


def _compared(pairs: DataFrame, hot: DataFrame | None, params: LineDedupParams) -> DataFrame:
    """Candidates among the rows of pairs of frequent words; sets of a hot pair are held against those of their part only."""
    if hot is None:
        return _pairs(pairs, ("key",), params)
    return _pairs(pairs.join(hot, "key", "left_anti"), ("key",), params).unionByName(_pairs(_dealt(pairs, hot), ("key", "unit"), params))


#: A table of keys goes to all executors only up to this many rows, of 4 bytes; beyond it, Spark shuffles both sides.
BROADCAST_KEYS = 200_000


def _all_candidates(lines: DataFrame, sets: DataFrame, wanted: DataFrame, paired: bool, hot: DataFrame | None, params: LineDedupParams, scratch: _rt.Scratch) -> DataFrame:
    """All candidates of the wanted sets (ord): only rows of their keys are moved."""
    own = scratch.write(sets.join(wanted, "ord"), "wanted")
    words, pairs = _key_rows(_at_first(lines, own))
    keys = scratch.write(words.select("key").unionAll(pairs.select("key")).distinct(), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    marks = own.select("ord", F.lit(True).alias("wanted"))

    def of(rows):
        rows = _at_first(rows.join(keys, "key", "left_semi"), sets)
        return rows.join(marks, "ord", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))

    words, pairs = _key_rows(lines, *_OF_LINE)
    found = _pairs(of(words), ("key",), params)
    return _distinct(found.unionByName(_compared(of(pairs), hot, params)) if paired else found)


# ---------------------------------------------------------------- verification
def _line_key(doc_id: str, th: str, line: str):
    return F.xxhash64(doc_id, th).bitwiseXOR(F.shiftleft(F.col(line).cast("long"), 64 - _rt.BITMAP_BITS))


def _line_texts(docs: DataFrame, wanted) -> DataFrame:
    """doc_id, th, line and text of the lines that are marked (a few others may come along)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                data, offsets = _rt.text_buffers(batch.column("text"))
                starts, firsts = _line_starts(data, offsets)
                doc = np.searchsorted(offsets, starts, side="right") - 1
                inside = (starts < len(data)) & (doc < len(firsts))
                starts, doc, at = starts[inside], doc[inside], np.flatnonzero(inside)
                place = at - firsts[doc]
                row = batch.column("k").to_numpy().view(_U)[doc]
                own = np.flatnonzero(_rt.marked(wanted.value, row ^ place.astype(_U) << _U(64 - _rt.BITMAP_BITS)))
                if not len(own):
                    continue
                ends = np.append(starts[1:], len(data))[own]
                size = ends - starts[own]
                text = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                borders = np.concatenate(([0], np.cumsum(size)))
                lines = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(borders.tobytes()), pa.py_buffer(data[text].tobytes())).cast(pa.string())
                take = pa.array(doc[own])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(place[own].astype(np.int32)), lines], names=["doc_id", "th", "line", "text"])

    return docs.select(F.xxhash64("doc_id", "th").alias("k"), "doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, line int, text string")


def _matching(pairs: DataFrame, sets: DataFrame, docs: DataFrame, params: LineDedupParams, scratch: _rt.Scratch) -> DataFrame:
    """ord of the sets of which a pair (ord, xord) matches: decided on the words of both lines, and for the earliest
    candidate of each set before the others."""
    used = pairs.select("ord").unionAll(pairs.select(F.col("xord").alias("ord"))).distinct()
    used = scratch.write(sets.join(used, "ord").select("ord", "d", "t", "l"), "used")
    wanted = docs.sparkSession.sparkContext.broadcast(_rt.bitmap(used.select(_line_key("d", "t", "l").alias("k")), "k"))
    # text hash and line deal the rows out; those of repeated documents are one
    here = (F.col("th") == F.col("t")) & (F.col("line") == F.col("l"))
    texts = _line_texts(docs, wanted).join(used, here).where(F.col("doc_id").eqNullSafe(F.col("d"))).groupBy("th", "line", "ord").agg(F.first("text").alias("text"))
    texts = scratch.write(texts.select("ord", "text"), "texts")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = ([set(t.split()) for t in unique.to_pylist()] for unique in (batch.column(c).cast(pa.binary()).unique() for c in ("text", "xtext")))
            i, j = (batch.column(c).dictionary_encode().indices.to_pylist() for c in ("text", "xtext"))  # between ASCII white space
            keep = [len(x[a] & y[b]) * (params.num + params.den) >= (len(x[a]) + len(y[b])) * params.num for a, b in zip(i, j, strict=True)]
            yield batch.select(["ord"]).filter(pa.array(keep, pa.bool_()))

    def decided(pairs):
        both = pairs.join(texts, "ord").join(texts.select(F.col("ord").alias("xord"), F.col("text").alias("xtext")), "xord").select("ord", "text", "xtext")
        return scratch.write(both.mapInArrow(run, "ord long").distinct(), "matching")

    earliest = pairs.groupBy("ord").agg(F.min("xord").alias("xord"))
    found = decided(earliest)
    left = pairs.select("ord", "xord").join(found, "ord", "left_anti").join(earliest.select("ord", F.col("xord").alias("earliest")), "ord").where("xord != earliest")
    found = found.unionByName(decided(left.select("ord", "xord")))
    scratch.drop(used, texts)
    return found


def find_duplicate_lines(docs: DataFrame, params: LineDedupParams = LineDedupParams(), scratch: _rt.Scratch | None = None) -> DataFrame:
    """doc_id, th, line of each line that an earlier line matches.  docs: doc_id, th, text.

    Lines of the same words are one set, compared once.  Sets are named by two 64-bit hashes; candidates come from
    the keys of a set's rarest words, and the words themselves decide."""
    spark = docs.sparkSession
    scratch = scratch or _rt.Scratch(spark)
    levels = spark.sparkContext.broadcast(word_levels(docs, params))
    lines = scratch.write(_lines(docs, levels, params), "lines")
    sets = scratch.write(_sets(lines), "sets")
    paired, hot = lines.where(F.size("pairs") > 0).limit(1).count() > 0, None
    if paired:
        counted = lines.select(F.explode("pairs").alias("k")).groupBy(F.shiftright("k", 32).cast("int").alias("key")).count()
        hot = scratch.write(counted.where(F.col("count") > params.split).select("key", F.ceil(F.col("count") / params.split).cast("long").alias("parts")), "hot")
        hot = hot if hot.limit(1).count() else None

    at_first = _at_first(lines, sets)
    of_pairs = _key_rows(_at_first(lines.where(F.size("pairs") > 0), sets), "ord")[1]
    found = _word_pairs(at_first, params)
    pairs = scratch.write(_distinct(found.unionByName(_compared(of_pairs, hot, params)) if paired else found), "pairs")
    gone = _matching(pairs, sets, docs, params, scratch)
    # sets with more candidates, or with candidates in other parts of a key, where those so far did not decide
    more = pairs.where("more").select("ord")
    if hot is not None:
        more = more.unionByName(of_pairs.join(hot, "key", "left_semi").select("ord"))
    still_open = scratch.write(more.distinct().join(gone, "ord", "left_anti"), "open")
    if still_open.limit(1).count():
        rest = scratch.write(_all_candidates(lines, sets, still_open, paired, hot, params, scratch).join(pairs, ["ord", "xord"], "left_anti"), "pairs")
        gone = gone.unionByName(_matching(rest, sets, docs, params, scratch))
    # the first lines of the sets that go, and all later lines of any set
    heads = sets.join(gone, "ord").select(F.col("d").alias("doc_id"), F.col("t").alias("th"), F.col("l").alias("line"))
    again = sets.where("c > 1").select("a", "b", "d", "t", "l")
    later = lines.select("doc_id", "th", "line", "a", "b").join(again, ["a", "b"]).where(~_is_first())
    return heads.unionByName(later.select("doc_id", "th", "line"))


def line_dedup(docs: DataFrame, params: LineDedupParams = LineDedupParams(), text_col: str = "text", scratch: _rt.Scratch | None = None) -> DataFrame:
    """All columns of docs with the text freed of removed lines, and n_lines, n_removed, removed (their numbers, from 0).

    A line is what stands between line feeds; its words are runs without ASCII white space.  It goes if the set of
    its words has a Jaccard likeness of at least 4 / 5 with that of any earlier line, kept or not, in the order of
    doc_id (of any type; null first), the text's hash and the line's number.  Lines without words stay.  A null text
    stays null with no lines.  Rows that repeat doc_id and text are one document here: each loses the same lines,
    which are the ones that repeat an earlier place.  Columns named like the new ones are replaced; no rows: no rows."""
    own = scratch or _rt.Scratch(docs.sparkSession)
    new = ("n_lines", "n_removed", "removed")
    kept = [c for c in docs.columns if c.lower() not in new]
    base = docs.select("doc_id", _rt.text_or_empty(text_col).alias("text"))
    base = base.select("doc_id", _rt.row_hash(F.col("text")).alias("th"), "text")
    inner = _rt.Scratch(docs.sparkSession)
    gone = find_duplicate_lines(base, params, inner).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    gone = own.write(gone, "removed")
    inner.release()
    d, t, g, h = _rt.fresh(docs.columns, "gone_id", "gone_th", "gone", "th")
    gone = gone.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("gone").alias(g))
    rows = docs.select(*[f"`{c}`" for c in kept]).withColumn(h, _rt.row_hash(_rt.text_or_empty(text_col)))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    lines = F.split(F.col(text_col), "\n")
    # the lines are bound once, as the one element of an array
    stay = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(g)), lambda i: F.get(ls, i))
    left = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(F.get(F.transform(F.array(lines), lambda ls: F.array_join(stay(ls), "\n")), F.lit(0)))
    removed = F.coalesce(F.col(g), F.array().cast("array<int>"))
    return joined.select(
        *[left.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed"),
    )

"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _rt

UNDETERMINED = "und"
#: Bytes of text looked at together; their n-grams take about 150 times as much.
SLICE_BYTES = 1 << 18
#: Bits of a sign in an n-gram's code: 0 where there is none, 1 for a gap, 2 + the code point for a letter.
SIGN_BITS = 21


@dataclass(frozen=True)
class LangIdParams:
    #: n-grams in a profile, and the distance of one that the other profile lacks.
    top: int = 300
    #: Signs in an n-gram: its code of 21 bits a sign is a long, so 3 at most.
    longest: int = 3

    def __post_init__(self):
        if not 1 <= self.longest <= 63 // SIGN_BITS:
            raise ValueError(f"n-grams have 1 to {63 // SIGN_BITS} signs")


def _letters() -> np.ndarray:
    """The sign of each code point: its lower-case letter's (of several letters, the first), or a gap."""
    out = np.ones(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = 2 + ord(x.lower()[0])
    return out


def gram_keys(column, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of an Arrow column's n-grams, by text and gram.  A run of other signs is one gap;
    n-grams may begin or end with a gap and have none inside.  A gram's code holds its signs, the last one lowest."""
    data, offsets = _rt.text_buffers(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    firsts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    sign = _rt.worker_state("letters", _letters)[points]
    empty = np.zeros(0, np.int64)
    if not len(sign):
        return empty, empty, empty
    # keep letters, and of each run of gaps the first; every text also starts and ends with a gap
    keep = sign > 1
    keep[1:] |= (sign[1:] == 1) & (sign[:-1] > 1) & (doc[1:] == doc[:-1])
    sign, doc = sign[keep], doc[keep]
    if not len(sign):
        return empty, empty, empty
    edge = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    around = np.concatenate(([0], edge, edge, [len(sign)]))
    doc, sign = np.insert(doc, around, np.concatenate((doc[[0]], doc[edge - 1], doc[edge], doc[[-1]]))), np.insert(sign, around, 1)
    # for sorting, a sign is its place among those that occur here
    known, place = np.unique(sign, return_inverse=True)
    place += 1
    bits = int(len(known)).bit_length()
    # no n-gram has two gaps in a row, nor letters of two texts
    code, texts, codes = place, [doc[sign > 1]], [place[sign > 1]]
    for size in range(2, longest + 1):
        code = code[:-1] << bits | place[size - 1 :]
        ends = len(code)
        inner = np.ones(ends, bool)
        for k in range(1, size - 1):
            inner &= sign[k : k + ends] > 1
        if size == 2:
            inner &= (sign[:ends] > 1) | (sign[1 : 1 + ends] > 1)
        inner &= doc[:ends] == doc[size - 1 :]
        texts.append(doc[:ends][inner])
        codes.append(code[inner])
    doc, code = np.concatenate(texts), np.concatenate(codes)
    if int(doc[-1]).bit_length() + longest * bits < 63:
        keys, count = np.unique(doc << longest * bits | code, return_counts=True)
        doc, code = keys >> longest * bits, keys & ((1 << longest * bits) - 1)
    else:
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))))
        doc, code, count = doc[at], code[at], np.diff(np.append(at, len(doc)))
    known = np.concatenate(([0], known))
    gram = np.zeros(len(code), np.int64)
    for k in range(longest - 1, -1, -1):
        gram = gram << SIGN_BITS | known[code >> k * bits & ((1 << bits) - 1)]
    return doc, gram, count


def gram_counts(docs: DataFrame, params: LangIdParams) -> DataFrame:
    """lang, gram, n over all rows of docs (lang, text)."""
    longest = params.longest

    def run(batches):
        import pyarrow as pa

        _rt.drop_large()
        held: dict[str, list] = {}

        def merged(parts):
            gram = np.concatenate([g for g, _ in parts])
            order = np.argsort(gram, kind="stable")
            at, _ = _rt.runs(gram[order])
            return gram[order][at], np.add.reduceat(np.concatenate([c for _, c in parts])[order], at)

        for whole in batches:
            for batch in _rt.slices(whole, "text", SLICE_BYTES):
                names = batch.column("lang").to_pylist()
                doc, gram, count = gram_keys(batch.column("text"), longest)
                index = {name: i for i, name in enumerate(dict.fromkeys(names))}
                of = np.array([index[x] for x in names], np.int64)[doc] if len(doc) else doc
                for name, i in index.items():
                    here = of == i
                    if here.any():
                        parts = held.setdefault(name, [])
                        parts.append((gram[here], count[here]))
                        if len(parts) > 8:
                            held[name] = [merged(parts)]
        for name, parts in held.items():
            gram, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return docs.select("lang", _rt.text_or_empty().alias("text")).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, params: LangIdParams = LangIdParams()) -> dict[str, list[int]]:
    """Each language's most frequent n-grams, from the most frequent on (of equal counts, the lower code first).

    docs: text and lang; rows without a lang are ignored.  The result holds `top` numbers a language."""
    counts = gram_counts(docs.where("lang is not null"), params)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= params.top)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], params: LangIdParams):
        self.names, self.params = sorted(profiles), params
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, how near it is (1 for the profile itself, 0 for nothing in common), and whether it has letters."""
        n, top = len(column), self.params.top
        doc, gram, count = gram_keys(column, self.params.longest)
        order = np.argsort(doc << 32 | ((1 << 31) - np.minimum(count, (1 << 31) - 1)), kind="stable")  # ties: the lower code first
        doc, gram = doc[order], gram[order]
        at, _ = _rt.runs(doc)
        first = np.zeros(n, np.int64)
        first[doc[at]] = at
        rank = np.arange(len(doc)) - first[doc]
        kept = rank < top
        doc, gram, rank = doc[kept], gram[kept], rank[kept]
        size = np.bincount(doc, minlength=n)
        if not self.names:
            return [UNDETERMINED] * n, np.zeros(n), size > 0
        place = np.searchsorted(self.grams, gram)
        place[place < len(self.grams)] = np.where(self.grams[np.minimum(place, len(self.grams) - 1)] == gram, place, len(self.grams))[place < len(self.grams)]
        far = np.empty((len(self.names), n))
        for i in range(len(self.names)):
            theirs = self.ranks[i, place]
            far[i] = np.bincount(doc, np.where(theirs < 0, top, np.abs(theirs - rank)), minlength=n)
        best = far.argmin(axis=0)  # of equal distances, the first name
        score = 1 - far[best, np.arange(n)] / np.maximum(1, size * top)
        known = size > 0
        return [self.names[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, score, 0.0), known


def identify(docs: DataFrame, profiles: dict[str, list[int]], params: LangIdParams = LangIdParams(), text_col: str = "text", letters_col: str | None = None) -> DataFrame:
    """All columns of docs, with lang_pred and score (0 to 1); columns of these names are replaced.

    The nearest profile by the out-of-place distance of the text's own most frequent n-grams wins.  A text that
    is null or has no letter is `und` with score 0, as is any text if there is no profile.  Other columns, null
    ids and repeated rows pass through; nothing is shuffled.  If letters_col names a column, it says whether the text
    has letters, which lang_pred does not where there is no profile."""
    import pyspark.sql.types as T

    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", letters_col)]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(letters_col, T.BooleanType())] if letters_col else [])])
    (given,) = _rt.fresh(names, "given_text")
    source = docs.select(*[f"`{n}`" for n in names], _rt.text_or_empty(text_col).alias(given))

    def run(batches):
        import pyarrow as pa

        _rt.drop_large()
        model = Profiles(profiles, params)
        for whole in batches:
            for batch in _rt.slices(whole, given, SLICE_BYTES):
                for at in range(0, batch.num_rows, 1 << 15):
                    part = batch.slice(at, 1 << 15)
                    lang, score, letters = model.predict(part.column(given))
                    found = [pa.array(lang, pa.string()), pa.array(score), *([pa.array(letters)] if letters_col else [])]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *found], names=schema.names)

    return source.mapInArrow(run, schema)

"""BPE encoding by a prefix-sharing trie traversal, and decoding."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from . import _rt

END = "</w>"
#: Words whose encoding a worker keeps between batches, in an older and a newer half (results do not depend on it).
CACHE_WORDS = 300_000
#: Bytes of text whose new words are encoded together: the more, the more prefixes they share.
SLICE_BYTES = 2 << 20
#: Pairs of tokens of which a worker remembers whether they are stable.
CACHE_PAIRS = 300_000

_SPACE = r"\t-\r \x85\xa0  -     　"
_LATIN = r"a-zA-ZÀ-ÖØ-öø-ɏ"
#: Letters and numbers of the regex module that Unicode 16, the tables of the tokenizers library, does not have; they count as other signs.
_NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a
11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda
18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de
1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
#: Lower cases that this Python's tables do not have yet.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Splitter:
    """Normalises a text and splits it into words as the vocabulary file asks: composed form, lower case one
    character at a time, and runs of letters, single digits or runs of other signs."""

    def __init__(self, specials: list[str]):
        self.odd = re.compile(rf"[^\x00-\x7f{_LATIN[6:]}]")  # beyond these, the full properties are looked up
        self.plain = re.compile(rf"{_TAILS}|[{_LATIN}]+|[0-9]|[^{_SPACE}{_LATIN}0-9]+")
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None

    @cached_property
    def full(self):
        """By Unicode properties."""
        import regex

        spans = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in _NEWER.split())
        letter, number = rf"[\p{{L}}--[{spans}]]", rf"[\p{{N}}--[{spans}]]"
        return regex.compile(rf"{_TAILS}|{letter}+|{number}|[^{_SPACE}{letter}{number}]+", regex.V1)

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return self.full.findall(text.translate(_LOWER)) if self.odd.search(text) else self.plain.findall(text)

    def parts(self, text: str):
        """(is special, part) in order; special strings are found before anything is normalised."""
        if self.specials is None or "<" not in text:
            yield False, text
            return
        at = 0
        for m in self.specials.finditer(text):
            yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        yield False, text[at:]


class Bpe:
    """A BPE vocabulary with word ends.

    The encoding of a word is the only chain of tokens in which every token is stable on its own and each
    neighbouring pair is stable, that is, no merge would cross their border first.  So the last token of each
    prefix says all about it: for prefix p of length i it is the token t that ends there, stable beside the last
    token of p without t.  Words are walked in sorted order, a depth-first traversal of their trie, and the last
    tokens of a shared prefix are found once."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special_ids = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special_ids.items()}
        self.token_of_text = {str(i): t for i, t in self.tokens.items()}
        self.bytes = byte_chars()
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[a, b] = r
            self.made[a + b] = r
            self.halves[a + b] = (a, b)
        self.split = Splitter(list(self.special_ids))
        self._pairs: dict[int, bool] = {}
        self._stable: dict[str, bool] = {}
        #: Tokens that merging their own symbols gives.
        self.stable_ids = {t: i for t, i in self.vocab.items() if self._is_stable(t)}
        del self._stable
        #: Lengths of the stable tokens that end with two given characters, the longest first; the same for word ends.
        self.sizes, self.end_sizes = self._sizes(False), self._sizes(True)
        self.ids: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _sizes(self, ends: bool) -> dict[str, tuple[int, ...]]:
        found: dict[str, set[int]] = {}
        for t in self.stable_ids:
            if t.endswith(END) == ends and len(t := t.removesuffix(END)) > 1:
                found.setdefault(t[-2:], set()).add(len(t))
        return {k: (*sorted(v, reverse=True), 1) for k, v in found.items()}

    def _is_stable(self, t: str) -> bool:
        known = self._stable.get(t)
        if known is None:
            if t in self.halves:
                a, b = self.halves[t]
                known = self._is_stable(a) and self._is_stable(b) and self._uncrossed(a, b, self.made[t])
            else:
                known = len(t.removesuffix(END)) == 1
            self._stable[t] = known
        return known

    def _uncrossed(self, a: str, b: str, limit: float) -> bool:
        """Whether no merge of a rank below the limit crosses the border of two stable tokens.

        Merges are undone from the latest on: while a part at the border lives, only a merge that came before
        the merge which took it up could have crossed (of equal ranks, the left one comes first)."""
        rank, made, halves = self.rank, self.made, self.halves
        while True:
            if rank.get((a, b), limit) < limit:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit = min(limit, ra)
                a = halves[a][1]
            else:
                limit = min(limit, rb + 1)
                b = halves[b][0]

    def joins(self, a: int, b: int) -> bool:
        """Whether two stable tokens stay apart side by side."""
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._uncrossed(self.tokens[a], self.tokens[b], float("inf"))
        return known

    def encode_words(self, words) -> dict[str, list[int]]:
        """Token ids of each word (of byte characters)."""
        stable, joins, pairs = self.stable_ids.get, self.joins, self._pairs
        sizes, end_sizes, single = self.sizes.get, self.end_sizes.get, (1,)
        out: dict[str, list[int]] = {}
        size_of, last = [0], [-1]  # the last token of each prefix of the current word: its length and id
        before = ""
        for word in sorted(words):
            n = len(word)
            keep = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                keep += 1
            keep = min(keep, n - 1) + 1
            del size_of[keep:], last[keep:]
            for i in range(len(last), n):
                for size in sizes(word[i - 2 : i], single) if i > 1 else single:
                    if size > i:
                        continue
                    t = stable(word[i - size : i])
                    if t is None:
                        continue
                    if size < i:
                        a = last[i - size]
                        known = pairs.get(a << 20 | t)
                        if known is False or (known is None and not joins(a, t)):
                            continue
                    size_of.append(size)
                    last.append(t)
                    break
            for size in end_sizes(word[n - 2 :], single) if n > 1 else single:
                if size > n:
                    continue
                t = stable(word[n - size :] + END)
                if t is None:
                    continue
                if size == n:
                    break
                a = last[n - size]
                known = pairs.get(a << 20 | t)
                if known or (known is None and joins(a, t)):
                    break
            chain, i = [t], n - size
            while i:
                chain.append(last[i])
                i -= size_of[i]
            out[word] = chain[::-1]
            before = word
        return out

    def learn(self, words) -> None:
        """Keeps the ids, as text, of the words: new ones are encoded, old ones move up from the older half."""
        if len(self.ids) > CACHE_WORDS // 2:
            self.ids, self.older = {}, self.ids
        ids, older, byte = self.ids, self.older, self.bytes.__getitem__
        new = {}
        for w in words:
            if w not in ids:
                known = older.get(w)
                if known is None:
                    new[w] = "".join(map(byte, w.encode()))
                else:
                    ids[w] = known
        chains = self.encode_words(set(new.values()))
        for w, b in new.items():
            ids[w] = " ".join(map(str, chains[b]))

    def encode_batch(self, texts: list[str | None]) -> list[str]:
        """Ids of each text as decimal numbers joined by a space; null is an empty text."""
        split = self.split
        parted = []
        for text in texts:
            here = []
            for special, part in split.parts(text or ""):
                here.append(str(self.special_ids[part]) if special else split.words(part))
            parted.append(here)
        self.learn({w for here in parted for p in here if isinstance(p, list) for w in p})
        get = self.ids.__getitem__
        return [" ".join(filter(None, (p if isinstance(p, str) else " ".join(map(get, p)) for p in here))) for here in parted]

    def decode_batch(self, ids: list[str | None]) -> list[str]:
        """The tokens of each list of ids, joined by a space, as a vocabulary without a decoder is decoded."""
        get = self.token_of_text.__getitem__
        return [" ".join(map(get, x.split(" "))) if x else "" for x in ids]


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file's text, read where the driver is and sent to workers once (a fixed file of 1 to 2 MB)."""

    name: str
    spec: object

    @staticmethod
    def load(spark, path: str | None = None) -> Vocabulary:
        import hashlib

        with open(path or default_path(), encoding="utf-8") as f:
            text = f.read()
        return Vocabulary("bpe_" + hashlib.md5(text.encode()).hexdigest(), spark.sparkContext.broadcast(text))

    def bpe(self) -> Bpe:
        return _rt.large_state(self.name, lambda: Bpe(self.spec.value))


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", decode: bool = False, keep_text: bool = True) -> DataFrame:
    """All columns, with n_tokens, ids (decimal ids joined by a space) and, if asked for, decoded.

    Equal to the tokenizers library's encode without added special tokens: strings of special tokens inside a
    text are special tokens.  Null and empty texts have no tokens.  Columns of the input that have one of the
    new names are replaced; other columns, repeated rows and null ids pass through.  Nothing is shuffled."""
    return _mapped(docs, path, text_col, True, decode, keep_text)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns, with decoded: the tokens that `ids` names, joined by a space (null: empty)."""
    return _mapped(encoded, path, ids_col, False, True, True)


def _mapped(df: DataFrame, path: str | None, col: str, encodes: bool, decodes: bool, keep: bool) -> DataFrame:
    import pyspark.sql.types as T

    vocabulary = Vocabulary.load(df.sparkSession, path)
    new = (["n_tokens", "ids"] if encodes else []) + (["decoded"] if decodes else [])
    fields = [f for f in df.schema.fields if f.name not in new and (keep or f.name != col)]
    types = {"n_tokens": T.LongType(), "ids": T.StringType(), "decoded": T.StringType()}
    schema = T.StructType(fields + [T.StructField(n, types[n]) for n in new])
    names = [f.name for f in fields]
    (text,) = _rt.fresh(names, "given_text")
    source = df.select(*[f"`{n}`" for n in names if n != col], df[col].cast("string").alias(text))

    def run(batches):
        import pyarrow as pa

        bpe = vocabulary.bpe()
        for whole in batches:
            for batch in _rt.slices(whole, text, SLICE_BYTES):
                given = batch.column(text)
                texts = given.to_pylist()
                made = {}
                if encodes:
                    ids = bpe.encode_batch(texts)
                    made["ids"] = pa.array(ids, pa.string())
                    made["n_tokens"] = pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())
                else:
                    ids = texts
                if decodes:
                    made["decoded"] = pa.array(bpe.decode_batch(ids), pa.string())
                columns = [given if n == col else batch.column(n) for n in names] + [made[n] for n in new]
                yield pa.RecordBatch.from_arrays(columns, names=names + new)

    return source.mapInArrow(run, schema)

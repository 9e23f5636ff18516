"""Token counts: greedy longest-match word pieces by a linear automaton, without building the pieces."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from . import _rt
from .bpe import END, Splitter, Vocabulary, byte_chars

#: Words whose count a worker keeps between batches; past it, it starts anew.
CACHE_WORDS = 300_000


class Automaton:
    """Tries of pieces whose nodes say what greedy matching does when no edge goes on: how many pieces it has
    then taken (popped), and the node of what is left.  A word costs one step a symbol and one for each piece.

    A word's first piece comes from one set and all others from another, as in word-piece vocabularies that
    mark continued pieces; node 0 is the root of the first, node 1 that of the rest."""

    def __init__(self, first, rest=None):
        """first, rest: sequences of symbols; rest is the same set if it is not given."""
        self.edges: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        self.start = 1 if rest is None else 0
        for root, pieces in ((1, first),) if rest is None else ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for s in piece:
                    to = self.edges[at].get(s)
                    if to is None:
                        to = self.edges[at][s] = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                    at = to
                whole[at] = at > 1
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for s, v in self.edges[u].items():
                todo.append(v)
                if whole[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, taken = self.fail[u], self.popped[u]
                while z >= 0 and s not in self.edges[z]:
                    taken += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.edges[z][s], taken

    def count(self, word) -> int:
        """How many pieces greedy longest match takes, or -1 if it cannot take all of the word."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at, taken = self.start, 0
        for s in word:
            to = edges[at].get(s)
            while to is None:
                taken += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = edges[at].get(s)
            at = to
        while at > 1:
            taken += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return taken


class Counter:
    def __init__(self, spec: str):
        import json

        data = json.loads(spec)
        code = {c: b for b, c in enumerate(byte_chars())}
        self.automaton = Automaton([code[c] for c in t] for t in {t.removesuffix(END) for t in data["model"]["vocab"]})
        self.split = Splitter([])
        self.known: dict[str, int] = {}

    def count_batch(self, texts) -> list[tuple[int, int, int]]:
        """Words, tokens and unknown words of each text; an unknown word is one token."""
        known, out = self.known, []
        for text in texts:
            words = self.split.words(text or "")
            new = {w for w in words if w not in known}
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.automaton.count(w.encode())
            counts = list(map(known.__getitem__, words))
            unknown = counts.count(-1) if -1 in counts else 0
            out.append((len(words), sum(counts) + 2 * unknown, unknown))
        return out


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_tokens, n_unknown.

    The pieces are a tokenizer file's tokens without their word-end marks; words are split as the file asks, and
    the bytes of each are taken apart by greedy longest match.  Special strings are ordinary text.  Null and empty texts have no words; null
    or repeated ids pass through, each row apart.  Other columns are not read.  Nothing is shuffled."""
    vocabulary = Vocabulary.load(docs.sparkSession, path)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counter = _rt.large_state("counter_" + vocabulary.name, lambda: Counter(vocabulary.spec.value))
        for whole in batches:
            for batch in _rt.slices(whole, "text"):
                made = np.array(counter.count_batch(batch.column("text").to_pylist()), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(made[:, i]) for i in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")

"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rt

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_chars", "word_chars_sd", "upper", "lower", "digit", "space", "other_ascii", "beyond_ascii",
    "period_comma", "exclaim_ask", "bar_slash", "symbols", "upper_words", "sign_end_words", "distinct_words", "top_word", "distinct_lines", "words_a_line", "stop_end_lines", "html_signs", "link_signs",
)


@dataclass(frozen=True)
class QualityParams:
    features: int = 128
    #: Of the Gaussian kernel exp(-gamma |x - y|^2) over standardised statistics.
    gamma: float = 0.02
    ridge: float = 1e-3
    seed: int = 11
    bins: int = 2000


def _class_table() -> np.ndarray:
    """Which kinds of byte each byte is: one row a kind."""
    b = np.arange(256)
    ch = lambda s: np.isin(b, list(s.encode()))
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    space = np.isin(b, _rt.ASCII_SPACE)
    rows = [upper, lower, digit, space, (b < 128) & ~upper & ~lower & ~digit & ~space, b >= 128, ch(".,;:"), ch("!?"), ch("|/\\"), ch("#$%&*@^~+=_"), ch("<>{}"), ch("[]()")]
    return np.array(rows, bool)


def statistics(column) -> np.ndarray:
    """One row of STATISTICS for each text of an Arrow column (null: empty)."""
    data, offsets = _rt.text_buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    chars = np.maximum(size, 1)
    table = _class_table()
    share = []
    for row in table:
        if len(data):
            sums = np.concatenate(([0], np.cumsum(row[data])))
            share.append((sums[offsets[1:]] - sums[offsets[:-1]]) / chars)
        else:
            share.append(np.zeros(n))
    s, e, doc = _rt.word_spans(data, offsets, _rt.separators(_rt.ASCII_SPACE))
    count = np.bincount(doc, minlength=n).astype(float)
    most = np.maximum(count, 1)
    length = (e - s).astype(float)
    mean = np.bincount(doc, length, minlength=n) / most
    spread = np.sqrt(np.maximum(0, np.bincount(doc, length**2, minlength=n) / most - mean**2))
    if len(s):
        upper = np.concatenate(([0], np.cumsum(table[0][data])))
        shouted = (upper[e] - upper[s] >= 2).astype(float)
        last = data[e - 1]
        signed = (np.isin(last, list(b"#$%&*@^~+=_|!")) | table[11][last]).astype(float)
    else:
        shouted = signed = length
    distinct, top = _distinct(_rt.spans_hash(data, s, e), doc, n)
    ls, le, ldoc = _rt.word_spans(data, offsets, _rt.separators((0x0A,)))
    lines = np.bincount(ldoc, minlength=n).astype(float)
    line_distinct, _ = _distinct(_rt.spans_hash(data, ls, le), ldoc, n)
    stops = np.isin(data[le - 1], list(b".!?")).astype(float) if len(ls) else np.zeros(0)
    columns = [
        np.log1p(size), np.log1p(count), np.log1p(lines), mean, spread, *share[:6], share[6], share[7], share[8], share[9],
        np.bincount(doc, shouted, minlength=n) / most, np.bincount(doc, signed, minlength=n) / most, distinct / most, top / most,
        line_distinct / np.maximum(lines, 1), count / np.maximum(lines, 1), np.bincount(ldoc, stops, minlength=n) / np.maximum(lines, 1), share[10], share[11],
    ]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(STATISTICS)))


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and the count of its most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    count = np.diff(np.concatenate((at, [len(h)])))
    top = np.zeros(n)
    np.maximum.at(top, d[at], count)
    return np.bincount(d[at], minlength=n).astype(float), top


@dataclass(frozen=True)
class QualityModel:
    params: QualityParams
    mean: np.ndarray = None
    scale: np.ndarray = None
    weights: np.ndarray = None
    steps: tuple = field(default=((), ()))

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos features whose inner products approximate the Gaussian kernel, and a constant."""
        rng = np.random.default_rng(self.params.seed)
        k = self.params.features
        w = rng.normal(size=(x.shape[1], k)) * np.sqrt(2 * self.params.gamma)
        b = rng.uniform(0, 2 * np.pi, size=k)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.sqrt(2 / k) * np.cos(z @ w + b), np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        at, value = self.steps
        return np.clip(np.interp(self.raw(x), at, value), 0, 1)


def isotonic(position: np.ndarray, weight: np.ndarray, label_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing least-squares fit by pooling neighbours; each block stands at its mean position."""
    blocks: list[list[float]] = []
    for p, w, y in zip(position, weight, label_sum):
        blocks.append([p * w, w, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


NAMES = [f"x{i}" for i in range(len(STATISTICS))]


def _free_names(columns) -> list[str]:
    """NAMES, with underscores before all of them where one would clash with a column."""
    mark = ""
    while {c.lower() for c in columns} & {mark + n for n in NAMES}:
        mark += "_"
    return [mark + n for n in NAMES]


def _names_in(table: DataFrame) -> list[str]:
    """The columns of a table that with_statistics made: those with most underscores."""
    marks = [c[: -len(NAMES[0])] for c in table.columns if c.strip("_") == NAMES[0]]
    return next([m + n for n in NAMES] for m in sorted(marks, key=len, reverse=True) if {m + n for n in NAMES} <= set(table.columns))


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of `keep` and the statistics of the text (null: empty) as x0, x1, ..., about 200 bytes a row.

    Where a kept column has such a name, these get underscores before theirs.  Repeated rows and null ids pass
    through; other columns are not read; nothing is shuffled; no rows: no rows."""
    (text,) = _rt.fresh(keep, "given_text")
    names = _free_names(keep)
    source = docs.select(*[f"`{c}`" for c in keep], _rt.text_or_empty(text_col).alias(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != text)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _rt.slices(whole, text):
                x = statistics(batch.column(text))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=[*keep, *names])

    return source.mapInArrow(run, kinds + "".join(f", {n} double" for n in names))


def _matrix(batch, names: list[str] = NAMES) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy() for n in names], axis=1)


def fit(labelled: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """labelled: statistics and y (0 or 1); rows with a null y are ignored.  Uses all other rows.

    Means, the normal equations and the calibration's histogram are sums over partitions; the driver gets
    8,515 numbers, then at most `bins` rows.  Without labels every score is 0.5; with labels of one kind, that kind."""
    scratch = _rt.Scratch(labelled.sparkSession)
    table = scratch.write(labelled.where("y is not null").select(F.col("y").cast("double").alias("y"), *[F.col(c).alias(n) for c, n in zip(_names_in(labelled), NAMES, strict=True)]), "labelled")
    row = table.agg(F.count("*").alias("n"), *[f(n).alias(f"{k}{n}") for n in NAMES for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not row["n"]:
        return QualityModel(params)
    mean = np.array([row[f"m{n}"] for n in NAMES])
    scale = np.maximum([row[f"s{n}"] for n in NAMES], 1e-3)
    model = QualityModel(params, mean, scale)

    def equations(batches):
        import pyarrow as pa

        k = params.features + 2
        total = np.zeros((k, k))
        for batch in batches:
            z = np.concatenate((model.features(_matrix(batch)), batch.column("y").to_numpy()[:, None]), axis=1)
            total += z.T @ z
        at = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0]))), pa.array(total[at])], names=["at", "v"])

    k = params.features + 2
    sums = np.zeros((k, k))
    rows = sorted((r["at"], r["v"]) for r in table.mapInArrow(equations, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect())
    sums[np.triu_indices(k)] = [v for _, v in rows]
    sums += np.triu(sums, 1).T
    penalty = params.ridge * row["n"] * np.eye(k - 1)
    penalty[-1, -1] = 0
    model = QualityModel(params, mean, scale, np.linalg.solve(sums[:-1, :-1] + penalty / params.features, sums[:-1, -1]))

    def histogram(batches):
        import pyarrow as pa

        count, total = np.zeros(params.bins), np.zeros(params.bins)
        for batch in batches:
            b = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * params.bins, 0, params.bins - 1).astype(int)
            count += np.bincount(b, minlength=params.bins)
            total += np.bincount(b, batch.column("y").to_numpy(), minlength=params.bins)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(total[at])], names=["bin", "n", "y"])

    found = sorted((r["bin"], r["n"], r["y"]) for r in table.mapInArrow(histogram, "bin long, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect())
    b, n, y = (np.array(c, float) for c in zip(*found))
    scratch.release()
    return QualityModel(params, mean, scale, model.weights, isotonic((b + 0.5) / params.bins * 2 - 0.5, n, y))


def score(table: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns of `keep` with score (0 to 1; a column of that name is replaced), from a table of with_statistics; row by row.

    Null ids and repeated rows pass through, null and empty texts have a score as any other; no rows: no rows."""
    names = _names_in(table)
    keep = [c for c in keep if c.lower() != "score"]
    source = table.select(*[f"`{c}`" for c in keep], *names)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(keep)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(_matrix(batch, names)))], names=[*keep, "score"])

    return source.mapInArrow(run, kinds + "score double")

"""Line, substring and near-duplicate removal, and the pipeline, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanloom.llm import line_dedup, minhash, substring_dedup

SF = "/root/testdata/sf0.001"


def frame(spark, docs):
    """Columns that clash with the operators' own names come along."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, removed string, n_links int")


def words(n, start=0, stem="w"):
    return [f"{stem}{i}" for i in range(start, start + n)]


# ---------------------------------------------------------------- lines
def brute_lines(docs, num=4, den=5):
    seen, out = [], {}
    for i, t in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(line.encode().split())
            if s:
                if any(den * len(s & x) >= num * len(s | x) for x in seen):
                    gone.append(k)
                seen.append(s)
        out[i] = gone
    return out


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(2)
    base = [words(n, 100 * n, "l") for n in (1, 3, 4, 5, 8, 9, 10, 20, 40)]
    docs = [(None, "null id line here\n"), (0, None), (1, ""), (2, "\n\n"), (3, "a b c d e\r\na b c d e f"), (4, "x " * 5000)]
    for i in range(5, 60):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                if rnd.random() < 0.5 and len(w) > 1:
                    w.pop(rnd.randrange(len(w)))
                else:
                    w.insert(rnd.randrange(len(w) + 1), f"z{rnd.randrange(6)}")
            rnd.shuffle(w)
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    got = line_dedup.line_dedup(frame(spark, docs)).collect()
    want = brute_lines(docs)
    assert {r["doc_id"]: list(r["removed"]) for r in got} == want
    for r in got:
        t = dict(docs)[r["doc_id"]]
        assert r["text"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[r["doc_id"]]))
        assert (r["n_lines"], r["n_removed"]) == (0 if t is None else len(t.split("\n")), len(want[r["doc_id"]]))


def test_line_dedup_many_near_copies(spark):
    rnd = random.Random(4)
    base = words(30)
    docs = [(i, " ".join(w if rnd.random() > 0.05 else f"q{rnd.randrange(1000)}" for w in base)) for i in range(150)]
    assert {r["doc_id"]: list(r["removed"]) for r in line_dedup.line_dedup(frame(spark, docs)).collect()} == brute_lines(docs)


def test_line_dedup_repeats_and_nothing(spark):
    docs = [(1, "same line twice\nother"), (1, "same line twice\nother"), (2, "other")]
    got = sorted((r["doc_id"], list(r["removed"])) for r in line_dedup.line_dedup(frame(spark, docs)).collect())
    assert got == [(1, []), (1, []), (2, [0])]
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_is_exact_whatever_counts_as_frequent(spark):
    """Rare words alone, pairs of frequent words alone, and a mix; and cells that many words share."""
    rnd = random.Random(3)
    vocab = words(60)
    docs = []
    for i in range(80):
        w = [vocab[min(59, int(rnd.expovariate(0.08)))] for _ in range(rnd.randrange(1, 25))]
        docs.append((i, "\n".join([" ".join(w), " ".join(w[: rnd.randrange(len(w)) + 1] + rnd.sample(vocab, 1))])))
    want = brute_lines(docs)
    for frequent, bits in ((1, 24), (8, 24), (1 << 20, 24), (8, 3)):
        got = line_dedup.line_dedup(frame(spark, docs), line_dedup.LineDedupParams(frequent=frequent, cell_bits=bits, first=1, most=2)).collect()
        assert {r["doc_id"]: list(r["removed"]) for r in got} == want, (frequent, bits)


@pytest.mark.parametrize("num, den", [(1, 2), (3, 5), (7, 10), (9, 10), (1, 1), (1, 5)])
def test_line_dedup_of_other_likenesses(spark, num, den):
    rnd = random.Random(num * 10 + den)
    vocab = words(25)
    docs = [(i, "\n".join(" ".join(rnd.sample(vocab, rnd.randrange(1, 8)) + rnd.choice([[], [f"own{i}"]])) for _ in range(2))) for i in range(70)]
    want = brute_lines(docs, num, den)
    for frequent in (1, 1 << 15):
        got = line_dedup.line_dedup(frame(spark, docs), line_dedup.LineDedupParams(num=num, den=den, frequent=frequent, first=2, most=3)).collect()
        assert {r["doc_id"]: list(r["removed"]) for r in got} == want, frequent


def test_line_dedup_refuses_likenesses_beyond_one():
    for num, den in ((0, 5), (6, 5), (-1, 2)):
        with pytest.raises(ValueError):
            line_dedup.LineDedupParams(num=num, den=den)


def test_word_levels_follow_counts(spark):
    from scanloom.llm import _rt
    import numpy as np

    docs = spark.createDataFrame([("a b b",), ("b c\nc a",), (None,), ("d",)], "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    params = line_dedup.LineDedupParams(cell_bits=20)
    levels = line_dedup.word_levels(docs, params)
    data = np.frombuffer(b"abcd", np.uint8)
    h = _rt.spans_hash(np.concatenate((data, np.zeros(0, np.uint8))), np.arange(4), np.arange(1, 5))
    want = {int(c): int(line_dedup.level(np.array([float(n)]))[0]) for c, n in zip(line_dedup._cells(h, 20), (2, 3, 2, 1))}
    assert {int(i): int(levels[i]) for i in np.flatnonzero(levels)} == {k: v for k, v in want.items() if v}
    assert list(line_dedup.level(np.array([0.0, 1.0, 2.0, 4.0, 1024.0]))) == [0, 0, 2, 6, 38]


def written_counts(monkeypatch):
    """Rows of each intermediate table that is written from here on."""
    counts, write = [], line_dedup._rt.Scratch.write

    def spy(self, df, name):
        out = write(self, df, name)
        counts.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup._rt.Scratch, "write", spy)
    return counts


def test_line_dedup_like_lines_of_one_document(spark, monkeypatch):
    """Lines of one document, and documents whose ids are no numbers, have an order: no pairs of all with all."""
    base = words(20)
    counts = written_counts(monkeypatch)
    one = [(1, "\n".join(" ".join([*base, f"q{i}"]) for i in range(20000)))]
    assert {r["doc_id"]: list(r["removed"]) for r in line_dedup.line_dedup(frame(spark, one)).collect()} == {1: list(range(1, 20000))}
    named = [(f"n{i:03d}", " ".join([*base, f"q{i}"])) for i in range(300)]
    got = line_dedup.line_dedup(spark.createDataFrame(named, "doc_id string, text string")).collect()
    assert {r["doc_id"]: list(r["removed"]) for r in got} == {f"n{i:03d}": [0] if i else [] for i in range(300)}
    made = [n for name, n in counts if name == "pairs"]
    assert made and max(made) < 20000 * 40 and made[-1] < 300 * 40


def test_line_dedup_cuts_large_keys(spark, monkeypatch):
    """A pair of frequent words in many sets is dealt as pairs of parts, copies count once, and results stay exact."""
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    rnd = random.Random(12)
    base = words(20)
    docs = [(i, " ".join(w if rnd.random() > 0.08 else f"q{rnd.randrange(1000)}" for w in base)) for i in range(120)]
    docs += [(i, docs[0][1]) for i in range(120, 400)]
    dealt, deal = [], line_dedup._dealt

    def spy(rows, hot):
        out = deal(rows, hot)
        dealt.append((rows.groupBy("key").count().agg(F.max("count")).first()[0], out.groupBy("key", "unit").count().agg(F.max("count")).first()[0], out.select("key", "unit").distinct().count()))
        return out

    monkeypatch.setattr(line_dedup, "_dealt", spy)
    params = line_dedup.LineDedupParams(frequent=2, split=16, first=2, most=3)
    assert {r["doc_id"]: list(r["removed"]) for r in line_dedup.line_dedup(frame(spark, docs), params).collect()} == brute_lines(docs)
    (in_key, in_unit, units), (_, in_all, _) = dealt
    assert in_key <= 120 and in_unit < 64 and units > 10 and in_all <= 120


def test_line_dedup_names_that_clash(spark):
    """Columns called like inner ones come back as they were; text and ids of other types too."""
    docs = spark.createDataFrame([("a", "x y", 7, 8, 9), ("b", "x y", 1, 2, 3)], "doc_id string, text string, gone int, th int, gone_id int")
    rows = sorted(tuple(r) for r in line_dedup.line_dedup(docs).collect())
    assert rows == [("a", "x y", 7, 8, 9, 1, 0, []), ("b", "", 1, 2, 3, 1, 1, [0])]


# ---------------------------------------------------------------- substrings
def brute_substrings(docs, w=35):
    place = {}
    for k, (_, t) in enumerate(docs):
        x = (t or "").encode().split()
        for i in range(len(x) - w + 1):
            place.setdefault(tuple(x[i : i + w]), []).append((k, i))
    out = []
    for k, (d, t) in enumerate(docs):
        x = (t or "").encode().split()
        gone = {j for ps in place.values() if len(ps) > 1 for q, i in ps if q == k for j in range(i, i + w)}
        out.append((d, len(x), len(gone), b" ".join(y for j, y in enumerate(x) if j not in gone).decode()))
    return sorted(out, key=str)


def test_substring_dedup_against_brute_force(spark):
    rnd = random.Random(6)
    vocab = words(300, stem="v")
    passages = [[rnd.choice(vocab) for _ in range(n)] for n in (34, 35, 36, 60, 90)]
    docs = [(None, " ".join(passages[2])), (0, None), (1, ""), (2, "a " * 34), (3, "a " * 100), (4, "b a " * 60), (5, "x y z " * 40), (6, "x y  z\tq\x0bw")]
    for i in range(7, 60):
        x = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 3)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "edit"
            x[rnd.randrange(len(x) + 1) : 0] = p
        docs.append((i, rnd.choice([" ", "  ", "\n"]).join(x)))
    docs += [(58, docs[20][1]), (59, docs[20][1]), (59, docs[20][1])]
    got = sorted([tuple(r) for r in substring_dedup.substring_dedup(frame(spark, docs)).collect()], key=str)
    assert got == brute_substrings(docs)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_recompression_is_local():
    """Equal passages get equal symbols wherever all their deciding words are equal."""
    import numpy as np

    from scanloom.llm import _rt

    rng = np.random.default_rng(0)
    p = rng.integers(0, 20, 80)
    texts = [np.concatenate((rng.integers(0, 20, a), p, rng.integers(0, 20, b))) for a, b in ((13, 7), (4, 30))]
    found = []
    for a, x in zip((13, 4), texts):
        n = len(x)
        s = substring_dedup.Symbols(_rt.mix(x.astype(np.uint64)), np.arange(1, n + 1), np.arange(n), np.arange(1, n + 1), np.zeros(n, int))
        here = set()
        for level in (1, 2, 3):
            s = substring_dedup.recompress(s, level)
            inside = (s.left >= a) & (s.right <= a + 80)
            here |= set(zip(s.name[inside].tolist(), (s.end[inside] - a).tolist()))
        found.append(here)
    assert found[0] == found[1] and len(found[0]) > 20


# ---------------------------------------------------------------- near-duplicates
def brute_classes(docs):
    def bag(t):
        x = (t or "").encode().split()
        return Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) if x else Counter()

    bags = [bag(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            if common and 5 * common >= 4 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {docs[i][0]: docs[find(i)][0] for i in range(len(docs))}


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(8)
    docs = [(0, None), (1, ""), (2, "one"), (3, "one"), (4, "one two"), (5, "r " * 400), (6, "r " * 400 + "s")]
    bases = [[f"b{b}_{i}" for i in range(n)] for b, n in enumerate((6, 30, 120, 400))]
    for i in range(7, 80):
        x = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            x[rnd.randrange(len(x))] = f"e{rnd.randrange(10**6)}"
        docs.append((i, " ".join(x)))
    got = minhash.near_duplicates(minhash.with_keys(frame(spark, docs))).collect()
    assert {r["doc_id"]: r["class_doc_id"] for r in got} == brute_classes(docs)
    assert {r["doc_id"] for r in got if r["kept"]} == {v for v in brute_classes(docs).values()}


def test_near_dedup_edges(spark):
    docs = [(None, "a b c d e f g"), (4, "a b c d e f g"), (5, " \n"), (5, "z")]
    out = minhash.near_dedup(frame(spark, docs))
    assert out.columns == ["doc_id", "text", "removed", "n_links"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("5", " \n"), ("5", "z"), ("None", "a b c d e f g")]
    assert minhash.near_dedup(frame(spark, [])).count() == 0


def test_signature_estimates_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    params = minhash.NearDupParams(bands=128, rows=4)
    h = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = rng.integers(1, 12, 60), rng.integers(1, 12, 60)
    sig = minhash.bag_min_hash(np.repeat([0, 1], 60), np.concatenate((h, h)), np.concatenate((a, b)), 2, params)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.08


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "v long, w long")
    got = {r["v"]: r["root"] for r in minhash.components(links, minhash._rt.Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_minhash_crowd_around_one_text(spark, monkeypatch):
    """Two thousand near copies of one text, most of which are not near each other: one class, and no pairs of all with all."""
    base = words(60)
    docs = [(0, " ".join(base))] + [(i, " ".join(f"q{i}" if k == i % 60 else w for k, w in enumerate(base))) for i in range(1, 2001)]
    counts = written_counts(monkeypatch)
    rows = minhash.near_duplicates(minhash.with_keys(frame(spark, docs))).collect()
    assert len(rows) == 2001 and sum(r["class_doc_id"] == 0 for r in rows) >= 1999 and sum(r["kept"] for r in rows) <= 3
    made = [n for name, n in counts if name == "pairs"]
    assert sum(made) < 2001 * 20


def test_near_dedup_keeps_columns_and_settings(spark):
    """Columns called like inner ones stay, results outlive later calls, and the session's settings are as before."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(n) for n in names]
    text = " ".join(words(20))
    docs = spark.createDataFrame([("a", text, 1, 2, 3), ("b", text, 4, 5, 6), ("c", "other words", 7, 8, 9), (None, None, 0, 0, 0)], "doc_id string, text string, _key int, th int, gone_id int")
    one = minhash.near_dedup(docs)
    two = minhash.near_dedup(docs.where("doc_id = 'c'"))
    assert sorted(map(tuple, one.collect()), key=str) == sorted([("a", text, 1, 2, 3), ("c", "other words", 7, 8, 9), (None, None, 0, 0, 0)], key=str)
    assert [tuple(r) for r in two.collect()] == [("c", "other words", 7, 8, 9)]
    assert [spark.conf.get(n) for n in names] == before


# ---------------------------------------------------------------- pipeline
@pytest.fixture(scope="module")
def stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from scanloom.llm._rt import Scratch

    stored = Scratch(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 3, None).otherwise(F.col("text")))
    out = [("input", docs.toPandas())]
    for name, stage in pipeline.STAGES:
        docs = stored.write(stage(spark, docs, SF), name)
        out.append((name, docs.toPandas()))
    return out


def test_pipeline_against_brute_force(stages):
    from test_native import brute_contamination

    (_, given), (_, lang), (_, lines), (_, near), (_, clean), (_, last) = stages
    assert all(list(d.columns) == list(given.columns) for d in (lang, lines, near, clean))
    letters = {r.doc_id for r in given.itertuples() if any(c.isalpha() for c in r.text or "")}
    assert set(lang.doc_id) == letters and 3 not in letters
    known = lang.merge(given, on="doc_id")
    assert (known.lang_x == known.lang_y).mean() > 0.97
    docs = [(r.doc_id, r.text) for r in lang.itertuples()]
    gone = brute_lines(docs)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}
    assert {r.doc_id: r.text for r in lines.itertuples()} == want
    assert all(r.n_chars == len(r.text) for r in lines.itertuples())
    classes = brute_classes(sorted(want.items()))
    assert set(near.doc_id) == set(classes.values())
    bench = __import__("pandas").read_parquet(f"{SF}/benchmark.parquet")
    marks = brute_contamination([(r.doc_id, r.text) for r in near.itertuples()], list(bench.itertuples(index=False, name=None)))
    assert set(clean.doc_id) == {m[0] for m in marks if not m[5]}
    assert set(last.doc_id) == set(clean.doc_id) and (last.n_tokens[last.text != ""] > 0).all()


def test_pipeline_run(spark, stages):
    import corpus_pipeline

    classes = minhash.near_duplicates(minhash.with_keys(spark.read.parquet(f"{SF}/documents.parquet")))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert classes.count() == spark.read.parquet(f"{SF}/documents.parquet").count()  # tables of other results are not the pipeline's


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "слова", None)], "doc_id long, text string, lang string")
    out = corpus_pipeline.language_id(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out) == [(1, "some words", None), (4, "слова", None)]
    out = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en")), SF).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in out) == [(1, "en"), (4, "en")]


def test_stages_share_nothing(spark):
    """Stages in any order, results read after others were made."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    second = corpus_pipeline.line_dedup_stage(spark, docs, SF)
    third = corpus_pipeline.near_dedup_stage(spark, docs.limit(50), SF)
    n = first.count()
    assert second.count() == docs.count() and third.count() <= 50 and first.count() == n

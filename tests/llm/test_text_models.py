"""BPE, token counts, language and quality: the library, brute force and held-out accuracy."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scanloom.llm import bpe, langid, quality, queries, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def model():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Bpe(f.read())


ODD = ["", None, "<|startoftext|>a<|endoftext|> <|endoftext|>", "ΣΑΣ İstanbul ½ ⅷ x²", "日本語テキスト 12345 don't WE'LL", "aaaaaaaa" * 50, "\x1c\x1d a\xa0b　c", "<| x |>", "😀😀👍🏽 ՘Ɤ", "à́b", "x" * 3000]


def test_bpe_equals_the_library(model, library):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("abcdehiortsnl '.,0éü") for _ in range(rnd.randrange(80))) for _ in range(2000)]
    got = model.encode_batch(texts)
    assert got == [" ".join(map(str, e.ids)) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert model.decode_batch(got) == [library.decode([int(x) for x in ids.split()], skip_special_tokens=False) for ids in got]


def test_bpe_shares_prefixes(model):
    words = ["inter", "interest", "interests", "in", "i"]
    assert model.encode_words(words) == {w: model.encode_words([w])[w] for w in words}


def test_bpe_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(ODD)] + [(None, "a b", None, None)], "doc_id long, text string, ids string, n_tokens int")
    out = bpe.encode(df, decode=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["n_tokens"] == 0 and rows[1]["ids"] == "" and rows[None]["n_tokens"] == 2
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode(out.drop("decoded")).collect()}
    assert again == {k: r["decoded"] for k, r in rows.items()}
    assert bpe.encode(df.limit(0)).count() == 0


def greedy(word, first, rest):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (rest if at else first)), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


def test_automaton_against_greedy():
    rnd = random.Random(5)
    for _ in range(200):
        make = lambda: {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 9))}
        first, rest = make(), make()
        a, b = token_counts.Automaton(first, rest), token_counts.Automaton(first)
        for _ in range(30):
            w = "".join(rnd.choice("abc" if rnd.random() < 0.1 else "ab") for _ in range(rnd.randrange(0, 14)))
            assert a.count(w) == greedy(w, first, rest) and b.count(w) == greedy(w, first, first)


def test_token_counts_query_against_greedy(spark, model):
    pieces = {t.removesuffix(bpe.END) for t in model.vocab}
    got = {r["doc_id"]: r for r in queries.op4_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = ["".join(model.bytes[b] for b in w.encode()) for w in model.split.words(r["text"])]
        assert (got[r["doc_id"]]["n_words"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_unknown"]) == (len(words), sum(greedy(w, pieces, pieces) for w in words), 0)


def test_token_counts_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 1), (1, "a b", 1), (1, "a b", 1)], "doc_id long, text string, n_words int")
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in token_counts.token_counts(df).collect()) == [(0, 0), (1, 0), (1, 2), (1, 2)]
    assert token_counts.token_counts(df.limit(0)).count() == 0


def brute_profile(texts, top=300):
    from collections import Counter

    count = Counter()
    for t in texts:
        text = "".join(c if c.isalpha() else " " for c in t)
        for w in text.lower().split():
            p = f" {w} "
            count.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    # gaps between words are shared, so the brute force counts the same n-grams
    return count


def test_gram_counts_against_plain_python(spark):
    import pyarrow as pa

    texts = ["Hello, wörld! it's", "", "...", "a", "Ab ab\nAB", None]
    doc, gram, count = langid.gram_keys(pa.array(texts), 3)
    for i, t in enumerate(texts):
        assert sorted(count[doc == i].tolist()) == sorted(brute_profile([t or ""]).values())


def plain_grams(text):
    """n-grams of a text by their codes, counted: letters are lower-cased one by one, a run of other signs is one gap."""
    from collections import Counter

    signs = " ".join(["", *"".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split(), ""])
    count = Counter(signs[i : i + n] for n in (1, 2, 3) for i in range(len(signs) - n + 1))
    code = lambda g: sum((1 if c == " " else 2 + ord(c)) << 21 * k for k, c in enumerate(reversed(g)))
    return Counter({code(g): n for g, n in count.items() if g.strip() and (len(g) < 3 or g[1] != " ")})


def ranked(count, top=300):
    return {g: i for i, (g, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:top])}


def plain_language(text, profiles, top=300):
    own = ranked(plain_grams(text))
    if not own:
        return "und", 0.0
    far = {name: sum(abs(p[g] - r) if g in p else top for g, r in own.items()) for name, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (len(own) * top)


def test_language_query_against_plain_python(spark):
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = {}
    for r in docs:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    profiles = {name: ranked(c) for name, c in counts.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op8_language(spark, SF).collect()}
    for r in docs:
        lang, score = plain_language(r["text"], profiles)
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-9


def test_language_ties_and_letters_beyond_all_planes(spark):
    """Equal distances go to the first name; letters of equal low bits are different letters."""
    profiles = langid.learn_profiles(spark.createDataFrame([("ab", "zz"), ("ab", "aa"), ("abc abc", "latin"), ("\u8061\u8062\u8063", "han"), ("\U00020061", "far")], "text string, lang string"))
    plain = {name: {g: i for i, g in enumerate(p)} for name, p in profiles.items()}
    texts = ["ab", "\u8061\u8062\u8063", "abc", "\U00020061\U00020061", "\u0130x \u1e9e", "".join(chr(0x4E00 + i) for i in range(9000)) * 2, "a" * 70000]
    got = langid.identify(spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, _given_text int"), profiles)
    assert "_given_text" in got.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert [rows[i]["lang_pred"] for i in range(4)] == ["aa", "han", "latin", "far"]
    for i, t in enumerate(texts):
        lang, score = plain_language(t, plain)
        assert rows[i]["lang_pred"] == lang and abs(rows[i]["score"] - score) < 1e-9 and rows[i]["_given_text"] == 5


def test_grams_of_many_letters_and_texts():
    """The same n-grams where one number cannot hold text and signs."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(1)
    texts = ["".join(chr(rnd.choice((0x4E00, 0xAC00, 0x20000)) + rnd.randrange(11000)) for _ in range(40)) for _ in range(700)] * 40
    doc, gram, count = langid.gram_keys(pa.array(texts), 3)
    for i in (0, 13, 699, 700 * 39 + 13):
        own = doc == i
        assert dict(zip(gram[own].tolist(), count[own].tolist())) == dict(plain_grams(texts[i]))
    assert (np.diff(doc) >= 0).all()


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat and the hat", "en"), ("der Hund und die Katze", "de"), ("x", None)], "text string, lang string")
    profiles = langid.learn_profiles(train)
    assert set(profiles) == {"en", "de"}
    df = spark.createDataFrame([(1, "the hat", "xx", 0), (2, "die Hunde", "xx", 0), (3, None, "xx", 0), (4, "", "xx", 0), (5, "123 ...", "xx", 0), (None, "the", None, None), (6, "the " * 20000, "", 0)], "doc_id long, text string, lang_pred string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, profiles).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None, 6)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(df.limit(0), profiles).count() == 0 and langid.learn_profiles(train.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.identify(df, {}).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    rows = queries.op8_language(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(truth, on="doc_id")
    assert len(rows) == len(truth) and (rows.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows.doc_id]).all()
    part = both[both.held_out & both.lang.notna()]
    assert (part.lang_pred == part.lang).mean() > 0.97


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_quality(spark, sf).toPandas()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    both = rows.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    part = both[both.held_out]
    good, bad = part[part.quality == 1].score, part[part.quality == 0].score
    assert (good.values[:, None] > bad.values).mean() > 0.95


def test_quality_query_against_numpy(spark):
    """Sums over partitions, weights and calibrated scores, against one process."""
    import numpy as np
    import pyarrow as pa

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas().dropna(subset=["quality"]).groupby("doc_id").quality.max()
    x = quality.statistics(pa.array(docs.text))
    held = np.array([zlib.crc32(str(d).encode()) % 3 == 1 for d in docs.doc_id])
    use = ~held & docs.doc_id.isin(marks.index).to_numpy()
    y = docs.doc_id[use].map(marks).to_numpy(float)
    p = quality.QualityParams()
    mean, scale = x[use].mean(0), np.maximum(x[use].std(0), 1e-3)
    rng = np.random.default_rng(p.seed)
    w, b = rng.normal(size=(x.shape[1], p.features)) * np.sqrt(2 * p.gamma), rng.uniform(0, 2 * np.pi, size=p.features)
    z = np.sqrt(2 / p.features) * np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b)
    z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
    penalty = np.diag([p.ridge * use.sum() / p.features] * p.features + [0.0])
    raw = z @ np.linalg.solve(z[use].T @ z[use] + penalty, z[use].T @ y)
    bins = np.clip((raw[use] + 0.5) / 2 * p.bins, 0, p.bins - 1).astype(int)
    blocks = [[(k + 0.5) / p.bins * 2 - 0.5, float((bins == k).sum()), y[bins == k].sum()] for k in np.unique(bins)]
    blocks = [[at * n, n, s] for at, n, s in blocks]
    k = 0
    while k < len(blocks) - 1:  # pool neighbours until the means grow
        if blocks[k][2] / blocks[k][1] >= blocks[k + 1][2] / blocks[k + 1][1]:
            blocks[k : k + 2] = [[u + v for u, v in zip(*blocks[k : k + 2])]]
            k = max(0, k - 1)
        else:
            k += 1
    want = np.interp(raw, [at / n for at, n, _ in blocks], [s / n for _, n, s in blocks])
    got = queries.op10_quality(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert (got.held_out.to_numpy() == held).all()
    assert np.abs(got.score.to_numpy() - np.clip(want, 0, 1)).max() < 1e-3  # a raw value at the border of a bin may fall to either side
    assert (np.abs(got.score.to_numpy() - np.clip(want, 0, 1)) < 1e-6).mean() > 0.99


def test_quality_names_that_clash(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b c", 5.0, "s"), (2, "", 6.0, None)], "doc_id long, text string, x0 double, _given_text string")
    stats = quality.with_statistics(docs, ["doc_id", "x0", "_given_text"])
    model = quality.fit(stats.withColumn("y", F.col("doc_id") - 1))
    rows = sorted(tuple(r) for r in quality.score(stats, model, ["doc_id", "x0", "_given_text"]).collect())
    assert [r[:3] for r in rows] == [(1, 5.0, "s"), (2, 6.0, None)] and rows[0][3] < rows[1][3]


def test_quality_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "x " * 50000), (3, "x")], "doc_id long, text string")
    stats = quality.with_statistics(docs, ["doc_id"])
    assert stats.count() == 5
    from pyspark.sql import functions as F

    assert {r["score"] for r in quality.score(stats, quality.fit(stats.withColumn("y", F.lit(None).cast("int"))), ["doc_id"]).collect()} == {0.5}
    assert {r["score"] for r in quality.score(stats, quality.fit(stats.withColumn("y", F.lit(1))), ["doc_id"]).collect()} == {1.0}
    assert quality.with_statistics(docs.limit(0), ["doc_id"]).count() == 0


def test_isotonic_pools_violators():
    import numpy as np

    at, value = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(value) > 0).all() and value.tolist() == [0.0, 0.5, 1.0]

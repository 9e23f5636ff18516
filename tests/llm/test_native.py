"""Chat formatting, decontamination and fingerprints: edge cases and brute force."""

import hashlib
import re

import pytest

from scanloom.llm import chat_format, decontaminate, fingerprint, neighbours, queries


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---------------------------------------------------------------- chat formatting
def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, n_turns int")


def test_chat_round_trip_of_control_strings(spark):
    texts = ["</s>", "<\\/s>", "[INST] x [/INST]", "<<SYS>>", "\\", "<\\\\<SYS>>", "", None, "a<", "[", "<|end|>", " pad ", "é\nñ<s>\n"]
    rows = [(i, 0, role, t, "x", 1) for i, (t, role) in enumerate((t, r) for t in texts for r in ("user", "assistant", "system", "tool<|text|>"))]
    out = chat_format.format_chat(chat(spark, rows)).select("conv_id", chat_format.joined_text(chat_format.F.col("segments")).alias("f"))
    got = {r["conv_id"]: r["turns"] for r in out.select("conv_id", chat_format.read_turns(chat_format.F.col("f")).alias("turns")).collect()}
    assert {k: [(t["role"], t["text"]) for t in v] for k, v in got.items()} == {r[0]: [(r[2], r[3] or "")] for r in rows}


def test_escaped_text_holds_no_control_string(spark):
    t = chat_format.LLAMA
    rows = [(i, c * 2) for i, c in enumerate(t.controls)]
    got = spark.createDataFrame(rows, "i int, t string").select(t.escape(chat_format.F.col("t")).alias("e"), t.unescape(t.escape(chat_format.F.col("t"))).alias("b"), "t").collect()
    assert all(c not in r["e"] for r in got for c in t.controls) and all(r["b"] == r["t"] for r in got)


def test_chat_machine_and_loss(spark):
    rows = [
        (1, 0, "system", "s", "", 0), (1, 1, "user", "u", "", 0), (1, 2, "assistant", "a1", "", 0), (1, 3, "user", "v", "", 0), (1, 4, "assistant", "a2", "", 0),
        (2, 0, "assistant", "x", "", 0), (2, 1, "user", "y", "", 0),
        (3, 0, "user", "p", "", 0), (3, 0, "user", "p", "", 0),
        (None, None, None, None, None, None),
    ]
    got = by_id(chat_format.format_chat(chat(spark, rows)).withColumn("loss", chat_format.loss_text(chat_format.F.col("segments"))), "conv_id")
    assert (got[1]["valid"], got[1]["first_bad"], got[1]["loss"], got[1]["n_turns"]) == (True, None, "a1a2", 5)
    assert (got[2]["valid"], got[2]["first_bad"], got[2]["loss"]) == (False, 0, "x")
    assert (got[3]["valid"], got[3]["first_bad"], got[3]["n_turns"]) == (False, 1, 2)
    assert (got[None]["valid"], got[None]["n_turns"]) == (False, 1)
    assert chat_format.format_chat(chat(spark, [])).count() == 0


def test_template_must_have_controls():
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(roles={"user": chat_format.Role("U:", "\n")})


# ---------------------------------------------------------------- decontamination
def brute_contamination(docs, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    wins = {}
    for i, t in items:
        w = find(t)
        if w and i is not None:
            for k in range(max(1, len(w) - window + 1)):
                wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = find(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    ids |= wins[x]
        out.append((d, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontaminate_edge_cases(spark):
    p = " ".join(f"w{i}" for i in range(20))
    items = [(1, p), (2, "Alpha beta"), (3, None), (4, "..."), (5, p), (None, "q r s t u"), (6, "solo"), (7, " ".join(["the"] * 14))]
    docs = [(1, "x " + p + " y"), (2, "ALPHA, beta! gamma"), (3, None), (4, ""), (5, p.replace("w7", "z7")), (6, p), (6, p), (6, "other"), (None, "solo"), (7, "beta alpha"), (8, " ".join(["the"] * 40)), (9, "w0 " * 3), (10, p + " " + " ".join(f"v{i}" for i in range(600)))]
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, item_id string, n_words int")
    b = spark.createDataFrame([(a, t, 1) for a, t in items], "item_id long, text string, doc_id int")
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["item_ids"]), r["contaminated"]) for r in decontaminate.decontaminate(d, b).collect()], key=str)
    assert got == brute_contamination(docs, items)
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    clean = decontaminate.decontaminate(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_decontaminate_beyond_the_broadcast_limit(spark, monkeypatch):
    """Where the benchmark is large, places are shuffled without the words, and results are the same."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    test_decontaminate_edge_cases(spark)


# ---------------------------------------------------------------- fingerprints
def test_fingerprint_estimates_weighted_jaccard(spark):
    from collections import Counter

    a = "a b c d e f g h i j a a b"
    texts = {1: a, 2: a, 3: a + " k l m n a", 4: "z y x", 5: " ".join(f"t{i}" for i in range(300)), 6: " ".join(f"t{i}" for i in range(100, 400)), 7: "a " * 50 + "b", 8: "a " * 25 + "b"}
    params = fingerprint.FingerprintParams(samples=128)
    df = spark.createDataFrame([(k, t, 5) for k, t in texts.items()], "doc_id long, text string, n int")
    got = {r["doc_id"]: r for r in fingerprint.fingerprint(df, ["doc_id"], "text", params).collect()}

    def jaccard(x, y):
        p, q = Counter(texts[x].split()), Counter(texts[y].split())
        return sum((p & q).values()) / sum((p | q).values())

    assert got[1]["fingerprint"] == got[2]["fingerprint"] and len(got[1]["fingerprint"]) == 8 * 128
    for x, y in ((1, 3), (1, 4), (5, 6), (7, 8), (1, 7)):
        near = sum(p == q for p, q in zip(got[x]["sig"], got[y]["sig"], strict=True)) / 128
        assert abs(near - jaccard(x, y)) < 0.16, (x, y, near, jaccard(x, y))


def test_fingerprint_error_with_the_query_s_samples(spark):
    """With as many samples as the query takes, the mean squared error is that of so many draws."""
    import random
    from collections import Counter

    rnd, params = random.Random(8), fingerprint.FingerprintParams()
    texts = {}
    for i in range(60):
        w = [f"t{rnd.randrange(60)}" for _ in range(rnd.randrange(20, 200))]
        texts[2 * i], texts[2 * i + 1] = w, w[: rnd.randrange(len(w))] + [f"u{rnd.randrange(60)}" for _ in range(rnd.randrange(60))]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    sig = {r["doc_id"]: r["sig"] for r in fingerprint.fingerprint(df, ["doc_id"], "text", params).collect()}
    error = expected = 0.0
    for i in range(60):
        p, q = Counter(texts[2 * i]), Counter(texts[2 * i + 1])
        true = sum((p & q).values()) / sum((p | q).values())
        error += (sum(a == b for a, b in zip(sig[2 * i], sig[2 * i + 1], strict=True)) / params.samples - true) ** 2
        expected += true * (1 - true) / params.samples
    assert error < 1.8 * expected


def test_fingerprint_query_against_plain_python(spark, tmp_path):
    rows = [(5, "one two three four"), (2, "one two three four"), (9, ""), (7, None), (1, "α β γ δ ε ζ η"), (3, "x" * 50), (4, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op6_fingerprint(spark, str(tmp_path)))
    order = sorted(rows, reverse=True)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[5]["fingerprint"] == got[2]["fingerprint"] != got[4]["fingerprint"]
    assert got[9]["fingerprint"] == "" and got[9]["near_next"] == 1.0 and got[9]["near_edited"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


def test_order_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (3, "c")], "doc_id long, text string")
    order = neighbours.Order(df)
    got = [(r["doc_id"], r["text"], r["following"]) for r in order.rows().collect()]
    assert sorted(got, key=str) == sorted([(3, "c", "a"), (1, "a", "a"), (1, "a", "n"), (None, "n", "c")], key=str)
    one = neighbours.Order(df.limit(0))
    assert one.rows().count() == 0


def test_order_deals_null_and_repeated_ids(spark):
    """No part holds all rows without an id, or all of one id."""
    rows = [(None if i % 2 else (7 if i % 3 else i), f"text {i}") for i in range(2400)]
    order = neighbours.Order(spark.createDataFrame(rows, "doc_id long, text string"))
    out = order.rows().select("pid", "rn", "doc_id", "text", "following").collect()
    sizes = {}
    for r in out:
        sizes[r["pid"]] = sizes.get(r["pid"], 0) + 1
    assert len(out) == 2400 and max(sizes.values()) < 400
    walk = sorted(out, key=lambda r: (-r["pid"], r["rn"]))
    assert [r["following"] for r in walk] == [r["text"] for r in walk[1:] + walk[:1]]
    ids = [r["doc_id"] for r in walk]
    assert ids == sorted(ids, key=lambda x: (x is None, -(x or 0)))


def test_queries_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op6_fingerprint(spark, str(tmp_path)).count() == 0
    assert [r["conv_id"] for r in queries.op1_chat_format(spark, str(tmp_path)).collect()] == [-1]


def test_pair_signatures_equal_separate_ones(spark):
    rows = [(1, "a b b ", "c d", "c c b"), (2, "", "x", ""), (3, "p q ", "", ""), (4, "", "", ""), (5, "k ", "k", "k k")]
    df = spark.createDataFrame(rows, "id long, both string, a string, b string")
    got = {r["id"]: r for r in fingerprint.pair_signatures(df, ["id"]).collect()}
    for side in "ab":
        alone = fingerprint.fingerprint(df.selectExpr("id", f"both || {side} AS text"), ["id"]).collect()
        assert {r["id"]: r["sig"] for r in alone} == {k: r[f"sig_{side}"] for k, r in got.items() if r[f"sig_{side}"] is not None}

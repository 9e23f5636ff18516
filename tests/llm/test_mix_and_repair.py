"""Mixing, importance resampling and conversation repair: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import importance, mixing, queries, turn_repair
from scanloom.llm._rt import Scratch, ranked

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size int, target int, rank int, n int"


# ---------------------------------------------------------------- ranks
def test_ranked_is_a_global_row_number(spark):
    rows = [(random.Random(5).randrange(50) * i % 37, i) for i in range(400)]
    out = ranked(spark.createDataFrame(rows, "at long, part long"), [F.col("at").desc(), F.col("part")], Scratch(spark), "no")
    got = sorted((r["no"], r["at"], r["part"]) for r in out.collect())
    assert got == [(i + 1, a, b) for i, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
    assert ranked(spark.createDataFrame([], "a long"), [F.col("a")], Scratch(spark)).count() == 0


# ---------------------------------------------------------------- importance resampling
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def resampled(docs, bench):
    """doc_id -> (n_features, weight, score, rank) by plain Python."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, bench)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out, able = {}, []
    for i, x in docs:
        words, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(words) >= 20:
            able.append(i)
    able.sort(key=lambda i: (-out[i][2], i is None, i))
    for k, i in enumerate(able[: 25 * len(able) // 100], 1):
        out[i][3] = k
    return {i: tuple(v) for i, v in out.items()}


def test_resample_query_equals_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in queries.op12_resample(spark, SF).collect()}
    assert got == resampled(docs, bench) and sum(v[3] is not None for v in got.values()) > 20


def test_resample_of_odd_texts(spark):
    texts = ["", None, "   ", "one", "Ä ä é", "x" * 5000, "a" * 63 + " " + "b" * 64 + " " + "c" * 65 + " " + "d" * 66, "A-B_c\x00d\x7fe", "語" * 300 + " two", "same words " * 400, "same words " * 400] + [f"word{i} " * 30 for i in range(20)]
    rows = [(i, t, None, 1, 2, 3, 4) for i, t in enumerate(texts)] + [(None, "same words " * 40, "s", 0, 0, 0, 0)]
    bench = spark.createDataFrame([("x", "same words two", 1), ("y", None, 2)], "item_id string, text string, doc_id int")
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.resample(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got == resampled([r[:2] for r in rows], ["same words two", None])


def test_resample_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert importance.resample(none, none).count() == 0
    rows = [(7, "w " * 25, None, 0, 0, 0, 0)] * 8
    out = importance.resample(spark.createDataFrame(rows, DOCS), none)
    assert sorted(r["rank"] or 0 for r in out.collect()) == [0] * 6 + [1, 2]
    assert importance.drawn(spark.createDataFrame(rows[:1], DOCS).drop("rank"), out).count() == 2


def test_crc_of_spans_equals_zlib():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2800, 200)
    ends = starts + rng.integers(0, 200, 200)
    got = ~importance._crc(data, starts, ends, np.full(200, 0xFFFFFFFF, np.uint32))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_resample_refuses_buckets_beyond_16_bits():
    with pytest.raises(ValueError):
        importance.ResampleParams(buckets=1 << 17)


# ---------------------------------------------------------------- mixing
def shared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by plain Python: group -> target."""
    order = sorted(sizes, key=lambda g: (g is None, (g or "").encode()))
    weight = {g: weights[i % len(weights)] for i, g in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[g] for g in open_)
        over = {g for g in open_ if weight[g] * level > most * sizes[g]}
        if not over:
            return out | {g: weight[g] * level for g in open_}
        for g in over:
            out[g] = most * sizes[g]
            left -= out[g]
        open_ -= over
    return out


def solved(sizes, target, most=2):
    """Rates of a group's documents: bisection of the one dual number."""
    x = np.array(sizes) / np.mean(sizes)
    rate = lambda lam: np.minimum(most, np.exp(np.minimum(lam * x, 50)))
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (rate(mid) * sizes).sum() < target else (lo, mid)
    return rate(hi)


def check_mix(docs, out, most=2):
    """docs: (doc_id, text, source); out: rows of mix()."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    groups = {}
    for i, _, g in docs:
        groups.setdefault(g, []).append(i)
    want = shared({g: sum(size[i] for i in ids) for g, ids in groups.items()}, most=most)
    rows = {r["doc_id"]: r for r in out}
    assert len(rows) == len(out) == len(docs)
    for g, ids in groups.items():
        words, mine = sum(size[i] for i in ids), [rows[i] for i in ids]
        assert {r["size"] for r in mine} == {size[i] for i in ids} and {r["source_size"] for r in mine} == {words}
        assert all(abs(r["target"] - want[g]) <= 1e-6 * max(1, want[g]) and 0 <= r["copies"] <= most for r in mine)
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - want[g]) <= max([1, *(r["size"] for r in mine)])
        if 0 < want[g] < most * words:
            some = [r for r in mine if r["size"]]
            assert np.allclose([r["rate"] for r in some], solved([r["size"] for r in mine], want[g])[[bool(r["size"]) for r in mine]], rtol=1e-5)


def test_mix_query_equals_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_mix(docs, mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    one, two = (sorted((r["doc_id"], r["size"], r["taken"], r["target"]) for r in queries.op11_mix(spark, SF).collect()) for _ in range(2))
    assert one == two and all(t <= 2 * s for _, s, t, _ in one)


def test_mix_of_a_hot_source_copies_and_nulls(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.choice([3, 3, 3, rng.randrange(1, 200)]), rng.choice(["é", "hot", "hot", "hot", None, "a"])) for i in range(3000)]
    docs += [(4000, None, "a"), (4001, "  ", "blank only"), (4002, "", None)]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], DOCS)
    out = mixing.mix(df).collect()
    check_mix(docs, out)
    # rows of one source and size differ by one copy at most
    by = {}
    for r in out:
        by.setdefault((r["source"], r["size"]), set()).add(r["copies"])
    assert all(max(x) - min(x) <= 1 for x in by.values())
    copies = mixing.repeated(mixing.mix(df).select("doc_id", "copies"))
    assert copies.count() == sum(r["copies"] for r in out) and copies.where("copy > copies OR copy < 1").count() == 0


def test_mix_of_nothing_one_row_and_repeated_rows(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    (row,) = mixing.mix(spark.createDataFrame([(1, "a b c d", "s", 0, 0, 0, 0)], DOCS)).collect()
    assert (row["size"], row["target"]) == (4, 6.0) and row["copies"] in (1, 2)
    same = mixing.mix(spark.createDataFrame([(1, "a b c d", "s", 0, 0, 0, 0)] * 10, DOCS)).collect()
    assert len(same) == 10 and sum(r["copies"] for r in same) == 15
    empty = mixing.mix(spark.createDataFrame([(1, None, None, 0, 0, 0, 0), (2, "", "x", 0, 0, 0, 0)], DOCS)).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in empty] == [(0, 0.0, 1)] * 2
    with pytest.raises(ValueError):
        mixing.MixParams(share=3.0, most=2)


# ---------------------------------------------------------------- conversation repair
def hurt(rows):
    """Rows after damage, by plain Python."""
    text_of = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows):
    """Faults, cost, audit and hash of (turn, role, text) in order: all edits compared from the end by (cost, letters)."""
    seen, kinds = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "a": (0, "", ())}
    for k in range(len(rows), -1, -1):
        here = {}
        for state in moves:
            after = "a" if state == "u" else "u"
            ways = [best[state]] if k == len(rows) and state in best else []
            if k < len(rows):
                _, role, text = rows[k]
                more = 3 if kinds[k] == "truncated" else 0
                add = lambda c, x, s, line: ways.append((c + best[s][0], x + best[s][1], line + best[s][2]))
                add(4, "D", state, ())
                if kinds[k] not in ("blank", "duplicate"):
                    if role[:1] in moves[state]:
                        add(more, "K", moves[state][role[:1]], (f"{role}:{text}",))
                    add(3 + more, "R", after, (f"{name[after]}:{text}",))
            here[state] = ways
        now = {s: min(w) if w else (10**9, "~", ()) for s, w in here.items()}
        for _ in range(4):
            now = {s: min([*here[s], (3 + now[t][0], "I" + now[t][1], (f"{name[t]}:", *now[t][2]))]) for s in moves for t in ["a" if s == "u" else "u"]}
        best = now
    cost, audit, lines = best[""]
    turns, first = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, *(kinds.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


CHAT = "conv_id long, turn long, role string, text string, kind string, n int, at int"


def repaired(spark, rows, damage=False):
    df = spark.createDataFrame([(*r, "x", 9, 9) for r in rows], CHAT)
    edits = turn_repair.repair(turn_repair.damaged(df), copies="n") if damage else turn_repair.repair(df)
    return {r["conv_id"]: tuple(r)[1:] for r in turn_repair.audits(edits).collect()}


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_repair_query_equals_plain_python(spark):
    rows = by_conv(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_turn_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got == {c: cheapest(hurt(v)) for c, v in rows.items()}


def test_repair_of_random_conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in range(300):
        for _ in range(rng.randrange(1, 12)):
            text = rng.choice(["a.", "b?", "c", "", " \n", None, "d!", "e", f"{rng.random()}."])
            rows.append((c, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u", "Sam"]), text))
    plain = {c: cheapest(sorted(((t, r or "", x or "") for _, t, r, x in v), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, v in by_conv(rows).items()}
    assert repaired(spark, rows) == plain
    hurt_rows = {c: hurt(v) for c, v in by_conv(rows).items()}
    assert repaired(spark, rows, damage=True) == {c: cheapest(v) for c, v in hurt_rows.items() if v}


def test_repair_of_conversations_across_parts(spark):
    """Most rows in three conversations, which lie in many parts, and one row a hundred times."""
    rng = random.Random(4)
    rows = [(c, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"{i}.", f"{i}", "", "same."])) for c in (1, 5, None) for i in range(1500)]
    rows += [(c, i, r, f"{c} {i}.") for c in range(10, 60) for i, r in enumerate(("user", "assistant"))]
    rows += [(7, None, "user", "again.")] * 100 + [(7, 1, "assistant", "yes.")]
    got = repaired(spark, rows)
    want = {c: cheapest(sorted(((t, r, x) for _, t, r, x in v), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, v in by_conv(rows).items()}
    assert got == want and got[7][6] == "K" + "D" * 99 + "K"


def test_repair_of_nothing_and_lost_conversations(spark, tmp_path):
    assert repaired(spark, []) == {}
    lost = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    rows = [(c, 0, "user", "x.") for c in lost] + [(None, None, None, None)]
    spark.createDataFrame([(*r, "x", 9, 9) for r in rows], CHAT).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_turn_repair(spark, str(tmp_path)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: nothing for c in lost} | {None: cheapest(hurt([(None, None, None, None)]))}


def test_repair_writes_the_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "hi.", "x", 9, 9), (1, 1, "assistant", "hello.", "x", 9, 9)], CHAT)
    turns = turn_repair.repaired(turn_repair.repair(df)).orderBy("at", "step").collect()
    assert [(r["role"], r["text"]) for r in turns] == [("user", "hi."), ("assistant", "hello.")]


def test_grammar_refuses_what_a_letter_does_not_decide():
    with pytest.raises(ValueError):
        turn_repair.TurnGrammar(moves={"": {"u": "u", "a": "a"}, "u": {"a": "a"}, "a": {"u": "u"}})
    with pytest.raises(ValueError):
        turn_repair.TurnGrammar(insert=0)

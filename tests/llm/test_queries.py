"""The registered queries over whole tables: against their SQL where there is some, else against plain Python."""

import hashlib
from collections import Counter

import duckdb
import pytest

from scanloom.llm import langid, queries

SF = "/root/testdata/sf0.001"


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())


def test_line_dedup_query(spark):
    docs, seen, want = table(spark, "documents", "doc_id", "text"), [], {}
    for i, t in sorted(docs):
        lines, gone = (t or "").split("\n"), []
        for k, line in enumerate(lines):
            s = frozenset(line.encode().split())
            if s:
                if any(5 * len(s & x) >= 4 * len(s | x) for x in seen):
                    gone.append(k)
                seen.append(s)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i] = (len(lines), len(gone), sha(",".join(map(str, gone))), sha(kept))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_lines", "n_removed", "removed_sha256", "kept_sha256")) for r in queries.op2_line_dedup(spark, SF).collect()}
    assert got == want


def test_minhash_query(spark):
    """Every link between documents, found by comparing all of them, holds a class together, and nothing else does."""
    bags = {}
    for i, t in table(spark, "documents", "doc_id", "text"):
        w = (t or "").encode().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in bags if bags[i])
    size = {i: sum(bags[i].values()) for i in ids}
    for a in ids:
        for b in ids:
            if a < b and 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b]):
                common = sum((bags[a] & bags[b]).values())
                if 5 * common >= 4 * (size[a] + size[b] - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in queries.op5_minhash(spark, SF).collect()}
    assert got == {i: (find(i), find(i) == i) for i in bags}


def test_bpe_query(spark):
    import sys

    from tokenizers import Tokenizer

    sys.path.insert(0, "/opt")
    path = "/opt/tokenizers/word_bpe_49k.json"
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    want = {}
    for i, text in table(spark, "documents", "doc_id", "text"):
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op9_bpe(spark, SF).collect()} == want


def test_fingerprints_refuse_ids_that_are_no_numbers(spark, tmp_path):
    spark.createDataFrame([("a", "some text")], "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(ValueError, match="whole number"):
        queries.op6_fingerprint(spark, str(tmp_path))


def test_language_profiles_refuse_long_grams():
    with pytest.raises(ValueError):
        langid.LangIdParams(longest=4)

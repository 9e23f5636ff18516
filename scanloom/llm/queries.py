"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, fingerprint, importance, langid, line_dedup, minhash, mixing, neighbours, quality, substring_dedup, token_counts, turn_repair
from ._rt import Scratch, documents

CONTROL = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, with figures read back from the output."""
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat_format.format_chat(rows)
    out = out.select("conv_id", "valid", chat_format.joined_text(F.col("segments")).alias("formatted"), chat_format.loss_text(F.col("segments")).alias("loss"))
    out = out.select("conv_id", "valid", "formatted", "loss", chat_format.read_turns(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') || '>' || role AS move,
    length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|turn\|>|\|text\|>|\|end\|>)'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 23 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|turn\|>|\|text\|>|\|end\|>)')) END AS chars
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(move IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM marked GROUP BY conv_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.array_join("removed", ","), 256).alias("removed_sha256"), F.sha2("text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 12] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
pos AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, w FROM d),
hit AS (SELECT k, i, n, item_id FROM (SELECT k, i, n, w[i:i + n - 1] AS win FROM pos, lens WHERE i + n - 1 <= len(w)) JOIN win USING (win)),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN items USING (k)
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class: the least doc_id of its near-duplicates."""
    out = minhash.near_duplicates(minhash.with_keys(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.col("class_doc_id").alias("class_id"), "n_links", "kept")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and their likeness.  doc_id must be a whole number, as the next
    row is the one with the next lower."""
    params = fingerprint.FingerprintParams()
    order = neighbours.Order(documents(table(spark, sf_dir, "documents")))
    rows = order.rows()
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.select("pid", "rn", "doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - third), F.substring("following", F.lit(1), third)).alias("edited"))
    base = rows.select("pid", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    # what both texts share, up to the end of a word
    both = F.regexp_extract(F.substring("text", F.lit(1), n - third), r"^(?s)(.*[\x09-\x0D\x20])", 1)
    pairs = rows.select("pid", "rn", "text", "edited", both.alias("both"))
    rest = lambda c: F.substring(c, F.length("both") + 1, F.length(c))
    pairs = pairs.select("pid", "rn", "both", rest("text").alias("a"), rest("edited").alias("b"))
    sig = fingerprint.pair_signatures(pairs, ["pid", "rn"], params).select("pid", "rn", F.col("sig_a").alias("sig"), F.col("sig_b").alias("edited_sig"))
    # a small table: the samples of all rows, read again by the row before each
    out = order.with_next(Scratch(spark).write(base.join(sig, ["pid", "rn"], "left"), "fingerprints"), "sig", "next_sig")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.as_text(F.col("sig")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sig"), F.col("edited_sig"), params.samples).alias("near_edited"),
        fingerprint.likeness(F.col("sig"), F.col("next_sig"), params.samples).alias("near_next"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn_profiles(docs.where(~held_out()).select("text", "lang"))
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).drop("text")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decode=True, keep_text=False)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    stats = Scratch(spark).write(quality.with_statistics(docs, ["doc_id", "held_out"]), "statistics")
    marks = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    out = quality.score(stats, quality.fit(stats.where("not held_out").join(marks, "doc_id")), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's copies in a mix of half as many words again, the sources weighing 5, 2, 1 in turn."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by their likeness to the benchmark; the best quarter of those of 20 words is numbered."""
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by their rows' places, with their faults and cheapest repair."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.audits(turn_repair.repair(turn_repair.damaged(rows), copies="n")).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, i, w[i:i + 34] AS win FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT win FROM win GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN twice USING (win)),
words AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_minhash": op5_minhash,
    "op6_fingerprint": op6_fingerprint,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_mix": op11_mix,
    "op12_resample": op12_resample,
    "op13_turn_repair": op13_turn_repair,
}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op3_decontaminate": OP3_SQL, "op7_substring_dedup": OP7_SQL}

"""The registered query of each operator, over its whole table, with the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import (
    compression_toxicity,
    decision_list,
    fuzzy_lines,
    indexed_quality,
    kd_shards,
    packing,
    pareto_mix,
    phrase_dedup,
    rp_forest,
    simhash_pivots,
    spelling_variants,
    token_shards,
    whitening,
)
from keepsake.llm.common import held_out, table


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_indexed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = indexed_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(table(spark, sf_dir, "documents"), shards=24)


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _vocabulary(name: str) -> str:
    """Where the tokenizer's file is; looked up when a query runs, so that the others need no vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary(packing.TOKENIZER))


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = compression_toxicity.judge(docs, compression_toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_window", "worst_gain")


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.round_trip(table(spark, sf_dir, "documents"), _vocabulary(token_shards.TOKENIZER))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_rp_forest, op2_indexed_quality, op3_kd_shards, op4_pareto_mix, op5_pack_sequences, op6_phrase_dedup, op7_fuzzy_lines,
    op8_compression_toxicity, op9_simhash_pivots, op10_decision_list, op11_token_shards, op12_spelling_variants, op13_whitening)}

ORACLES: dict[str, str] = {
    "op1_rp_forest": """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
),
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
       least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) = e.vec_id AS kept
FROM embeddings e""",
    "op12_spelling_variants": r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t
),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
),
counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes, t FROM counted, crc_table
),
checked AS (
  SELECT run, k, xor(list_reduce(range(1, length(bytes), 2),
    lambda c, i: xor(t[1 + xor(c, ('0x' || substr(bytes, i, 2))::BIGINT) % 256], c // 256), 4294967295), 4294967295) AS h
  FROM hashed
),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM checked
),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
-- levenshtein counts bytes, so each letter beyond a-z becomes one other ASCII character.
plain AS MATERIALIZED (
  SELECT word, n, translate(word, (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(192, 256) r(i)),
    (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(33, 97) r(i))) AS p FROM words
),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM plain a JOIN plain b
  ON length(b.p) BETWEEN length(a.p) - 1 AND length(a.p) + 1 AND a.word <> b.word AND levenshtein(a.p, b.p) = 1
),
best AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'other': encode(other)}) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN decode(b.other) END AS form,
         CASE WHEN -b.less >= 5 * w.n THEN (-b.less)::BIGINT END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
steps AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL
  SELECT s.word, f.form, s.step + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
),
roots AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
}

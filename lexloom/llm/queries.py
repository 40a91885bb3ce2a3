"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import digest, hamming, langid, minhash, mixing, pieces, substring, suffix, templates, tokenstore
from lexloom.llm.common import Scratch


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def piece_model() -> bytes:
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), n=2).drop("text_hash")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.digest(_documents(spark, sf_dir))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    return hamming.top_k(vectors, vectors.where("id % 20 = 0"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_documents(spark, sf_dir), piece_model())


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "tokens").path("store")
    tokenstore.write(_documents(spark, sf_dir), store, tokenizer_file("word_bpe_49k.json"))
    return tokenstore.read(spark, store)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(_documents(spark, sf_dir))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir)).drop("source", "start", "text_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_line_templates": op2_line_templates,
    "op3_top_k": op3_top_k,
    "op4_language_id": op4_language_id,
    "op5_substring": op5_substring,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_store": op7_token_store,
    "op8_fingerprints": op8_fingerprints,
    "op9_suffix_array": op9_suffix_array,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = {
    "op3_top_k": """
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
         list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (v.embedding[i] > 0))::INTEGER))::INTEGER AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank, neighbor_id, distance FROM pairs)
WHERE rank <= 10
""",
    "op10_mixing": """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM (SELECT source, sum(size) AS source_size FROM sizes GROUP BY source)),
weighed AS (SELECT *, CASE rank % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM ranked),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
             - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
free AS (
  SELECT min(source_size / weight) AS ratio, arg_min(level, (source_size / weight, rank)) AS level
  FROM levels WHERE NOT 2 * source_size <= level * weight),
goal AS (
  SELECT l.source, l.source_size, l.rank,
         least(2.0::DOUBLE * l.source_size, coalesce(f.level * l.weight, 2.0::DOUBLE * l.source_size))::DOUBLE AS target
  FROM levels l CROSS JOIN free f),
bounds AS (
  SELECT *, coalesce(lag(upto) OVER (ORDER BY rank), 0) AS low, max(upto) OVER () AS total
  FROM (SELECT *, sum(target) OVER (ORDER BY rank) AS upto FROM goal)),
slots AS (
  SELECT slot, ((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) - floor((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS point
  FROM range((SELECT coalesce(ceil(max(total) / 128), 0)::BIGINT FROM bounds)) t(slot)),
supplied AS (
  SELECT b.rank, 128 * count(*) AS words FROM slots s JOIN bounds b ON s.point * b.total >= b.low AND s.point * b.total < b.upto GROUP BY b.rank),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 'mix', doc_id::VARCHAR)), doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes)
SELECT p.doc_id, p.size::BIGINT AS size, b.source_size::BIGINT AS source_size, b.target,
       (greatest(0, least(p.size, coalesce(u.words, 0) - p.start))
        + greatest(0, least(p.size, coalesce(u.words, 0) - b.source_size - p.start)))::BIGINT AS taken
FROM placed p JOIN bounds b ON p.source IS NOT DISTINCT FROM b.source LEFT JOIN supplied u ON u.rank = b.rank
""",
}

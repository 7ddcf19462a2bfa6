"""The queries opN_<name>, each an operator with production parameters over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hamming, html, langid, quality, warc
from .jaccard import ngram_jaccard_join
from .packing import pack
from .pii import find_pii
from .tokens import token_counts, vocabulary


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_read(spark, sf_dir, "documents"), n=3, num=90)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents selected: those that are of the highest grade with a probability of at least a half."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.select("doc_id", quality.grade_of().alias("grade")))
    return quality.select(quality.rate(docs, model))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses in files of gzip members, which are read again for what is derived."""
    files = warc.archives(warc.responses(_read(spark, sf_dir, "pages")))
    made = warc.derivatives(files, None, "content", warc.PAGE)
    return made.withColumn("record_sha256", F.sha2("record", 256)).withColumnRenamed("source_id", "page_id").drop("record")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.languages(docs, langid.train(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.links(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_best_fit_packing, op3_quality_classifier, op4_html_extraction, op5_warc_derivatives, op6_pii, op7_token_counts, op8_language_id, op9_decontamination, op10_embedding_near_dedup)
}

#: Words between blanks, their distinct runs of three, pairs by common runs, and what links reach.
SQL = {
    "op1_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
      g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (m + n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
      r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), t AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
      SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(t.b, s.doc_id)) AS component_id,
      CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY list_sort(s.s)) END AS class_id FROM s LEFT JOIN t ON s.doc_id = t.a""",
}

"""The queries of this subpackage: one per operator, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, burst_trie, line_dedup, maxent_lm, minhash, packing, periodic_runs, projection_dedup, quality_rules, sql, substring_dedup, toxicity, url_filter
from .common import save, table

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MIN_SITES = 10


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of its id, as far as there is one."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.col("quality") == 0).alias("bad"))
    found = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = line_dedup.remove_boilerplate(docs, MIN_SITES)
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder != 2)
    found = toxicity.score(docs, toxicity.learn(docs, labels), "doc_id")
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    held_out = F.coalesce(remainder == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (~held_out).alias("train"))
    found = maxent_lm.score_texts(docs, domain="lang")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, report = ann.neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))
    return found.withColumn("held_out_recall", F.lit(report["held_out"]))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of sequences used and the bound that certifies it, the same in every row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    packed = save(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "packed-documents")
    used, bound = packing.certify(packed)
    return packed.withColumns({"sequences": F.lit(used).cast("long"), "bound": F.lit(bound).cast("long")})


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes, members = burst_trie.prefix_trie(*burst_trie.rebuilt(turns))
    found = nodes.join(burst_trie.ends_digests(members), "ends", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(burst_trie.EMPTY)).alias("ends_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=True)
    exponent = F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("long")
    digests = [F.sha2(F.col("runs_text"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")]
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), *digests)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_url_filter, op4_line_dedup, op5_toxicity, op6_maxent_lm, op7_quality, op8_ann, op9_packing, op10_minhash, op11_projection_dedup, op12_burst_trie, op13_periodic_runs)}
SQL: dict[str, str] = {"op3_url_filter": sql.OP3, "op4_line_dedup": sql.OP4, "op7_quality": sql.OP7}

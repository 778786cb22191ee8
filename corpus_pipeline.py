"""A corpus pipeline of five operators: toxicity, line dedup, near duplicates, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of ``documents``,
the last one the packed pieces.

Defined cases: null and empty texts are no copies of each other, lose nothing and are packed as an end alone; of near copies
the one with the smallest id stays, with all rows that repeat its id and text; other rows without an id go where a copy has
one, else stay; rows that share an id but not their text are judged each; texts are taken whole; empty tables give empty
tables; further columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbquarry.llm import line_dedup, minhash, packing, substring_dedup, toxicity
from kbquarry.llm.common import save, table
from kbquarry.llm.queries import MIN_SITES

REJECT_AT = 0.3


def _boxed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all others under names of their own, which can't clash with operators' names."""
    return docs.select("doc_id", "text", *(["source"] if "source" in docs.columns else []), *[F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns) if c != "text"])


def _own(docs: DataFrame) -> list[str]:
    return [f"own_{i}" for i, c in enumerate(docs.columns) if c != "text"]


def _unboxed(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new.get(c, F.col(f"own_{i}") if c != "text" else text).alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    scored = toxicity.score(_boxed(docs), toxicity.learn(docs, labels), "text", *_own(docs)).where(F.col("score") < REJECT_AT)
    return scored.select(*[F.col("text") if c == "text" else F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unboxed(line_dedup.remove_boilerplate(_boxed(docs), MIN_SITES), docs, F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("r1", "r2").distinct()
    r1, r2 = minhash.row_key()
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), r1, r2)
    return keyed.join(gone, ["r1", "r2"], "left_anti").select("doc.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_boxed(docs), keep=("text", *_own(docs)))
    return _unboxed(kept, docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL expresses neither the learned lexicon nor packing: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Gaps of search hops and of results (G rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import keep_one


def hop_flag(confidence: Column, n_edges: Column) -> Column:
    """G1: low confidence first, then no relationships; null if neither"""
    return F.when(confidence < 0.4, "low_confidence").when(n_edges == 0, "orphan_entity")


def orphan_gaps(hops: DataFrame) -> DataFrame:
    """One low gap for each hop that is flagged orphan"""
    return hops.where("flag = 'orphan_entity'").select("qid", "entity_id", F.lit("orphan_entity").alias("gap_type"), F.lit("low").alias("severity"))


def ambiguous_gaps(hops: DataFrame, least_score: float = 0.7, least_overlap: float = 0.6) -> DataFrame:
    """Pairs of a question's well-scored hops with much the same name words.  Pairs come from a shared word, so that
    hops without one never meet."""
    names = F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != ""))
    good = hops.where(F.col("score") > least_score).select("qid", "entity_id", names.alias("words"))
    words = good.select("qid", "entity_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    a, b = (words.select("qid", "word", F.col("entity_id").alias(c), F.col("n").alias("n" + c)) for c in "ab")
    shared = a.join(b, ["qid", "word"]).where("a < b").groupBy("qid", "a", "b", "na", "nb").agg(F.count("*").alias("both"))
    return shared.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) > least_overlap).select("qid", "a", "b")


def broken_relationship_gaps(hops: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities reached through a relationship (hop > 0) that have no description"""
    bare = entities.where(F.trim(F.coalesce("description", F.lit(""))) == "").select("entity_id")
    return hops.where("hop > 0").join(bare, "entity_id", "left_semi").select("qid", "entity_id", F.lit("medium").alias("severity"))


def report_gaps(gaps: DataFrame, most: int = 20) -> DataFrame:
    """One gap for each type, entity and first 60 characters of the description, gravest first"""
    key = F.concat_ws(":", "gap_type", "entity_id", F.substring("description", 1, 60))
    grade = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    one = keep_one(gaps.withColumns({"key": key, "grade": grade}), ["key"], [F.col("grade"), F.col("qid")])
    return one.orderBy("grade", "key").limit(most).select("key", "severity")


def gap_cards(hops: DataFrame, gaps: DataFrame, names: int = 5) -> DataFrame:
    """For each question with a gap the names of its first hops and what its first gap type suggests"""
    first = gaps.groupBy("qid").agg(F.min("gap_type").alias("gap_type"))
    shown = hops.where(F.col("rank") < names).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("names"))
    action = F.when(F.col("gap_type") == "missing_entity", "add a document").when(F.col("gap_type") == "orphan_entity", "link the entity").otherwise("review the entity")
    return first.join(shown, "qid", "left").select("qid", "gap_type", F.coalesce("names", F.lit("")).alias("names"), action.alias("action"))

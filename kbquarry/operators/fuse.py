"""Fusion, score adjustment and diversity (R5-R17), gaps (G rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import cap_share, keep_one, top_k

METHODS = ["vector", "keyword", "graph"]


def union_methods(**lists: DataFrame) -> DataFrame:
    """Qid, entity_id, rank, score, method"""
    parts = [df.select("qid", "entity_id", F.col("rank").cast("int").alias("rank"), "score", F.lit(m).alias("method")) for m, df in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def rrf(candidates: DataFrame, k: int = 60, graph: DataFrame | None = None) -> DataFrame:
    """Fused score as a share of the question's best, found_by and matched_by; with ``graph`` (qid, entity_id, hop,
    rel_from, rel_type) also how the graph reached those that aren't seeds (else null)"""
    order = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    found = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), "method"))), lambda x: x["method"]), ",")
    rows = candidates.groupBy("qid", "entity_id").agg(
        F.sum(1 / (k + F.col("rank"))).alias("raw"), found.alias("found_by"), F.max_by("method", F.struct("score", -order)).alias("matched_by"), F.max(F.when(F.col("method") == "vector", F.col("score"))).alias("cosine")
    )
    rows = rows.withColumn("fused", F.col("raw") / F.max("raw").over(Window.partitionBy("qid")))
    if graph is None:
        return rows
    return rows.join(graph.where("hop > 0").select("qid", "entity_id", "hop", "rel_from", "rel_type"), ["qid", "entity_id"], "left")


def fuse(rows: DataFrame, boost: Column, blend: float = 0.3) -> DataFrame:
    """Layer boost, then the cosine share for rows of the vector list only"""
    s = F.col("fused") * F.coalesce(boost, F.lit(1.0))
    return rows.withColumn("score", F.when(F.col("cosine").isNotNull(), (1 - blend) * s + blend * F.col("cosine")).otherwise(s))


def adjust_scores(rows: DataFrame, confidence: str = "confidence", edges: str = "n_edges", docs: str = "n_docs", weight: float = 0.3) -> DataFrame:
    """Rows at or over least + 0.15 of the range; equal scores count as a range of 1, so that none is"""
    w = Window.partitionBy("qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    cutoff = lo + 0.15 * F.when(hi > lo, hi - lo).otherwise(1.0)
    up = F.col("score") * F.pow(0.5 + 0.5 * F.col(confidence), F.lit(weight))
    up = up * F.when(F.col(edges) > 0, 1 + 0.03 * F.log1p(F.col(edges))).otherwise(1.0) * F.when(F.col(docs) > 0, 1 + 0.02 * F.log1p(F.col(docs))).otherwise(1.0)
    return rows.withColumn("_cut", cutoff).withColumn("score", F.when(F.col("score") >= F.col("_cut"), up).otherwise(F.col("score"))).drop("_cut")


def dedup_exact(rows: DataFrame) -> DataFrame:
    """R9"""
    return keep_one(rows, ["qid", "entity_id"], [F.desc("score")])


def dedup_inverse(rows: DataFrame) -> DataFrame:
    """One row of each unordered (entity, rel_from); those without rel_from stay"""
    pair = F.when(F.col("rel_from").isNotNull(), F.concat_ws("|", F.least("entity_id", "rel_from"), F.greatest("entity_id", "rel_from"))).otherwise(F.concat(F.lit("="), F.col("entity_id")))
    return keep_one(rows.withColumn("_pair", pair), ["qid", "_pair"], [F.desc("score"), F.col("entity_id")]).drop("_pair")


def cap_types(rows: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Not where the question lists or compares"""
    return cap_share(rows, "qid", "entity_type", ratio, [F.desc("score"), F.col("entity_id")], F.col("is_listing") | F.col("is_comparison"))


def diversify(rows: DataFrame, k: int = 15, type_ratio: float = 0.5, layer_ratio: float = 0.6) -> DataFrame:
    """``rows`` (qid, entity_id, score, entity_type, layer, is_listing, is_comparison); layers aren't capped where the
    question lists"""
    order = [F.desc("score"), F.col("entity_id")]
    kept = cap_share(cap_types(rows, type_ratio), "qid", "layer", layer_ratio, order, F.col("is_listing"))
    return top_k(kept, ["qid"], order, k, "pos")


def vanilla_merge(vector: DataFrame, keyword: DataFrame, k: int = 15) -> DataFrame:
    """The mean of both scores, or the single one"""
    v, w = vector.select("qid", "entity_id", F.col("score").alias("a")), keyword.select("qid", "entity_id", F.col("score").alias("b"))
    both = v.join(w, ["qid", "entity_id"], "full").withColumn("score", F.round(F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2), 6))
    return top_k(both, ["qid"], [F.desc("score"), F.col("entity_id")], k)


def merge_subqueries(scored: DataFrame) -> DataFrame:
    """(qid, sub, entity_id, score)"""
    share = scored.withColumn("s", F.col("score") / F.max("score").over(Window.partitionBy("qid", "sub")))
    return share.groupBy("qid", "entity_id").agg(F.least(F.lit(1.0), F.avg("s") + 0.15 * (F.count("*") - 1)).alias("score"), F.count("*").alias("hits"))


def hop_gaps(hops: DataFrame) -> DataFrame:
    """(qid, entity_id, confidence, n_edges, hop)"""
    low = hops.where((F.col("confidence") < 0.4) & (F.col("hop") <= 1)).select("qid", "entity_id", F.lit("low_confidence_hub").alias("gap_type"), F.lit("high").alias("severity"))
    orphan = hops.where((F.col("confidence") >= 0.4) & (F.col("n_edges") == 0)).select("qid", "entity_id", F.lit("orphan_entity").alias("gap_type"), F.lit("low").alias("severity"))
    return low.unionByName(orphan)


def funnel(candidates: DataFrame, selected: DataFrame, entities: DataFrame, gaps: DataFrame) -> DataFrame:
    """What is left of each question's rows after each stage, with the selected bodies' tokens and the gaps"""
    counts = [F.count_if(F.col("method") == m).alias(f"n_{m}") for m in METHODS]
    found = candidates.groupBy("qid").agg(*counts, F.count("*").alias("n_candidates"), F.count_distinct("entity_id").alias("n_fused"))
    sizes = entities.select("entity_id", F.floor(F.length("body") / 4).alias("tokens"))
    kept = selected.select("qid", "entity_id").join(sizes, "entity_id").groupBy("qid").agg(F.count("*").alias("n_selected"), F.sum("tokens").cast("long").alias("tokens"))
    noted = gaps.groupBy("qid").agg(F.count("*").alias("n_gaps"))
    return found.join(kept, "qid").join(noted, "qid", "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))

"""Context packs as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save
from .backend import RetrievalConfig
from .windows import budget_share, interleave, take_until_budget


def first_relations(edges: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """entity_id, relations: the first targets of each entity by (rel_type, target), by name where it is known.  The
    window keeps a few rows of a hub in each partition before it shuffles."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("rel_type", "target_id"))
    few = edges.select("source_id", "rel_type", "target_id").distinct().withColumn("p", place).where(F.col("p") <= most)
    named = few.join(names.select(F.col("entity_id").alias("target_id"), "name"), "target_id", "left")
    line = F.concat(F.lit("  "), "rel_type", F.lit(" → "), F.coalesce("name", "target_id"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p", line.alias("line")))), lambda x: x["line"])
    return named.groupBy(F.col("source_id").alias("entity_id")).agg(F.array_join(lines, "\n").alias("relations"))


def pack_blocks(hops: DataFrame, entities: DataFrame, relations: DataFrame, config: RetrievalConfig = RetrievalConfig(), most: int = 1_000_000) -> DataFrame:
    """R14 by block: ``hops`` (qid, entity_id, score, layer, priority) -> qid, entity_id, pos, block.  Layers take turns, by
    priority; a body gets a share of the budget by score and is cut at its last line end; blocks follow until the first
    that overflows.  ``entities``: entity_id, name, entity_type, confidence, description, source, body; ``relations``:
    entity_id, relations.  Up to ``most`` hops go to every task, so that bodies which no hop names are never shuffled."""
    rows = interleave(hops, "qid", "layer", [F.desc("score"), F.col("entity_id")], [F.desc("priority"), F.col("layer")])
    rows = budget_share(rows, "qid", "score", config.token_budget, config.least_share, config.most_share)
    places = save(rows.select("qid", "entity_id", "pos", "share").join(relations, "entity_id", "left"), "places")
    few = F.broadcast(places) if places.count() <= most else places
    rows = entities.select("entity_id", "name", "entity_type", "confidence", "description", "source", "body").join(few, "entity_id")
    bare = F.btrim(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?s)\n##\s*Open Questions.*$", ""), F.lit(" \t\n\r\x0b\x0c"))
    rows = rows.withColumn("bare", bare).withColumn("room", (4 * F.col("share")).cast("int"))
    cut = F.concat(F.regexp_replace(F.substring(F.col("bare"), F.lit(1), F.col("room")), r"\n[^\n]*\z", ""), F.lit("\n[...]"))
    head = F.concat(F.lit("Entity: "), "name", F.lit(" ("), "entity_type", F.lit(", confidence: "), F.round(100 * F.col("confidence")).cast("int"), F.lit("%)\nDescription: "), F.coalesce("description", F.lit("")), F.lit("\n"))
    rel = F.coalesce(F.concat(F.lit("Relationships:\n"), "relations", F.lit("\n")), F.lit(""))
    source = F.coalesce(F.concat(F.lit("Source: "), "source", F.lit("\n")), F.lit(""))
    body = F.when(F.col("bare") == "", "").otherwise(F.concat(F.lit("\n"), F.when(F.length("bare") > F.col("room"), cut).otherwise(F.col("bare")), F.lit("\n")))
    blocks = rows.select("qid", "entity_id", "pos", F.concat(head, rel, source, body).alias("block"))
    blocks = blocks.withColumn("tokens", F.floor(F.length("block") / 4))
    return take_until_budget(blocks, ["qid"], [F.col("pos")], "tokens", config.token_budget).select("qid", "entity_id", "pos", "block")


def context_text(blocks: DataFrame) -> DataFrame:
    """qid, context, blocks: a question's blocks, some dozens at most by the budget, as one text, and how many they are"""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"])
    return blocks.groupBy("qid").agg(F.array_join(ordered, "\n---\n").alias("context"), F.count("*").alias("blocks"))

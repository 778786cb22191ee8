"""Mentions as a row of facts each: an order-free form of the merge of mentions (M1), whose fold may be split at will."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = ["entity_type", "entity_id"]
#: Of facts with an order the first stays (the last mention's order is negated); of items with one key (kind, k1, k2) the first by the rest.
LAST, FIRST, KEY = ["name", "status", "tags"], ["description", "body"], ["kind", "k1", "k2"]
_ITEMS = "array<struct<kind:string,k1:string,k2:string,o1:bigint,o2:bigint,v1:string,v2:string>>"
SCHEMA = "entity_type string, entity_id {id}, " + ", ".join(f"{c} struct<o:bigint,v:string>" for c in (*LAST, *FIRST)) + f", confidence double, n_mentions long, items {_ITEMS}"


def mention_facts(mentions: DataFrame) -> DataFrame:
    """A row a mention: what it says as the last one and as the first, and as items its source, targets and further details
    with their place."""
    pos, none = F.col("pos").cast("long"), F.lit(None).cast("string")

    def item(kind: str, k1: Column, k2: Column = F.lit(""), o2: Column = F.lit(0), v1: Column = none, v2: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), k1.cast("string").alias("k1"), k2.cast("string").alias("k2"), pos.alias("o1"), o2.cast("long").alias("o2"), v1.cast("string").alias("v1"), v2.cast("string").alias("v2"))

    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    nothing = F.array().cast(_ITEMS)
    maybe = lambda test, f: F.when(test, F.array(f)).otherwise(nothing)
    said = lambda c, o: F.struct(o.alias("o"), F.col(c).cast("string").alias("v"))
    edges = F.flatten(F.transform(F.map_entries("relationships"), lambda e: F.transform(e["value"], lambda v, i: item("relation", e["key"], v, i))))
    items = F.concat(maybe(F.col("source").isNotNull(), item("source", F.col("source"))), maybe(some("details"), item("details", pos, v1=F.col("source"), v2=F.col("details"))), F.coalesce(edges, nothing))
    return mentions.select(
        *ENTITY, *[said(c, -pos).alias(c) for c in LAST], F.when(some("description"), said("description", pos)).alias("description"), said("body", pos).alias("body"),
        F.col("confidence").cast("double").alias("confidence"), F.lit(1).cast("long").alias("n_mentions"), items.alias("items"),
    )


def _folded() -> list[Column]:
    return [F.min(c).alias(c) for c in (*LAST, *FIRST)] + [F.max("confidence").alias("confidence"), F.sum("n_mentions").alias("n_mentions")]


def fold_facts(facts: DataFrame) -> DataFrame:
    """One row an entity.  Items of one key meet before an entity gathers its own, so that it holds what its merged row does,
    however many mentions say the same."""
    key = [F.col(f"x.{c}").alias(c) for c in KEY]
    firsts = facts.select(*ENTITY, F.explode("items").alias("x")).groupBy(*ENTITY, *key).agg(F.min(F.struct("x.o1", "x.o2", "x.v1", "x.v2")).alias("b"))
    rows = facts.drop("items").unionByName(firsts.select(*ENTITY, F.struct(*KEY, "b.*").alias("item")), allowMissingColumns=True)
    return rows.groupBy(*ENTITY).agg(*_folded(), F.collect_list("item").alias("items"))


def merge_facts(folded: DataFrame) -> DataFrame:
    """fold_facts() of rows that are folded already, a few an entity: their items are merged within the row"""
    rows = folded.groupBy(*ENTITY).agg(*_folded(), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    key = lambda x: F.struct(*[x[c] for c in KEY])
    first = lambda x, i: (i == 0) | ~key(x).eqNullSafe(key(F.get(F.col("items"), i - 1)))
    return rows.withColumn("items", F.filter("items", first))


def entities_of(folded: DataFrame) -> DataFrame:
    """The entities of folded facts"""
    in_order = lambda kind, *cols: F.array_sort(F.transform(F.filter("items", lambda x: x["kind"] == kind), lambda x: F.struct(*[x[c].alias(c) for c in ("o1", "o2", *cols)])))
    rows = folded.withColumns({"sources": in_order("source", "k1"), "edges": in_order("relation", "k1", "k2"), "details": in_order("details", "v1", "v2")})
    kinds = F.array_sort(F.array_distinct(F.transform("edges", lambda e: e["k1"])))
    targets = F.transform(kinds, lambda k: F.struct(k, F.transform(F.filter("edges", lambda e: e["k1"] == k), lambda e: e["k2"])))
    section = lambda d: F.concat(F.lit("\n\n## Additional Details\n[from "), F.coalesce(d["v1"], F.lit("")), F.lit("]\n\n"), d["v2"])
    more = F.array_join(F.transform(F.filter("details", lambda d: d["o1"] > F.col("body.o")), section), "")
    return rows.select(
        *ENTITY, *[F.col(f"{c}.v").alias(c) for c in ("name", "status", "description")], "confidence", F.col("tags.v").alias("tags"), F.concat(F.rtrim(F.coalesce("body.v", F.lit(""))), more).alias("body"), "n_mentions",
        F.array_join(F.transform("sources", lambda s: s["k1"]), ",").alias("sources"), F.when(F.size("edges") > 0, F.map_from_entries(targets)).alias("relationships"),
    )

"""Packs of a knowledge base as text under a budget (W11, S14, A12), in one plan whatever the number of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import numbered, running


def layered_budget(df: DataFrame, layers: list[str], order: list[Column], size: str, budget: int, used: int = 0) -> DataFrame:
    """Rows of ``df`` (layer, ``size``) that fit, with ``running``, the total within their layer.  Layers in a fixed order
    share one budget, of which ``used`` is gone; a layer stops at its first overflow and the next still try.

    A running sum over (layer, order) is taken by a distributed scan.  Where a layer stops depends on the totals at which its
    rows end, as far as they are within the budget: whole numbers, so ``budget`` of them a layer at most, whatever the table.
    They are folded layer by layer in one expression, and the cuts (a row a layer) go back to the rows.

    Defined cases: a null size counts as 0; a row of another layer is left out; equal rows of the order are taken in any
    order; an empty table gives an empty table."""
    place = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    rows = df.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("_layer", place).where(F.col("_layer") > 0)
    rows = running(rows, F.col("_size"), "_layer", *order, name="_total")
    base = rows.groupBy("_layer").agg(F.min(F.col("_total") - F.col("_size")).alias("_base"))  # a row a layer
    rows = rows.join(F.broadcast(base), "_layer").withColumn("running", F.col("_total") - F.col("_base"))
    ends = rows.where(F.col("running") <= budget).groupBy("_layer").agg(F.collect_set("running").alias("ends"))
    every = ends.agg(F.array_sort(F.collect_list(F.struct("_layer", "ends"))).alias("every"))

    def fit(state: Column, layer: Column) -> Column:
        room = F.coalesce(F.array_max(F.filter(layer["ends"], lambda e: e <= state["left"])), F.lit(-1).cast("long"))
        cut = F.struct(layer["_layer"].alias("_layer"), room.alias("cut"))
        return F.struct((state["left"] - F.greatest(room, F.lit(0))).alias("left"), F.concat(state["cuts"], F.array(cut)).alias("cuts"))

    nothing = F.array().cast("array<struct<_layer:bigint,cut:bigint>>")
    start = F.struct(F.lit(budget - used).cast("long").alias("left"), nothing.alias("cuts"))
    cuts = every.select(F.explode(F.aggregate("every", start, fit)["cuts"]).alias("c")).select("c.*")
    return rows.join(F.broadcast(cuts), "_layer").where(F.col("running") <= F.col("cut")).drop("_layer", "_size", "_total", "_base", "cut")


def entity_lines(relations: str = "relations", overview: str = "overview") -> Column:
    """The lines of one entity in a pack: heading, type and confidence, description, overview and relationships as far as there
    are any, each part but the first three followed by an empty line."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    head = F.array(F.concat(F.lit("### "), F.coalesce("name", "entity_id")), F.concat(F.lit("*"), F.coalesce("entity_type", F.lit("")), F.lit("* | confidence: "), F.col("confidence").cast("string")))
    told = F.when(some("description"), F.array(F.concat(F.lit("> "), "description"))).otherwise(F.array().cast("array<string>"))
    more = F.when(some(overview), F.array(F.col(overview), F.lit(""))).otherwise(F.array().cast("array<string>"))
    edges = F.when(F.size(F.coalesce(F.col(relations), F.array().cast("array<string>"))) > 0, F.concat(F.transform(relations, lambda r: F.concat(F.lit("- "), r)), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, told, F.array(F.lit("")), more, edges)


def _length(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, line: n + F.length(line))


def title_case(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("-"), F.lit(" ")))


def export_pack(entities: DataFrame, title: str, layers: list[str], max_tokens: int | None = None, note: str = "") -> DataFrame:
    """Section, place, layer, entity_id, text.  The texts in the order of (section, place), joined by line ends, are the
    pack: a title and summary (section 0), then the layers in their order, each sorted by confidence and name and cut at what
    is left of the budget, with a line that counts what is missing.  Sizes count characters without line ends and without the
    layers' headings; the count starts at the summary lines.  ``entities``: entity_id (string), name, entity_type, layer,
    confidence, description, overview, relations (array of "label: target")."""
    known = entities.where(F.col("layer").isin(layers)).withColumn("lines", entity_lines()).withColumn("size", _length(F.col("lines")))
    kinds = entities.groupBy("entity_type").agg(F.count("*").alias("n"))  # a row a type
    first = kinds.agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "entity_type", "n"))).alias("all")).where("n > 0")
    told = F.concat(F.lit("> "), F.col("n").cast("string"), F.lit(" entities across "), F.col("kinds").cast("string"), F.lit(" types."), F.lit(note))
    listed = F.transform("all", lambda k: F.concat(F.lit("- **"), title_case(k["entity_type"]), F.lit("** ("), k["n"].cast("string"), F.lit(")")))
    lines = F.concat(F.array(F.lit(f"# {title}"), F.lit(""), told, F.lit(""), F.lit("## Entity Types"), F.lit("")), listed, F.array(F.lit("")))
    summary = first.select(lines.alias("lines"))
    order = [F.desc("confidence"), F.col("name"), F.col("entity_id")]
    kept = known
    if max_tokens is not None:
        head = summary.select(_length(F.col("lines")).alias("n")).first()
        kept = layered_budget(known, layers, order, "size", 4 * max_tokens, used=int(head["n"]) if head else 0)
    at = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    body = numbered(kept.withColumn("section", at.cast("int")), "section", *order).select("section", (F.col("place") + 1).alias("place"), "layer", "entity_id", F.array_join("lines", "\n").alias("text"))
    counts = known.groupBy("layer").agg(F.count("*").alias("n")).join(kept.groupBy("layer").agg(F.count("*").alias("kept")), "layer", "left").withColumn("missing", F.col("n") - F.coalesce("kept", F.lit(0)))
    none, big = F.lit(None).cast("string"), (1 << 62)
    heads = counts.select(at.cast("int").alias("section"), F.lit(0).cast("long").alias("place"), "layer", none.alias("entity_id"), F.concat(F.lit("## "), title_case(F.col("layer")), F.lit(" Layer\n")).alias("text"))
    cuts = counts.where("missing > 0").select(at.cast("int").alias("section"), F.lit(big).cast("long").alias("place"), "layer", none.alias("entity_id"), F.concat(F.lit("*("), F.col("missing").cast("string"), F.lit(" more entities truncated due to token budget)*")).alias("text"))
    start = summary.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), none.alias("layer"), none.alias("entity_id"), F.array_join("lines", "\n").alias("text"))
    return start.unionByName(heads).unionByName(body).unionByName(cuts)


def pack_stats(pack: DataFrame) -> DataFrame:
    """Layer (null: the whole pack), entities, chars, tokens, truncated (entities left out); characters with line ends"""
    missing = F.when(F.col("entity_id").isNull(), F.try_to_number(F.regexp_extract("text", r"^\*\((\d+) more entities", 1), F.lit("9999999999"))).cast("long")
    rows = pack.withColumns({"chars": F.length("text") + 1, "missing": missing})
    out = rows.rollup("layer").agg(F.count("entity_id").alias("entities"), F.sum("chars").alias("chars"), F.coalesce(F.sum("missing"), F.lit(0)).alias("truncated"), F.grouping("layer").alias("all"))
    out = out.where("layer is not null or all = 1").withColumn("chars", F.col("chars") - F.col("all"))
    return out.select("layer", "entities", "chars", F.floor(F.col("chars") / 4).alias("tokens"), "truncated")

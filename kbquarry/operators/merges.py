"""Merge verdicts in their order (M5, M6): who is gone when, who survives, and what the survivor takes over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save


def settle_verdicts(entities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts`` (pos, a, b, action, keep_id) -> the same and loser, winner, status: 'merged', 'skipped' (one of the two is gone,
    or was never there) or 'kept' (no merge asked).  b survives where keep_id names it, else a.

    A verdict can be settled when no earlier unsettled one might remove one of its two, so a round settles all of these at
    once; a survivor of many merges takes one round, a chain in which each survivor goes next takes one a link.

    Defined cases: a verdict of an entity with itself is skipped; equal positions are ordered by a and b; an empty table
    gives an empty table."""
    known = entities.select("entity_id").distinct()
    rows = verdicts.select("pos", "a", "b", "action", "keep_id").withColumn("merge", F.coalesce(F.col("action") == "merge", F.lit(False)))
    b_stays = F.col("keep_id").eqNullSafe(F.col("b"))
    rows = rows.withColumns({"winner": F.when(b_stays, F.col("b")).otherwise(F.col("a")), "loser": F.when(b_stays, F.col("a")).otherwise(F.col("b")), "at": F.struct("pos", "a", "b")})
    for side in "ab":
        rows = rows.join(known.select(F.col("entity_id").alias(side), F.lit(True).alias(f"has_{side}")), side, "left")
    fits = F.col("has_a") & F.col("has_b") & (F.col("a") != F.col("b"))
    rows = save(rows.withColumn("open", F.coalesce(F.col("merge") & fits, F.lit(False))), "verdicts")
    live, done = save(rows.where("open").select("at", "loser", "winner"), "open-verdicts"), []
    while not live.isEmpty():
        first = live.groupBy(F.col("loser").alias("id")).agg(F.min("at").alias("first"))  # when an entity may first go
        seen = live
        for side in ("loser", "winner"):
            seen = seen.join(first.select(F.col("id").alias(side), F.col("first").alias(f"first_{side}")), side, "left")
        ready = (F.col("first_loser") == F.col("at")) & (F.col("first_winner").isNull() | (F.col("first_winner") > F.col("at")))
        merged = save(seen.where(ready).select("at", "loser", "winner"), "merged")
        done.append(merged)
        gone = merged.select(F.col("loser").alias("gone"), F.col("at").alias("when"))
        rest = live.join(merged.select("at"), "at", "left_anti")
        for side in ("loser", "winner"):  # later verdicts of who is gone are skipped
            rest = rest.join(gone, [F.col(side) == F.col("gone"), F.col("at") > F.col("when")], "left_anti")
        live = save(rest, "open-verdicts")
    if not done:
        return rows.select("pos", "a", "b", "action", "keep_id", "loser", "winner", F.when(F.col("merge"), "skipped").otherwise("kept").alias("status"))
    merged = done[0]
    for more in done[1:]:
        merged = merged.unionByName(more)
    rows = rows.join(merged.select("at", F.lit(True).alias("done")), "at", "left")
    status = F.when(F.col("done"), "merged").when(F.col("merge"), "skipped").otherwise("kept")
    return rows.select("pos", "a", "b", "action", "keep_id", "loser", "winner", status.alias("status"))


def survivors(settled: DataFrame) -> DataFrame:
    """entity_id, keep, path of every entity that is gone: the survivor at the end of its chain of merges, and the positions of
    the merges on the way, the last first.  Chains are followed by pointer jumping: as many rounds as the logarithm of the
    longest."""
    at = save(settled.where("status = 'merged'").select(F.col("loser").alias("entity_id"), F.col("winner").alias("keep"), F.array("pos").alias("path")), "survivors")
    while True:
        onward = at.select(F.col("entity_id").alias("keep"), F.col("keep").alias("next"), F.col("path").alias("above"))
        moved = at.join(onward, "keep", "left")
        if moved.where("next is not null").isEmpty():
            return at
        at = save(moved.select("entity_id", F.coalesce("next", "keep").alias("keep"), F.concat(F.coalesce("above", F.array().cast(at.schema["path"].dataType)), "path").alias("path")), "survivors")


def apply_merges(entities: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: (entities after the merges, log).  ``entities``: entity_id, name, confidence, source_documents, relationships
    (map<string, array<string>>), body.  A survivor keeps its name, takes the greatest confidence (0.5 where one is
    missing), the sorted union of sources, further targets of each relationship behind its own, and below its body those
    of the merged ones, each under a heading with its name unless it is empty or the text before holds it.  What was
    merged into an entity moves on with it, in the order of the merges.  ``log`` is settle_verdicts()."""
    log = save(settle_verdicts(entities, verdicts), "merge-log")
    gone = survivors(log)
    path = F.coalesce("path", F.array().cast(gone.schema["path"].dataType))
    rows = save(entities.join(gone, "entity_id", "left").withColumns({"keep": F.coalesce("keep", "entity_id"), "path": path}), "merging")
    lists = rows.select("keep", "path", F.explode("relationships").alias("rel", "targets")).select("keep", "path", "rel", F.posexplode("targets").alias("p", "target"))
    firsts = lists.groupBy("keep", "rel", "target").agg(F.min(F.struct("path", "p")).alias("at"))
    by_rel = firsts.groupBy("keep", "rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "target"))), lambda x: x["target"]).alias("targets"))
    edges = by_rel.groupBy("keep").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "targets")))).alias("relationships"))
    sources = rows.select("keep", F.explode("source_documents").alias("s")).distinct().groupBy("keep").agg(F.sort_array(F.collect_list("s")).alias("source_documents"))
    own = F.trim(F.coalesce("body", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("path", own.alias("body"), F.coalesce("name", F.lit("")).alias("name"))))

    def add(text, part):
        new = F.concat(text, F.lit("\n\n## Additional Details (merged from "), part["name"], F.lit(")\n\n"), part["body"])
        return F.when((part["body"] == "") | F.contains(text, part["body"]), text).otherwise(new)

    body = F.aggregate(F.slice("parts", 2, 1 << 30), F.get("parts", F.lit(0))["body"], add)
    one = rows.groupBy("keep").agg(F.max(F.when(F.size("path") == 0, F.col("name"))).alias("name"), F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"), F.count("*").alias("members"), parts.alias("parts")).withColumn("body", body).drop("parts")
    return one.join(sources, "keep", "left").join(edges, "keep", "left").withColumnRenamed("keep", "entity_id"), log

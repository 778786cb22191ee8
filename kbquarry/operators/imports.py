"""Batches of entities that go into a table or wait beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import save

KEY = ["directory", "id"]


def import_outcomes(items: DataFrame, entities: DataFrame, on_conflict: str = "error") -> DataFrame:
    """``items`` (pos, directory, id, valid, and what else an entity has) -> these and prior_created_at, status, error.

    In the order of pos: an invalid item fails; one whose id an earlier item of the batch has created, replaced or skipped
    fails as a duplicate; one whose (directory, id) is there fails ('error'), is skipped or replaces it ('overwrite'); any
    other is created.  An item that failed as already there isn't counted for duplicates.  So of one id the first item
    that isn't refused decides: a minimum by id, no window.

    Defined cases: a null id is invalid; equal positions of one id all count as first; an empty batch gives no rows."""
    if on_conflict not in ("error", "skip", "overwrite"):
        raise ValueError("on_conflict is error, skip or overwrite")
    there = entities.select(*KEY, F.col("created_at").alias("prior_created_at"), F.lit(True).alias("there")).dropDuplicates(KEY)
    rows = items.join(there, KEY, "left").withColumn("there", F.coalesce("there", F.lit(False)))
    good = F.coalesce(F.col("valid"), F.lit(False)) & F.col("id").isNotNull()
    taken = good & ~(F.col("there") & F.lit(on_conflict == "error"))
    first = save(rows.where(taken).groupBy("id").agg(F.min("pos").alias("first")), "firsts")
    rows = rows.join(first, "id", "left")
    late, early = F.col("pos") > F.col("first"), F.col("first").isNull() | (F.col("pos") < F.col("first"))
    done = F.when(F.col("there"), "skipped" if on_conflict == "skip" else "updated").otherwise("created")
    status = F.when(~good | late | early, "failed").otherwise(done)
    error = F.when(~good, "invalid").when(late, F.concat(F.lit("duplicate id '"), "id", F.lit("' within this batch"))).when(early, F.concat(F.lit("entity '"), "id", F.lit("' already exists")))
    return rows.withColumns({"status": status, "error": error}).drop("first", "there")


def stamped(rows: DataFrame, now: Column, actor: str) -> DataFrame:
    """created_at of the prior row or now, updated_at and updated_by"""
    return rows.withColumns({"created_at": F.coalesce("prior_created_at", now), "updated_at": now, "updated_by": F.lit(actor)})


def bulk_import(items: DataFrame, entities: DataFrame, now: Column, on_conflict: str = "error", actor: str = "import") -> tuple[DataFrame, DataFrame, DataFrame]:
    """M4: (the table after, outcome by pos, events).  ``entities``: directory, id, created_at, updated_at, updated_by and columns
    that items have too.  Replaced rows keep their created_at; an event for each row created or updated."""
    outcome = save(import_outcomes(items, entities, on_conflict), "outcomes")
    written = stamped(outcome.where(F.col("status").isin("created", "updated")), now, actor)
    after = entities.join(written.select(*KEY), KEY, "left_anti").unionByName(written.select(*entities.columns))
    events = written.select(F.col("id").alias("entity_id"), "directory", F.col("status").alias("action"), F.lit(actor).alias("actor"), now.alias("at"), F.coalesce("name", "id").alias("summary"))
    return after, outcome.select("pos", "directory", "id", "status", "error"), events


def import_batch(table, items: DataFrame, number: int, now: Column, events_path: str, on_conflict: str = "error", actor: str = "import") -> DataFrame:
    """M4 into a KeyedTable with KEY: only the buckets of written rows are read again and written, the events go under the
    batch's number, and a batch that runs again sees the table as it was before it and changes nothing.  Returns the
    outcome."""
    before = table.read(before=number)
    outcome = save(import_outcomes(items, before, on_conflict), "outcomes")
    written = stamped(outcome.where(F.col("status").isin("created", "updated")), now, actor)
    table.upsert(written, number)
    events = written.select(F.col("id").alias("entity_id"), "directory", F.col("status").alias("action"), F.lit(actor).alias("actor"), now.alias("at"), F.coalesce("name", "id").alias("summary"))
    events.write.mode("overwrite").parquet(f"{events_path}/batch={number}")
    return outcome.select("pos", "directory", "id", "status", "error")


def stage_proposals(items: DataFrame, entities: DataFrame, now: Column, actor: str = "agent") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, outcome, events).  ``items`` (pos, id, update, valid, rationale, ...): a new entity must not be there, an
    update must, by id; both must be valid.  Proposals are stamped, an update with the entity's created_at, and of one id
    the last stays; every accepted item has an event, 'proposed' or 'proposed-update'.  The table isn't changed."""
    there = entities.groupBy("id").agg(F.min("created_at").alias("prior_created_at"), F.lit(True).alias("there"))
    rows = items.join(there, "id", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    good = F.coalesce(F.col("valid"), F.lit(False)) & F.col("id").isNotNull()
    update = F.coalesce(F.col("update"), F.lit(False))
    # an update is looked up before it is judged, a new entity is judged first
    error = F.when(update & ~F.col("there"), "does not exist").when(~good, "invalid").when(~update & F.col("there"), "already exists")
    rows = save(rows.withColumns({"error": error, "update": update}), "proposed")
    accepted = stamped(rows.where("error is null"), now, actor)
    rest = [c for c in accepted.columns if c not in ("id", "error", "there", "prior_created_at")]
    proposals = accepted.groupBy("id").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("id", "r.*")
    action = F.when(F.col("update"), "proposed-update").otherwise("proposed")
    summary = F.when(F.col("update"), F.coalesce(F.nullif("rationale", F.lit("")), F.concat(F.lit("update "), "id"))).otherwise(F.coalesce("name", "id"))
    events = accepted.select("pos", F.col("id").alias("entity_id"), action.alias("action"), F.lit(actor).alias("actor"), now.alias("at"), summary.alias("summary"))
    return proposals, rows.select("pos", "id", F.when(F.col("error").isNull(), action).otherwise("failed").alias("status"), "error"), events

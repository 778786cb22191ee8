"""Structured Streaming jobs (N rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mention_state import ENTITY, SCHEMA, entities_of, fold_facts, mention_facts, merge_facts
from ..scratch import scratch_path
from .efforts import FACTS, effort_facts, merge_facts as merge_efforts, rolled_up
from .tables import KeyedTable, latest


def event_counts(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by sliding window, action and actor, in update mode: a window's last row counts"""
    rows = events.withWatermark("at", late).groupBy(F.window("at", width, slide).alias("w"), "action", "actor").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "action", "actor", "n")


def dedup_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """N4"""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def gap_alerts(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """Stream-static left join"""
    return calls.join(entities, "entity_id", "left")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, into a table in the shared folder, and that table."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def keyed_available(stream: DataFrame, table: KeyedTable, shape: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "update") -> KeyedTable:
    """Everything that is there now, batch by batch into ``table``, whose checkpoint lies beside it: a run that is repeated goes
    on where the last one ended, and a batch that is repeated changes nothing."""
    sink = lambda batch, number: table.upsert(shape(batch), number)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{table.path}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return table


def event_count_table(events: DataFrame, path: str | None = None, **how) -> DataFrame:
    """N2 with early results: every window that has come so far, closed or not, with its latest count"""
    keys = ["start", "action", "actor"]
    table = KeyedTable(events.sparkSession, keys, "start timestamp, action string, actor string, n long", latest(keys, "n"), path)
    return keyed_available(event_counts(events, **how), table).read()


def effort_table(log: DataFrame, path: str | None = None, idle_minutes: int = 120, late: str = "1 hour") -> DataFrame:
    """N3 as a table: the latest roll-up of every effort.  Each batch is folded to a row of facts an effort, which are merged into the
    efforts' facts; timeouts follow from those and the watermark (the greatest time so far less ``late``) when the table is read, so a
    late call opens its effort again.  Late rows are held against the watermark before the last batch, as Spark's operators with state do."""
    spark, delay = log.sparkSession, F.expr(f"INTERVAL {late}")
    table = KeyedTable(spark, ["effort_id"], FACTS, merge_efforts, path)
    marks = KeyedTable(spark, ["k"], "k int, at timestamp", lambda df: df.groupBy("k").agg(F.max("at").alias("at")), f"{table.path}/marks", buckets=1)
    watermark = lambda df: F.broadcast(df.agg((F.max("at") - delay).alias("watermark")))

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.crossJoin(watermark(marks.read(before=number - 1))).where("watermark is null or at is null or at >= watermark")
        table.upsert(effort_facts(rows), number)
        marks.upsert(batch.select(F.lit(0).alias("k"), "at").groupBy("k").agg(F.max("at").alias("at")), number)

    log.writeStream.foreachBatch(sink).option("checkpointLocation", f"{table.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rolled_up(table.read().crossJoin(watermark(marks.read())), F.col("watermark"), idle_minutes)


def merge_stream(mentions: DataFrame, path: str | None = None) -> DataFrame:
    """Each batch of mentions is folded to a row an entity, which is merged into the entities' facts, of which only touched
    buckets are read and written; the entities are those that merge_mentions() makes of all mentions."""
    schema = SCHEMA.format(id=mentions.schema["entity_id"].dataType.simpleString())
    table = KeyedTable(mentions.sparkSession, ENTITY, schema, merge_facts, path)
    return entities_of(keyed_available(mentions, table, lambda batch: fold_facts(mention_facts(batch)), "append").read())

"""Incremental ingest of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import scratch_path


def current_state(spark, path: str, schema: str) -> DataFrame:
    """The last row of each document in a state log"""
    rows = spark.read.schema(schema + ", batch long").parquet(path)
    last = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("batch")))
    return rows.withColumn("r", last).where("r = 1").drop("r", "batch")


def ingest_stream(documents: DataFrame, process: Callable[[DataFrame], DataFrame], state: str | None = None) -> DataFrame:
    """Hands new and changed documents, and those that failed before, of a stream (filename, text) to ``process``, which
    gives filename and ok, and logs each outcome: filename, hash, status ('analyzed' or 'failed').  A batch that runs
    again replaces its own part of the log, so that it can be resumed.  Returns the state after all that is there now."""
    spark = documents.sparkSession
    state, schema = state or scratch_path(spark, "doc-state"), "filename string, hash string, status string"
    spark.createDataFrame([], schema + ", batch long").write.mode("append").parquet(f"{state}/log/part=none")
    read = lambda: current_state(spark, f"{state}/log/part=*", schema)

    def batch(rows: DataFrame, number: int) -> None:
        now = rows.select("filename", "text", X.content_hash(F.coalesce("text", F.lit(""))).alias("hash")).dropDuplicates(["filename"])
        before = read().select("filename", F.col("hash").alias("was"), F.col("status").alias("how"))
        todo = now.join(before, "filename", "left").where(~(F.col("hash").eqNullSafe(F.col("was")) & F.col("how").eqNullSafe("analyzed")))
        done = process(todo.select("filename", "text")).select("filename", "ok")
        out = todo.select("filename", "hash").join(done, "filename", "left")
        out = out.select("filename", "hash", F.when(F.coalesce("ok", F.lit(False)), "analyzed").otherwise("failed").alias("status"), F.lit(number).cast("long").alias("batch"))
        out.write.mode("overwrite").parquet(f"{state}/log/part={number}")

    documents.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read()

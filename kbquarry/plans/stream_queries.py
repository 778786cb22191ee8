"""Stream jobs over the events table, run with what is available; SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from . import adapters as A
from .kb_queries import mention_rows, merged_columns
from .registry import SQL, query


def stream(s, d):
    schema = A.table(s, d, "events").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[e]vents.parquet")
    return raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("action"))


@query("n4_dedup_stream", f"WITH {A.SQL_EVENTS} SELECT DISTINCT id, action FROM evt")
def n4(s, d):
    rows = stream(s, d)
    return jobs.run_available(jobs.dedup_events(rows.union(rows)), "dedup").select("id", "action")


@query("n5_gap_alert_stream", f"WITH {A.SQL_EVENTS} SELECT id, c_name AS name FROM evt LEFT JOIN customer ON entity_id = c_custkey")
def n5(s, d):
    names = A.table(s, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return jobs.run_available(jobs.gap_alerts(stream(s, d), names), "alerts").select("id", "name")


def table_stream(s, d, name):
    schema = A.table(s, d, name).schema
    return s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


_SLIDES = "unnest([time_bucket(INTERVAL '30 minutes', \"at\"), time_bucket(INTERVAL '30 minutes', \"at\") - INTERVAL '30 minutes'])"


@query("n2_event_counts_stream", f"WITH {A.SQL_EVENTS}, w AS (SELECT {_SLIDES} AS start, action, actor FROM evt) SELECT start, action, actor, count(*) AS n FROM w GROUP BY ALL")
def n2(s, d):
    rows = stream(s, d).withColumn("actor", F.concat(F.lit("actor"), F.pmod("entity_id", F.lit(7))))
    return jobs.event_count_table(rows)


@query(
    "n3_effort_stream",
    f"""WITH {A.SQL_EVENTS}, l AS (SELECT entity_id || '/' || strftime("at", '%Y-%m-%d') AS effort_id, "at", action FROM evt),
g AS (SELECT effort_id, coalesce(min("at") FILTER (action = 'signup'), min("at")) AS started_at, max("at") FILTER (action = 'purchase') AS ended, max("at") AS last_at,
 count(*) FILTER (action NOT IN ('signup', 'purchase')) AS call_count, count(*) FILTER (action = 'error') AS gap_count FROM l GROUP BY 1),
m AS (SELECT max("at") - INTERVAL '1 hour' AS mark FROM l)
SELECT effort_id, started_at, CASE WHEN ended IS NOT NULL THEN ended WHEN last_at + INTERVAL '2 hours' <= mark THEN last_at END AS ended_at, call_count, gap_count,
 CASE WHEN ended IS NOT NULL THEN 'resolved' WHEN last_at + INTERVAL '2 hours' <= mark THEN 'timeout' END AS outcome FROM g, m""",
)
def n3(s, d):
    kind = F.when(F.col("action") == "signup", "open").when(F.col("action") == "purchase", "end").otherwise("call")
    effort = F.concat("entity_id", F.lit("/"), F.date_format("at", "yyyy-MM-dd"))
    log = stream(s, d).select(effort.alias("effort_id"), kind.alias("kind"), "at", (F.col("action") == "error").alias("is_gap"), F.lit("resolved").alias("outcome"))
    return jobs.effort_table(log).drop("last_at")


@query("n6_merge_stream", SQL["m1_merge_mentions"])
def n6(s, d):
    """The batch merge's columns and SQL, from a stream of mentions"""
    merged = jobs.merge_stream(mention_rows(table_stream(s, d, "lineitem")))
    return merged_columns(merged)

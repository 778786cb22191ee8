"""Queries of two runs: what was expected, and what one run has that the other one lacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import matching
from . import adapters as A
from .registry import query

_COLUMNS = ("entity_id", "entity_type", "name", "confidence", "source")
_HASH = "md5(trim(regexp_replace(lower(body), '\\s+', ' ', 'g')))"
_RUNS = f"""{A.SQL_ENTITIES}, hs AS (SELECT *, {_HASH} AS h FROM ent),
be AS (SELECT * FROM hs QUALIFY entity_id = min(entity_id) OVER (PARTITION BY h)), af AS (SELECT * FROM hs QUALIFY entity_id = max(entity_id) OVER (PARTITION BY h))"""


def runs(s, d):
    """Of documents with one and the same text the one run keeps the first, the other one the last"""
    rows = A.entities(s, d).withColumn("h", X.content_hash(F.col("body"))).select(*_COLUMNS, "h")
    ends = rows.groupBy("h").agg(F.min("entity_id").alias("first"), F.max("entity_id").alias("last"))
    kept = lambda c: rows.join(ends.select(F.col(c).alias("entity_id")), "entity_id", "left_semi").select(*_COLUMNS)
    return kept("first"), kept("last")


@query("j12_recall_by_name")
def j12_by_name(s, d):
    """All entities that somebody labelled are expected; of copies only the first is there."""
    return matching.ground_truth_recall(runs(s, d)[0], A.entities(s, d).where("quality is not null").select(*_COLUMNS))


@query(
    "j12_recall_share",
    f"""WITH {_RUNS}, ex AS (SELECT DISTINCT entity_id, entity_type FROM ent WHERE quality IS NOT NULL)
SELECT count(*) AS expected, count(be.entity_id) AS found, round(count(be.entity_id) / count(*), 4)::DOUBLE AS recall FROM ex LEFT JOIN be USING (entity_id, entity_type)""",
)
def j12_share(s, d):
    return matching.recall(j12_by_name(s, d)).select("expected", "found", "recall")


@query("j13_diff_by_name")
def j13_by_name(s, d):
    return matching.kb_diff(*runs(s, d))


@query(
    "j13_run_counts",
    f"""WITH {_RUNS}, du AS (SELECT source, entity_type, 1 AS b, 0 AS a FROM be UNION ALL SELECT source, entity_type, 0, 1 FROM af)
SELECT 'source' AS dim, source AS value, sum(b)::BIGINT AS n_before, sum(a)::BIGINT AS n_after FROM du GROUP BY source
UNION ALL SELECT 'entity_type', entity_type, sum(b)::BIGINT, sum(a)::BIGINT FROM du GROUP BY entity_type""",
)
def j13_counts(s, d):
    return matching.run_counts(*runs(s, d))

"""Queries of merges, imports and proposals: what is there, what a batch does to it, and the table after it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..components import connected_components
from ..operators import imports, merges
from ..scratch import scratch_path
from ..sources import frontmatter
from ..streaming.tables import KeyedTable, latest
from . import adapters as A
from .kb_queries import _MENT, mentions
from .registry import query

_DAY = ("TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-06-01 00:00:00'")


def _at(text):
    return F.lit(text[11:-1]).cast("timestamp")


def parts(s, d):
    """Mentions as items of an import, and a third of their keys as what is there"""
    m = mentions(s, d)
    items = m.select("pos", F.lower("entity_type").alias("directory"), F.concat(F.lit("e"), "entity_id").alias("id"), (F.col("confidence") >= 0.02).alias("valid"), "name", "entity_id")
    there = items.where("entity_id % 3 = 0").groupBy("directory", "id").agg(F.min("name").alias("name"))
    there = there.withColumns({"created_at": _at(_DAY[0]), "updated_at": _at(_DAY[0]), "updated_by": F.lit("first")})
    return items.drop("entity_id"), there


def _import(error: bool) -> str:
    refused = "there" if error else "false"
    return f"""{_MENT}, it AS (SELECT pos, lower(entity_type) AS directory, 'e' || entity_id AS id, confidence >= 0.02 AS valid, name, entity_id % 3 = 0 AS there FROM men),
fi AS (SELECT id, min(pos) AS first FROM it WHERE valid AND NOT {refused} GROUP BY id),
oc AS (SELECT it.*, CASE WHEN NOT valid THEN 'invalid' WHEN pos > first THEN 'duplicate id ''' || it.id || ''' within this batch' WHEN first IS NULL OR pos < first THEN 'entity ''' || it.id || ''' already exists' END AS error FROM it LEFT JOIN fi USING (id)),
ou AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN there THEN 'updated' ELSE 'created' END AS status FROM oc),
wr AS (SELECT directory, id, name, CASE WHEN there THEN {_DAY[0]} ELSE {_DAY[1]} END AS created_at, {_DAY[1]} AS updated_at, 'import' AS updated_by, status FROM ou WHERE error IS NULL)"""


@query("m4_bulk_import", f"WITH {_import(True)} SELECT pos, directory, id, status, error FROM ou")
def m4(s, d):
    items, there = parts(s, d)
    return imports.bulk_import(items, there, _at(_DAY[1]), "error")[1]


@query(
    "m4_import_table",
    f"""WITH {_import(False)}, th AS (SELECT directory, id, min(name) AS name, {_DAY[0]} AS created_at, {_DAY[0]} AS updated_at, 'first' AS updated_by FROM it WHERE there GROUP BY 1, 2)
SELECT directory, id, name, created_at, updated_at, updated_by FROM th ANTI JOIN wr USING (directory, id) UNION ALL SELECT directory, id, name, created_at, updated_at, updated_by FROM wr""",
)
def m4_table(s, d):
    """The same batch with 'overwrite', into a table of buckets, where it runs twice"""
    items, there = parts(s, d)
    table = KeyedTable(s, imports.KEY, "directory string, id string, name string, created_at timestamp, updated_at timestamp, updated_by string", latest(imports.KEY, "updated_at"))
    table.upsert(there, 0)
    for _ in range(2):
        imports.import_batch(table, items, 1, _at(_DAY[1]), scratch_path(s, "events"), "overwrite")
    return table.read()


@query("m4_import_events", f"WITH {_import(False)} SELECT id AS entity_id, directory, status AS action, 'import' AS actor, {_DAY[1]} AS \"at\", name AS summary FROM wr")
def m4_events(s, d):
    items, there = parts(s, d)
    return imports.bulk_import(items, there, _at(_DAY[1]), "overwrite")[2]


_STAGE = f"""it AS (SELECT o_orderkey AS pos, 'c' || o_custkey AS id, o_orderstatus <> 'F' AS update, o_totalprice > 20000 AS valid, '' AS rationale, o_orderpriority AS name, c_custkey IS NOT NULL AS there
 FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey),
ou AS (SELECT *, CASE WHEN update AND NOT there THEN 'does not exist' WHEN NOT valid THEN 'invalid' WHEN NOT update AND there THEN 'already exists' END AS error FROM it)"""


def proposals(s, d):
    items = A.table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("c"), "o_custkey").alias("id"), (F.col("o_orderstatus") != "F").alias("update"), (F.col("o_totalprice") > 20000).alias("valid"), F.lit("").alias("rationale"), F.col("o_orderpriority").alias("name"))
    there = A.table(s, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), _at(_DAY[0]).alias("created_at"))
    return imports.stage_proposals(items, there, _at(_DAY[1]))


@query("m10_stage_proposals", f"WITH {_STAGE} SELECT pos, id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN update THEN 'proposed-update' ELSE 'proposed' END AS status, error FROM ou")
def m10(s, d):
    return proposals(s, d)[1]


@query(
    "m10_proposals",
    f"""WITH {_STAGE} SELECT id, max(pos) AS pos, max_by(update, pos) AS update, max_by(name, pos) AS name, CASE WHEN bool_or(there) THEN {_DAY[0]} ELSE {_DAY[1]} END AS created_at, 'agent' AS updated_by
FROM ou WHERE error IS NULL GROUP BY id""",
)
def m10_table(s, d):
    return proposals(s, d)[0].select("id", "pos", "update", "name", "created_at", "updated_by")


def chains(s, d):
    """Of four neighbours the later goes into the one before it: in one half of the groups the first verdict comes first, so
    that every other one finds its entity gone, in the other half the last does."""
    e = A.entities(s, d).select("entity_id", "name", "confidence", F.array_compact(F.array("source")).alias("source_documents"), F.lit(None).cast("map<string, array<string>>").alias("relationships"), F.lit("").alias("body"))
    late = F.when(F.col("entity_id") % 8 < 4, F.col("entity_id")).otherwise(-F.col("entity_id"))
    verdicts = e.where("entity_id % 4 > 0").select(late.alias("pos"), (F.col("entity_id") - 1).alias("a"), F.col("entity_id").alias("b"), F.lit("merge").alias("action"), (F.col("entity_id") - 1).alias("keep_id"))
    return merges.apply_merges(e, verdicts)


@query(
    "m5_apply_merges",
    f"""WITH {A.SQL_ENTITIES}, k AS (SELECT *, CASE WHEN entity_id % 8 < 4 THEN entity_id - entity_id % 2 ELSE entity_id - entity_id % 4 END AS keep FROM ent)
SELECT keep AS entity_id, count(*) AS members, max(coalesce(confidence, 0.5)) AS confidence, coalesce(array_to_string(list_sort(list_distinct(list(source) FILTER (source IS NOT NULL))), ','), '') AS sources,
 max(name) FILTER (entity_id = keep) AS name FROM k GROUP BY keep""",
)
def m5(s, d):
    after = chains(s, d)[0]
    return after.select("entity_id", "members", "confidence", F.coalesce(F.array_join("source_documents", ","), F.lit("")).alias("sources"), "name")


@query("m5_merge_log", f"WITH {A.SQL_ENTITIES} SELECT entity_id AS loser, entity_id - 1 AS winner, CASE WHEN entity_id % 8 = 2 THEN 'skipped' ELSE 'merged' END AS status FROM ent WHERE entity_id % 4 > 0")
def m5_log(s, d):
    return chains(s, d)[1].select("loser", "winner", "status")


@query(
    "m5_components",
    """WITH n AS (SELECT n_nationkey AS nk, 'region:' || n_regionkey AS r FROM nation),
x AS (SELECT 'nation:' || nk AS node, r FROM n UNION ALL SELECT DISTINCT r, r FROM n
 UNION ALL SELECT 'customer:' || c_custkey, r FROM customer JOIN n ON c_nationkey = nk UNION ALL SELECT 'supplier:' || s_suppkey, r FROM supplier JOIN n ON s_nationkey = nk
 UNION ALL SELECT 'order:' || o_orderkey, r FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = nk)
SELECT node, min(node) OVER (PARTITION BY r) AS component FROM x""",
)
def components(s, d):
    tree = A.edges(s, d).where(F.col("rel_type").isin("part_of", "belongs_to", "owned_by"))
    return connected_components(tree.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


def pages(s, d):
    """An entity page of each document: quoted, block and nested values, of ten one that can't be read and one that is no
    mapping"""
    docs = A.table(s, d, "documents")
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c, F.lit("\n"))
    front = F.concat(
        line("id", F.concat(F.lit("doc-"), "doc_id")), line("name", F.concat(F.lit('"Page: '), "doc_id", F.lit('"'))), F.lit("status: planned\nstatus: active\n"), line("confidence", F.when(F.col("doc_id") % 3 == 0, "high").otherwise("0.75")),
        F.lit("description: >\n  folded\n  text\ntags: [a, 'b, c']\nnested:\n  key: [1, 2]\nrelated_to:\n"), F.concat(F.lit("  - lang-"), F.coalesce("lang", F.lit("none")), F.lit("\n  - ''\n  - 7\n")), line("owned_by", F.concat(F.lit("'"), F.coalesce("source", F.lit("")), F.lit("'"))), F.lit("unknown: x\n"),
    )
    odd = F.when(F.col("doc_id") % 10 == 8, "a: [").when(F.col("doc_id") % 10 == 9, "- a\n- b").otherwise(front)
    return docs.select("doc_id", F.concat(F.lit("---\n"), odd, F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("value"))


_TRIMMED = "regexp_replace(coalesce(text, ''), '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')"


@query(
    "s3_read_entities",
    f"""SELECT 'doc-' || doc_id AS id, 'Page: ' || doc_id AS name, 'active' AS status, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence, 'folded text' || chr(10) AS description,
 'a|b, c' AS tags, '[1,2]' AS nested, md5({_TRIMMED}) AS h FROM documents WHERE doc_id % 10 < 8""",
)
def s3(s, d):
    rows = frontmatter.parse_pages(pages(s, d))
    texts = [frontmatter.field(k, F.lit("")).alias(k) for k in ("id", "name", "status")]
    more = [F.concat(F.trim(frontmatter.field("description", F.lit("")), F.lit("\n")), F.lit("\n")).alias("description"), F.array_join(F.col("texts")["tags"], "|").alias("tags"), F.get_json_object("front", "$.nested.key").alias("nested")]
    return rows.select(*texts, "confidence", *more, F.md5("body").alias("h"))


@query(
    "s4_frontmatter_edges",
    """SELECT 'doc-' || doc_id AS source_id, 'related_to' AS rel_type, 0 AS pos, 'lang-' || coalesce(lang, 'none') AS target_id FROM documents WHERE doc_id % 10 < 8
UNION ALL SELECT 'doc-' || doc_id, 'owned_by', 0, source FROM documents WHERE doc_id % 10 < 8 AND source <> ''""",
)
def s4(s, d):
    rows = frontmatter.parse_pages(pages(s, d)).withColumn("entity_id", frontmatter.field("id", F.lit("")))
    return frontmatter.frontmatter_edges(rows)

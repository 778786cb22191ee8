"""The given tables seen as knowledge-base tables; SQL has the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..ontology import TYPE_LAYERS, TYPES, layer_of
from ..operators.scan import numbered


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entities(spark: SparkSession, d: str, most: int = 2_000_000) -> DataFrame:
    """Up to ``most`` labels (some 100 MB) go to every task, so that they meet the documents without a shuffle of whole texts."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality", "toxic")
    labels = F.broadcast(labels) if labels.count() <= most else labels
    number = F.try_to_number(F.substring("source", 4, 9), F.lit("999")).cast("int")
    kind = F.get(F.array(*map(F.lit, TYPES)), F.pmod(F.coalesce(number, F.lit(0)), F.lit(len(TYPES))))
    name = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 6), " ")
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("entity_id"), kind.alias("entity_type"), name.alias("name"), F.substring_index("text", "\n", 1).alias("description"), F.col("text").alias("body"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("confidence"), "source", "lang", "toxic", "quality",
    )
    return rows.withColumn("layer", layer_of(F.col("entity_type")))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def distinct_pairs(rows: DataFrame, *by: str, per_task: int = 250_000) -> DataFrame:
    """Distinct ``rows``, dealt by the hash of ``by`` to tasks of about ``per_task``: keys with a few rows each.  Pairs hardly repeat, so that hash tables before the
    shuffle would save nothing, and none grows with the table."""
    return rows.repartition(max(1, -(-rows.count() // per_task)), *by).distinct()


def edges(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """source_id, rel_type, target_id; without ``once`` pairs of lineitem repeat, and nothing is shuffled"""
    t = lambda n: table(spark, d, n)
    pairs = lambda rows, *by: distinct_pairs(rows, *by) if once else rows
    e = lambda df, a, ka, rel, b, kb: df.select(F.concat(F.lit(a + ":"), F.col(ka)).alias("source_id"), F.lit(rel).alias("rel_type"), F.concat(F.lit(b + ":"), F.col(kb)).alias("target_id"))
    parts = [
        e(t("supplier"), "supplier", "s_suppkey", "belongs_to", "nation", "s_nationkey"),
        e(t("customer"), "customer", "c_custkey", "belongs_to", "nation", "c_nationkey"),
        e(t("nation"), "nation", "n_nationkey", "part_of", "region", "n_regionkey"),
        e(t("orders"), "order", "o_orderkey", "owned_by", "customer", "o_custkey"),
        e(pairs(t("lineitem").select("l_orderkey", "l_partkey"), "l_orderkey"), "order", "l_orderkey", "contains", "part", "l_partkey"),
        e(pairs(t("lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey"), "part", "l_partkey", "produced_by", "supplier", "l_suppkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_edges(spark: SparkSession, d: str) -> DataFrame:
    """source_id, rel_type, target_id: from each document to the next one of its source"""
    rows = numbered(table(spark, d, "documents").where("source is not null").select("source", "doc_id", "lang"), "source", "doc_id")
    after = rows.select((F.col("place") - 1).alias("place"), F.col("source").alias("to_source"), F.col("doc_id").alias("target_id"), F.col("lang").alias("to_lang"))
    rel = F.when(F.col("lang") == F.col("to_lang"), "triggers").otherwise("owned_by")
    return rows.join(after, "place").where("source = to_source").select(F.col("doc_id").alias("source_id"), rel.alias("rel_type"), "target_id")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """entity_id, entity_type, name of the graph"""
    t = lambda n: table(spark, d, n)
    e = lambda n, kind, k, name: t(n).select(F.concat(F.lit(kind + ":"), F.col(k)).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).cast("string").alias("name"))
    out = e("supplier", "supplier", "s_suppkey", "s_name")
    for p in (e("customer", "customer", "c_custkey", "c_name"), e("nation", "nation", "n_nationkey", "n_name"), e("region", "region", "r_regionkey", "r_name"), e("orders", "order", "o_orderkey", "o_orderkey"), e("part", "part", "p_partkey", "p_name")):
        out = out.unionByName(p)
    return out


def calls(spark: SparkSession, d: str) -> DataFrame:
    gap = X.words(F.col("text"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("effort_id"), F.col("turn").alias("seq"), F.col("role").alias("tool"), F.substring("text", 1, 1000).alias("summary"), (F.size(gap) < 20).alias("is_gap"))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("action"), F.concat(F.lit("actor"), F.pmod("user_id", F.lit(7))).alias("actor"), F.col("props").alias("args"))


def eval_results(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    cls = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "CLEAN").when((F.col("quality") == 1) & (F.col("toxic") == 1), "INCOMPLETE").otherwise("MISSING")
    persona = F.get(F.array(*map(F.lit, ("architect", "developer", "new-joiner", ""))), F.pmod("entity_id", F.lit(4)).cast("int"))
    return e.select(
        F.col("entity_id").alias("qid"), F.col("name").alias("question"), "source", F.col("lang").alias("layer_hint"), persona.alias("persona"), cls.alias("ddc_class"),
        F.length("body").cast("long").alias("total_ms"), F.concat(F.lit("run"), F.pmod("entity_id", F.lit(3))).alias("run_id"),
    )


_TYPE = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_LAYER = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN '{layer}'" for t, layer in TYPE_LAYERS.items()) + " ELSE 'unknown' END"
SQL_ENTITIES = f"""ent0 AS (SELECT doc_id AS entity_id, {_TYPE}[1 + coalesce(try_cast(substr(source, 4) AS INT), 0) % 18] AS entity_type,
 array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:6], ' ') AS name, split_part(text, chr(10), 1) AS description, text AS body,
 CASE quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.3 ELSE 0.5 END::DOUBLE AS confidence, source, lang, toxic, quality FROM documents LEFT JOIN labels USING (doc_id)),
ent AS (SELECT *, {_LAYER} AS layer FROM ent0)"""
SQL_EDGES = """edg AS (SELECT 'supplier:' || s_suppkey AS source_id, 'belongs_to' AS rel_type, 'nation:' || s_nationkey AS target_id FROM supplier
 UNION ALL SELECT 'customer:' || c_custkey, 'belongs_to', 'nation:' || c_nationkey FROM customer
 UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey FROM nation
 UNION ALL SELECT 'order:' || o_orderkey, 'owned_by', 'customer:' || o_custkey FROM orders
 UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
 UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'produced_by', 'supplier:' || l_suppkey FROM lineitem)"""
SQL_NODES = """nod AS (SELECT 'supplier:' || s_suppkey AS entity_id, 'supplier' AS entity_type, s_name AS name FROM supplier
 UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
 UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderkey::VARCHAR FROM orders
 UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part)"""
SQL_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '([\\p{{L}}\\p{{N}}_]+)', 1)"
SQL_CALLS = f"""cal AS (SELECT conv_id AS effort_id, turn AS seq, role AS tool, substr(text, 1, 1000) AS summary, len({SQL_WORDS.format("text")}) < 20 AS is_gap FROM conversations)"""
SQL_EVENTS = """evt AS (SELECT event_id AS id, ts AS "at", user_id AS entity_id, event_type AS action, 'actor' || (user_id % 7) AS actor, props AS args FROM events)"""
SQL_EVAL = f"""{SQL_ENTITIES}, evl AS (SELECT entity_id AS qid, name AS question, source, lang AS layer_hint, ['architect', 'developer', 'new-joiner', ''][1 + entity_id % 4] AS persona,
 CASE WHEN quality = 1 AND toxic = 0 THEN 'CLEAN' WHEN quality = 1 AND toxic = 1 THEN 'INCOMPLETE' ELSE 'MISSING' END AS ddc_class, length(body) AS total_ms, 'run' || (entity_id % 3) AS run_id FROM ent)"""
SQL_QUESTIONS = "qst AS (SELECT item_id AS qid, text AS question FROM benchmark)"
SQL_DOCUMENT_EDGES = """ded AS (SELECT * FROM (SELECT doc_id AS source_id, CASE WHEN lang = lead(lang) OVER w THEN 'triggers' ELSE 'owned_by' END AS rel_type, lead(doc_id) OVER w AS target_id
 FROM documents WHERE source IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE target_id IS NOT NULL)"""

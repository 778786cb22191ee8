"""Queries of files in and out, extraction, validation, resolution and context text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ontology
from ..functions import text as X
from ..operators import ann_index, backend, context, evaluate, extraction, resolve, search
from ..scratch import scratch_path
from ..sources import files
from ..streaming import ingest
from . import adapters as A
from .kb_queries import E, Q, _KEYS, adjusted, keyword, t
from .more_queries import _RRF
from .registry import query

_TRIM = r"regexp_replace({}, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')"


def by_source(s, d, text):
    """One text file a source, in a new folder of the shared scratch: doc_id order, one row of ``documents`` after another."""
    path = scratch_path(s, "tree")
    rows = t(s, d, "documents").select("source", "doc_id", text.alias("value")).where("source is not null and value is not null")
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    return path


@query("s1_read_documents", f"SELECT md5({_TRIM.format('body')}) AS h, length({_TRIM.format('body')})::BIGINT AS n, 'txt' AS file_type FROM (SELECT string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents WHERE source IS NOT NULL GROUP BY source) WHERE {_TRIM.format('body')} <> ''")
def s1(s, d):
    rows = files.read_documents(s, by_source(s, d, F.col("text")))
    return rows.select(F.md5("content").alias("h"), F.length("content").cast("long").alias("n"), "file_type")


_FIRST = "(SELECT source, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source)"


@query("s9_read_work_items", f"WITH w AS (SELECT {_TRIM.format('text')} AS x FROM {_FIRST}) SELECT substr(trim(replace(split_part(x, chr(10), 1), '#', '')), 1, 50) AS topic, md5(CASE WHEN length(x) > 2000 THEN substr(x, 1, 2000) || chr(10) || '[truncated]' ELSE x END) AS h FROM w WHERE x <> ''")
def s9(s, d):
    first = t(s, d, "documents").where("source is not null and text is not null").groupBy("source").agg(F.min_by("text", "doc_id").alias("value"))
    path = scratch_path(s, "work-items")
    first.repartition("source").write.partitionBy("source").text(path)
    return files.read_work_items(s, path).select("topic", F.md5("question").alias("h"))


@query("s10_read_questions", "SELECT text AS question, CASE WHEN item_id % 2 = 0 THEN 'seed' ELSE 'curated' END AS source FROM benchmark WHERE text IS NOT NULL")
def s10(s, d):
    path = scratch_path(s, "questions")
    rows = t(s, d, "benchmark").select(F.floor(F.col("item_id") / 50).alias("part"), F.struct(F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "seed").alias("source")).alias("q"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("q")).alias("value")).write.partitionBy("part").text(path)  # fifty a file
    return files.read_questions(s, path).select("question", "source")


@query("x19_normalize_extraction", """SELECT doc_id, lang AS document_summary, source AS source_document, 'api' AS entity_type, coalesce(substr(text, 1, 30), 'No description') AS description,
 'owned_by' AS relationship_type, 't' || doc_id AS target_entity_id, 't' || doc_id AS target_entity_name, CASE WHEN doc_id % 2 = 0 THEN 'why' ELSE '' END AS reasoning, coalesce(lang, 'unknown') AS subject FROM documents""")
def x19(s, d):
    name = F.substring("text", 1, 30)
    even = F.col("doc_id") % 2 == 0
    target = F.concat(F.lit("t"), "doc_id")
    rel = F.when(even, F.to_json(F.struct(F.lit("owned_by").alias("type"), target.alias("target"), F.lit("why").alias("description")))).otherwise(F.to_json(F.struct(F.lit("owned_by").alias("relationship_type"), target.alias("target_id"))))
    head = F.when(even, F.to_json(F.struct(F.lit("api").alias("type"), name.alias("name")))).otherwise(F.to_json(F.struct(F.lit("api").alias("entity_type"), name.alias("name"))))
    entity = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(', "relationships": ['), "rel", F.lit("]}"))
    top = F.to_json(F.struct(F.col("lang").alias("summary"), F.col("source").alias("source")))
    rows = t(s, d, "documents").select("doc_id", "lang", head.alias("h"), rel.alias("rel"), top.alias("top"))
    close = F.concat(F.when(F.length("top") > 2, F.concat(F.expr("substring(top, 1, length(top) - 1)"), F.lit(", "))).otherwise("{"), F.lit('"entities": ["a string", '), entity, F.lit('], "decision_log": [7, '), F.to_json(F.struct(F.col("lang").alias("topic"))), F.lit("]}"))
    x = rows.select("doc_id", extraction.normalize_extraction(close).alias("x"))
    e, r = F.col("x.entities")[0], F.col("x.entities")[0]["relationships"][0]
    return x.select("doc_id", "x.document_summary", "x.source_document", e["entity_type"].alias("entity_type"), e["description"].alias("description"), r["relationship_type"].alias("relationship_type"), r["target_entity_id"].alias("target_entity_id"), r["target_entity_name"].alias("target_entity_name"), r["reasoning"].alias("reasoning"), F.col("x.decision_log")[0]["subject"].alias("subject"))


@query("f1_validate_files", f"""WITH {E}, v AS (SELECT entity_id, name = '' OR trim(name) = '' AS e_name, coalesce(trim(description), '') = '' AS e_desc, entity_type NOT IN ({", ".join(repr(x) for x in ontology.TYPES[:12])}) AS e_type, NOT regexp_matches(lower(coalesce(source, 'None')), '^[a-z0-9]+(-[a-z0-9]+)*$') OR entity_id % 3 = 0 AS e_id, entity_id % 5 <> 0 AND coalesce(lang, '') NOT IN ('', {", ".join(repr(x) for x in ontology.STATUSES)}) AS e_status FROM ent)
SELECT entity_id, e_name::INT + e_desc::INT + e_type::INT + e_id::INT + e_status::INT AS n_errors, NOT (e_name OR e_desc OR e_type OR e_id OR e_status) AS valid, 'quality' AS warnings FROM v""")
def f1_files(s, d):
    """Front matter whose id holds a blank in every third row, and whose status is a language but in every fifth."""
    id_ = F.when(F.col("entity_id") % 3 == 0, "no kebab").otherwise(F.lower(F.coalesce("source", F.lit("None"))))
    fields = F.create_map(*[x for k, v in {"type": "entity_type", "name": "name", "description": "description"}.items() for x in (F.lit(k), F.col(v))], F.lit("id"), id_, F.lit("status"), F.when(F.col("entity_id") % 5 == 0, "active").otherwise(F.col("lang")), F.lit("owned_by"), F.lit("x"), F.lit("quality"), F.lit("1"))
    rows = A.entities(s, d).select("entity_id", fields.alias("fields"), F.lit(None).cast("string").alias("expected_id"))
    found = extraction.validate(rows, ["owned_by", "part_of"], ontology.TYPES[:12])
    return found.select("entity_id", F.size("errors").alias("n_errors"), "valid", F.array_join("warnings", ",").alias("warnings"))


@query("m6_fold_members", f"""WITH {E}, g AS (SELECT *, entity_id - entity_id % 4 AS keep FROM ent), b AS (SELECT keep, list(coalesce(body, '') ORDER BY entity_id) AS bs, list(source ORDER BY entity_id) FILTER (source IS NOT NULL) AS rel FROM g GROUP BY keep)
SELECT keep AS entity_id, max(name) FILTER (entity_id = keep) AS name, coalesce(max(confidence), 0.5) AS confidence, count(*) AS members, coalesce(array_to_string(list_sort(list_distinct(list(source) FILTER (source IS NOT NULL))), ','), '') AS sources, md5(any_value(list_reduce(bs, lambda a, x: CASE WHEN contains(a, x) THEN a WHEN a = '' THEN x ELSE a || chr(10) || chr(10) || x END))) AS h FROM g JOIN b USING (keep) GROUP BY keep""")
def m6(s, d):
    e = A.entities(s, d).withColumn("source_documents", F.array_compact(F.array("source"))).withColumn("relationships", F.map_filter(F.create_map(F.lit("part_of"), F.array("source")), lambda k, v: F.exists(v, lambda x: x.isNotNull())))
    found = resolve.fold_members(e, e.select("entity_id", (F.col("entity_id") - F.col("entity_id") % 4).alias("keep")))
    return found.select("entity_id", "name", "confidence", "members", F.array_join(F.coalesce("source_documents", F.array().cast("array<string>")), ",").alias("sources"), F.md5("body").alias("h"))


@query("r10_dedup_text", f"""WITH RECURSIVE {E}, {Q}, {_KEYS}, h AS (SELECT qid, entity_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, entity_id) AS p, list_distinct({A.SQL_WORDS.format('description')}) AS ws FROM kw JOIN ent USING (entity_id)),
 g AS (SELECT qid, 0::BIGINT AS p, [['']] AS kept, true AS stays FROM (SELECT DISTINCT qid FROM h)
 UNION ALL SELECT qid, np, CASE WHEN z THEN list_append(kept, hw) ELSE kept END, z FROM (SELECT g.qid, h.p AS np, h.ws AS hw, kept, len(h.ws) = 0 OR len(list_filter(kept, lambda k: len(k) > 0 AND len(list_intersect(k, h.ws)) * 1.0 / len(list_distinct(k || h.ws)) > 0.85)) = 0 AS z FROM g JOIN h ON h.qid = g.qid AND h.p = g.p + 1))
SELECT g.qid, h.entity_id FROM g JOIN h ON g.qid = h.qid AND g.p = h.p WHERE stays""")
def r10(s, d):
    rows = keyword(s, d).select("qid", "entity_id", F.round("score", 6).alias("score")).join(A.entities(s, d).select("entity_id", "description"), "entity_id")
    return resolve.dedup_text(rows).select("qid", "entity_id")


def _blocks(source):
    """CTEs down to c: qid, entity_id, pos, block, running (tokens), from ``source`` (qid, entity_id, layer, sc)"""
    return f"""i AS (SELECT qid, entity_id, layer, sc, row_number() OVER (PARTITION BY qid, layer ORDER BY sc DESC, entity_id) AS turn FROM {source}), p AS (SELECT i.*, row_number() OVER (PARTITION BY qid ORDER BY turn, layer <> 'structural', layer) AS pos, greatest(250, least(2500, floor(24000 * sc / sum(sc) OVER (PARTITION BY qid)))) AS share FROM i),
 b AS (SELECT p.qid, p.entity_id, pos, 4 * share AS room, e.*, {_TRIM.format("regexp_replace(coalesce(body, ''), '\\n##[ \\t-\\r]*Open Questions(.|\\n)*$', '')")} AS bare FROM p JOIN ent e USING (entity_id)),
 k AS (SELECT qid, entity_id, pos, 'Entity: ' || name || ' (' || entity_type || ', confidence: ' || round(100 * confidence)::INT || '%)' || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || coalesce('Relationships:' || chr(10) || '  part_of → ' || source || chr(10), '') || coalesce('Source: ' || source || chr(10), '') ||
 CASE WHEN bare = '' THEN '' WHEN length(bare) > room THEN chr(10) || regexp_replace(substr(bare, 1, room::BIGINT), '\\n[^\\n]*$', '') || chr(10) || '[...]' || chr(10) ELSE chr(10) || bare || chr(10) END AS block FROM b),
 c AS (SELECT *, sum(length(block) // 4) OVER (PARTITION BY qid ORDER BY pos) AS running FROM k)"""


def hops_and_relations(s, d):
    e = A.entities(s, d)
    hops = adjusted(s, d).select("qid", "entity_id", F.round("score", 9).alias("score"), "layer", "entity_type", "is_listing", "is_comparison", F.when(F.col("layer") == "structural", 1.5).otherwise(1.0).alias("priority"))
    edges = e.where("source is not null").select(F.col("entity_id").alias("source_id"), F.lit("part_of").alias("rel_type"), F.col("source").alias("target_id"))
    names = e.select(F.col("source").alias("entity_id"), F.col("source").alias("name")).distinct()
    return e, hops, context.first_relations(edges, names)


@query("r14_context_text", f"WITH {_RRF}, x AS (SELECT qid, entity_id, layer, round(score, 9) AS sc FROM ad), {_blocks('x')} SELECT qid, count(*) AS blocks, md5(string_agg(block, chr(10) || '---' || chr(10) ORDER BY pos)) AS h FROM c WHERE running <= 24000 GROUP BY qid")
def r14_text(s, d):
    e, hops, relations = hops_and_relations(s, d)
    return context.context_text(context.pack_blocks(hops, e, relations)).select("qid", "blocks", F.md5("context").alias("h"))


@query("r21_run_eval", f"""WITH {_RRF}, x AS (SELECT *, round(score, 9) AS sc FROM ad), c1 AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid, entity_type ORDER BY sc DESC, entity_id) AS r FROM x), c2 AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n2, row_number() OVER (PARTITION BY qid, layer ORDER BY sc DESC, entity_id) AS r2 FROM c1 WHERE (r <= greatest(1, floor(n * 0.5)) OR is_listing OR is_comparison)),
 f AS (SELECT qid, entity_id, layer, sc FROM c2 WHERE (r2 <= greatest(1, floor(n2 * 0.6)) OR is_listing) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sc DESC, entity_id) <= 15), {_blocks('f')}, z AS (SELECT qid, count(*) AS n, string_agg(block, chr(10) || '---' || chr(10) ORDER BY pos) AS t FROM c WHERE running <= 24000 GROUP BY qid)
SELECT qid, coalesce(n, 0) AS entities_retrieved, md5(coalesce(substr(t, 1, 500), '')) AS answer, CASE WHEN n IS NULL THEN 'not_answerable' ELSE 'partial' END AS score, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'INCOMPLETE' END AS ddc_class FROM qst LEFT JOIN z USING (qid)""")
def r21(s, d):
    e, hops, relations = hops_and_relations(s, d)
    found = evaluate.run_eval(A.questions(s, d), hops, e, relations)
    return found.select("qid", "entities_retrieved", F.md5("answer").alias("answer"), "score", "ddc_class")


@query("r19_ann_search")
def r19(s, d):
    v = t(s, d, "embeddings").select(F.col("vec_id").alias("entity_id"), "embedding")
    return ann_index.ann_search(v.where("entity_id % 100 = 0").select(F.col("entity_id").alias("qid"), "embedding"), v, 10)


@query("p1_embed")
def p1(s, d):
    return t(s, d, "documents").select("doc_id", backend.hashing_embedder()(F.col("text")).alias("embedding"))


@query("p3_judge_pairs", """WITH p AS (SELECT p_partkey AS id, p_name AS name, p_size / 50.0 AS conf, trim(regexp_replace(lower(p_name), '\\s+(deployment|v\\d+|process|processing|monitoring|migration)$', '')) AS base FROM part)
SELECT a.id AS a, b.id AS b, CASE WHEN a.base = b.base THEN 'merge' ELSE 'keep' END AS action, CASE WHEN b.conf > a.conf THEN b.id ELSE a.id END AS keep_id FROM p a JOIN p b ON b.id = a.id + 1""")
def p3(s, d):
    parts = t(s, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), (F.col("p_size") / 50.0).alias("confidence"))
    return resolve.judge_pairs(parts.select(F.col("entity_id").alias("a"), (F.col("entity_id") + 1).alias("b")), parts)


@query("p4_search_kb", f"WITH {E}, {Q}, {_KEYS} SELECT qid, entity_id, rank::INT AS rank FROM kw WHERE rank < 5")
def p4(s, d):
    kb = backend.KnowledgeBase(A.entities(s, d), t(s, d, "embeddings").select(F.col("vec_id").alias("entity_id"), "embedding"), A.edges(s, d))
    return kb.keyword(A.questions(s, d), 5).select("qid", "entity_id", F.col("rank").cast("int").alias("rank"))


@query("n1_ingest", "SELECT 'doc-' || doc_id AS filename, md5(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS hash, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'analyzed' END AS status FROM documents")
def n1(s, d):
    docs = t(s, d, "documents")
    stream = s.readStream.schema(docs.schema).parquet(f"{d}/documents.parquet*").select(F.concat(F.lit("doc-"), "doc_id").alias("filename"), "text")
    return ingest.ingest_stream(stream, lambda todo: todo.select("filename", (F.regexp_replace("filename", "doc-", "").cast("long") % 7 != 0).alias("ok")))

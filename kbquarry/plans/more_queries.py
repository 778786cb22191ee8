"""Queries of sources, proposals, gaps, context packing, evaluation and unions."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fuse, gaps, windows
from ..scratch import scratch_path
from ..sources import files
from . import adapters as A
from .kb_queries import _KV, _MENT, _RRF, _VEC, _W, EV, E, G, N, Q, V, adjusted, candidates, fused, mentions, query, seeds, t, vectors


@query("s5_read_extractions", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s5(s, d):
    path = scratch_path(s, "extractions")
    t(s, d, "documents").where("text is not null").select(F.col("source").alias("source_document"), F.col("text").alias("document_summary")).write.json(path)
    rows = s.read.schema("source_document string, document_summary string, _corrupt_record string").json(path).where("_corrupt_record is null")
    return rows.groupBy(F.col("source_document").alias("source")).agg(F.count("*").alias("n"), F.sum(F.length("document_summary")).alias("chars"))


@query("s6_write_entities", f"WITH {E} SELECT entity_type, count(*) AS n, sum(entity_id)::BIGINT AS ids FROM ent GROUP BY 1")
def s6(s, d):
    path = scratch_path(s, "entities")
    files.write_entities(A.entities(s, d).select("entity_id", "entity_type", "name", "confidence"), path)
    return s.read.parquet(path).groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("entity_id").alias("ids"))


@query("s8_rebuild", f"WITH {_MENT} SELECT entity_type, count(DISTINCT entity_id) AS entities, max(confidence) AS confidence FROM men GROUP BY 1")
def s8(s, d):
    path = scratch_path(s, "rebuilt")
    merged = mentions(s, d).groupBy("entity_type", "entity_id").agg(F.max("confidence").alias("confidence"))
    files.write_entities(merged, path)
    return s.read.parquet(path).groupBy("entity_type").agg(F.count("*").alias("entities"), F.max("confidence").alias("confidence"))


@query("s11_eval_results", f"WITH {V} SELECT ddc_class, count(*) AS n, sum(total_ms)::BIGINT AS ms FROM evl GROUP BY 1")
def s11(s, d):
    path = scratch_path(s, "eval-results")
    files.write_eval_results(A.eval_results(s, d), path)
    return s.read.schema(files.RESULT).json(path).groupBy("ddc_class").agg(F.count("*").alias("n"), F.sum("total_ms").alias("ms"))


@query("s13_append_events", f"WITH {EV} SELECT CAST(\"at\" AS DATE) AS date, count(*) AS n, sum(length(substr(args, 1, 500)))::BIGINT AS chars FROM evt GROUP BY 1")
def s13(s, d):
    path = scratch_path(s, "log")
    files.append_events(A.events(s, d).withColumnRenamed("args", "summary"), path)
    return s.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"), F.sum(F.length("summary")).alias("chars"))


@query("s17_coverage_tables", f"WITH {V} SELECT source, layer_hint, persona, ddc_class, count(*) AS n FROM evl GROUP BY GROUPING SETS ((source, ddc_class), (layer_hint, ddc_class), (persona, ddc_class), (ddc_class))")
def s17(s, d):
    sets = [[F.col(c), F.col("ddc_class")] for c in ("source", "layer_hint", "persona")] + [[F.col("ddc_class")]]
    return A.eval_results(s, d).groupingSets(sets, "source", "layer_hint", "persona", "ddc_class").agg(F.count("*").alias("n"))


@query("x28_hop_trace", f"WITH {_RRF}, h AS (SELECT qid, entity_type || ':' || entity_id AS line, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, entity_id) AS r FROM fu) SELECT qid, string_agg(line, ' → ' ORDER BY r) AS trace FROM h WHERE r <= 5 GROUP BY 1")
def x28(s, d):
    top = windows.top_k(fused(s, d), ["qid"], [F.desc(F.round("score", 9)), F.col("entity_id")], 5)
    line = F.struct("rank", F.concat_ws(":", "entity_type", "entity_id").alias("line"))
    return top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), " → ").alias("trace"))


@query("j8_keyword_join", f"WITH {E}, {Q}, aq AS (SELECT qid, unnest(list_distinct({_W('question')})) AS w FROM qst), iw AS (SELECT entity_id, unnest(list_distinct({_W('name')})) AS w FROM ent) SELECT qid, entity_id, count(*) AS n FROM aq JOIN iw USING (w) GROUP BY 1, 2")
def j8(s, d):
    asked = A.questions(s, d).select("qid", F.explode(F.array_distinct(X.words(F.col("question")))).alias("w"))
    named = A.entities(s, d).select("entity_id", F.explode(F.array_distinct(X.words(F.col("name")))).alias("w"))
    return asked.join(named, "w").groupBy("qid", "entity_id").agg(F.count("*").alias("n"))


@query("r12_cap_types", f"WITH {_RRF}, x AS (SELECT *, round(score, 9) AS sc FROM ad), c AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid, entity_type ORDER BY sc DESC, entity_id) AS r FROM x) SELECT qid, entity_id FROM c WHERE (r <= greatest(1, floor(n * 0.5)) OR is_listing OR is_comparison)")
def r12(s, d):
    rows = adjusted(s, d).withColumn("score", F.round("score", 9))
    return fuse.cap_types(rows).select("qid", "entity_id")


_PACK = f"{_RRF}, i AS (SELECT qid, entity_id, layer, round(score, 9) AS sc, row_number() OVER (PARTITION BY qid, layer ORDER BY round(score, 9) DESC, entity_id) AS turn FROM ad), p AS (SELECT i.*, row_number() OVER (PARTITION BY qid ORDER BY turn, layer) AS pos, greatest(250, least(2500, floor(2400 * sc / sum(sc) OVER (PARTITION BY qid)))) AS share FROM i), b AS (SELECT p.*, least(length(body), 4 * share) AS chars FROM p JOIN ent USING (entity_id)), k AS (SELECT *, sum(chars) OVER (PARTITION BY qid ORDER BY pos) AS running FROM b)"


@query("r14_context_pack", f"WITH {_PACK} SELECT qid, entity_id, pos::INT AS pos, chars::BIGINT AS chars FROM k WHERE running <= 9600")
def r14(s, d):
    rows = adjusted(s, d).withColumn("score", F.round("score", 9))
    rows = windows.interleave(rows, "qid", "layer", [F.desc("score"), F.col("entity_id")], [F.col("layer")])
    rows = windows.budget_share(rows, "qid", "score", 2400, 250, 2500)
    rows = rows.join(A.entities(s, d).select("entity_id", F.length("body").alias("n")), "entity_id").withColumn("chars", F.least(F.col("n"), 4 * F.col("share")).cast("long"))
    return windows.take_until_budget(rows, ["qid"], [F.col("pos")], "chars", 9600).select("qid", "entity_id", "pos", "chars")


@query("r15_vector_only", f"WITH {_VEC} SELECT qid, entity_id, rank::INT AS rank FROM vc WHERE rank < 15")
def r15(s, d):
    return vectors(s, d).where("rank < 15").select("qid", "entity_id", F.col("rank").cast("int").alias("rank"))


def hops(s, d):
    """The fused hops with their flag"""
    rows = fused(s, d)
    return rows.withColumn("flag", gaps.hop_flag(F.col("confidence"), F.col("n_edges")))


_HOP = f"{_RRF}, hp AS (SELECT *, CASE WHEN confidence < 0.4 THEN 'low_confidence' WHEN n_edges = 0 THEN 'orphan_entity' END AS flag FROM fu)"


@query("g1_hop_flags", f"WITH {_HOP} SELECT qid, entity_id, flag FROM hp")
def g1(s, d):
    return hops(s, d).select("qid", "entity_id", "flag")


@query("g3_orphan_gaps", f"WITH {_HOP} SELECT qid, entity_id, 'orphan_entity' AS gap_type, 'low' AS severity FROM hp WHERE flag = 'orphan_entity'")
def g3(s, d):
    return gaps.orphan_gaps(hops(s, d))


_NW = "list_distinct(list_filter(regexp_split_to_array(lower({}.name), '\\s+'), lambda w: w <> ''))"


@query("g4_ambiguous_gaps", f"WITH {_RRF}, z AS (SELECT qid, a.entity_id AS a, b.entity_id AS b, {_NW.format('a')} AS x, {_NW.format('b')} AS y FROM fu a JOIN fu b USING (qid) WHERE a.entity_id < b.entity_id AND round(a.score, 9) > 0.7 AND round(b.score, 9) > 0.7) SELECT qid, a, b FROM z WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) > 0.6")
def g4(s, d):
    return gaps.ambiguous_gaps(fused(s, d).withColumn("score", F.round("score", 9)))


@query("g6_broken_relationships", f"WITH {G}, {N}, s0 AS (SELECT name::BIGINT AS qid, entity_id AS id FROM nod WHERE entity_type = 'order' AND entity_id LIKE '%00'), s1 AS (SELECT DISTINCT qid, target_id AS id FROM s0 JOIN edg ON source_id = id) SELECT qid, entity_id, 'medium' AS severity FROM s1 JOIN nod ON id = entity_id WHERE entity_type = 'customer'")
def g6(s, d):
    found = seeds(s, d).join(A.edges(s, d), F.col("id") == F.col("source_id")).select("qid", F.col("target_id").alias("entity_id"), F.lit(1).alias("hop")).distinct()
    known = A.nodes(s, d).select("entity_id", F.when(F.col("entity_type") != "customer", F.col("name")).alias("description"))
    return gaps.broken_relationship_gaps(found, known)


@query("g8_report_gaps", f"WITH {V}, g AS (SELECT DISTINCT 'coverage:' || source || ':' || substr(question, 1, 60) AS key, ddc_class FROM evl WHERE ddc_class <> 'CLEAN' AND source IS NOT NULL AND question IS NOT NULL), k AS (SELECT key, min(CASE ddc_class WHEN 'MISSING' THEN 0 ELSE 1 END) AS grade FROM g GROUP BY 1) SELECT key, CASE grade WHEN 0 THEN 'high' ELSE 'medium' END AS severity FROM k ORDER BY grade, key LIMIT 20")
def g8(s, d):
    rows = A.eval_results(s, d).where("ddc_class <> 'CLEAN' and source is not null and question is not null")
    return gaps.report_gaps(rows.select("qid", F.lit("coverage").alias("gap_type"), F.col("source").alias("entity_id"), F.col("question").alias("description"), F.when(F.col("ddc_class") == "MISSING", "high").otherwise("medium").alias("severity")))


@query("g11_gap_cards", f"WITH {_HOP}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, entity_id) AS k FROM hp), f AS (SELECT qid, min(flag) AS gap_type FROM hp WHERE flag IS NOT NULL GROUP BY 1), m AS (SELECT qid, string_agg(name, ', ' ORDER BY k) AS names FROM r WHERE k <= 5 GROUP BY 1) SELECT qid, gap_type, coalesce(names, '') AS names, CASE gap_type WHEN 'orphan_entity' THEN 'link the entity' ELSE 'review the entity' END AS action FROM f LEFT JOIN m USING (qid)")
def g11(s, d):
    rows = hops(s, d)
    ranked = windows.top_k(rows, ["qid"], [F.desc(F.round("score", 9)), F.col("entity_id")], 5)
    return gaps.gap_cards(ranked, rows.where("flag is not null").select("qid", F.col("flag").alias("gap_type")))


@query("a11_lint_summary", f"WITH {E} SELECT count(*) FILTER (trim(coalesce(name, '')) = '') AS unnamed, count(*) FILTER (confidence < 0.5) AS unsure, count(*) FILTER (source IS NULL) AS unsourced, count(*) FILTER (trim(coalesce(name, '')) = '' OR confidence < 0.5 OR source IS NULL) AS any_issue FROM ent")
def a11(s, d):
    bad = {"unnamed": F.trim(F.coalesce("name", F.lit(""))) == "", "unsure": F.col("confidence") < 0.5, "unsourced": F.col("source").isNull()}
    return A.entities(s, d).agg(*[F.count_if(c).alias(k) for k, c in bad.items()], F.count_if(bad["unnamed"] | bad["unsure"] | bad["unsourced"]).alias("any_issue"))


@query("a18_block_graph", f"WITH {G}, {N}, dg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edg UNION ALL SELECT target_id FROM edg) GROUP BY 1) SELECT entity_type, count(*) AS nodes, coalesce(sum(n), 0)::BIGINT AS degree, max(coalesce(n, 0)) AS most FROM nod LEFT JOIN dg ON id = entity_id GROUP BY 1")
def a18(s, d):
    e = A.edges(s, d)
    degree = e.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("n"))
    rows = A.nodes(s, d).join(degree, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("entity_type").agg(F.count("*").alias("nodes"), F.sum("n").alias("degree"), F.max("n").alias("most"))


@query("w1_top_k", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1)::INT AS rank FROM orders QUALIFY rank < 3")
def w1(s, d):
    return windows.top_k(t(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("w2_rank_within", f"WITH {_KV} SELECT qid, method, entity_id, rank::INT AS rank FROM un")
def w2(s, d):
    return candidates(s, d).select("qid", "method", "entity_id", F.col("rank").cast("int").alias("rank"))


@query("w9_first_last", "SELECT l_orderkey, min({'n': l_linenumber, 'f': l_returnflag}).f AS first_flag, max({'n': l_linenumber, 'f': l_returnflag}).f AS last_flag FROM lineitem GROUP BY 1")
def w9(s, d):
    """Equal line numbers: the smallest flag is first, the largest last"""
    at = F.struct("l_linenumber", "l_returnflag")
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.min(at)["l_returnflag"].alias("first_flag"), F.max(at)["l_returnflag"].alias("last_flag"))


@query("t1_open_questions", f"WITH {E} SELECT entity_id, name, confidence FROM ent ORDER BY confidence, entity_id LIMIT 20")
def t1(s, d):
    return A.entities(s, d).orderBy("confidence", "entity_id").limit(20).select("entity_id", "name", "confidence")


@query("t5_sample_docs", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 25")
def t5(s, d):
    """A seeded sample of documents: the sampling is the operator"""
    return t(s, d, "documents").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id").limit(25).select("doc_id")


@query("u1_union_methods", f"WITH {_KV} SELECT qid, method, count(*) AS n FROM un GROUP BY 1, 2")
def u1(s, d):
    return candidates(s, d).groupBy("qid", "method").agg(F.count("*").alias("n"))


@query("u3_union_sources", "SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS sources FROM lineitem GROUP BY 1")
def u3(s, d):
    return t(s, d, "lineitem").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("sources"))


@query("u4_all_questions", f"WITH {Q} SELECT question, 'curated' AS source, NULL AS topic FROM qst UNION ALL SELECT text, 'conversation', role FROM conversations WHERE turn = 0")
def u4(s, d):
    asked = t(s, d, "conversations").where("turn = 0").select(F.col("text").alias("question"), F.lit("conversation").alias("source"), F.col("role").alias("topic"))
    return A.questions(s, d).select("question", F.lit("curated").alias("source")).unionByName(asked, allowMissingColumns=True)


@query("u6_unknown_keys", "SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('k', 'id', 'type'))), ',') AS unknown FROM events")
def u6(s, d):
    keys = F.array_except(F.json_object_keys("props"), F.array(*map(F.lit, ("k", "id", "type"))))
    return t(s, d, "events").select("event_id", F.array_join(F.sort_array(keys), ",").alias("unknown"))



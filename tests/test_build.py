"""Extraction JSON, validation, context text and ingest on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from kbquarry.operators import backend, context, extraction
from kbquarry.streaming import ingest


def test_normalize_extraction(spark):
    raw = {"summary": "s", "source": "d.md", "entities": ["text", {"type": "api", "name": "N", "overview": "One sentence. Two.", "relationships": [{"type": "uses", "target_id": "x", "description": "why"}]}, {"entity_type": "team"}], "decision_log": [3, {"topic": "t", "action": "a", "rationale": "r"}, {}]}
    r = spark.createDataFrame([(json.dumps(raw),), ("{}",)], "j string").select(extraction.normalize_extraction(F.col("j")).alias("x")).collect()
    x = r[0]["x"]
    assert (x["document_summary"], x["source_document"]) == ("s", "d.md")
    assert [(e["entity_type"], e["description"]) for e in x["entities"]] == [("api", "One sentence"), ("team", "No description")]
    assert tuple(x["entities"][0]["relationships"][0]) == ("uses", "x", "x", "why")
    assert [tuple(v) for v in x["decision_log"]] == [("t", "a", "r"), ("unknown", "", "")]
    assert r[1]["x"]["entities"] == [] and r[1]["x"]["decision_log"] == []


def test_validate(spark):
    good = {"type": "api", "id": "a-b", "name": "n", "description": "d", "owned_by": "t", "odd": "1"}
    rows = [(1, good, "a-b"), (2, good, "other"), (3, {**good, "id": "A b", "status": "gone", "type": "none"}, None), (4, None, None), (5, {"id": "a"}, None)]
    got = {r["k"]: r for r in extraction.validate(spark.createDataFrame(rows, "k int, fields map<string, string>, expected_id string"), ["owned_by"]).collect()}
    fields = lambda k: [e["field"] for e in got[k]["errors"]]
    assert got[1]["valid"] and got[1]["warnings"] == ["odd"] and fields(2) == ["id"] and fields(3) == ["type", "id", "status"]
    assert fields(4) == ["frontmatter"] and fields(5) == ["type", "name", "description"]


def test_context_text(spark):
    e = spark.createDataFrame([(1, "A", "api", 0.9, "d", "s.md", "line one\nline two\n## Open Questions\n- no"), (2, "B", "team", 0.3, None, None, None)], "entity_id long, name string, entity_type string, confidence double, description string, source string, body string")
    hops = spark.createDataFrame([(7, 2, 0.5, "organizational", 1.0), (7, 1, 0.4, "structural", 1.5)], "qid long, entity_id long, score double, layer string, priority double")
    edges = spark.createDataFrame([("1", "uses", "9")], "source_id string, rel_type string, target_id string").select(F.col("source_id").cast("long").alias("source_id"), "rel_type", F.col("target_id").cast("long").alias("target_id"))
    blocks = context.pack_blocks(hops, e, context.first_relations(edges, e.select("entity_id", "name")))
    text = context.context_text(blocks).first()["context"]
    assert text == "Entity: A (api, confidence: 90%)\nDescription: d\nRelationships:\n  uses → 9\nSource: s.md\n\nline one\nline two\n\n---\nEntity: B (team, confidence: 30%)\nDescription: \n"
    small = context.pack_blocks(hops, e, context.first_relations(edges, e.select("entity_id", "name")), backend.RetrievalConfig(token_budget=20))
    assert [r["entity_id"] for r in small.collect()] == []


@pytest.mark.parametrize("most", [100, 0])
def test_context_packs_shuffle_no_bodies_that_no_hop_names(spark, most):
    """However large the table is, bodies meet the hops where they are read (or by a shuffle, for more than ``most`` hops), with the same blocks."""
    e = spark.range(500).select(F.col("id").alias("entity_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("api").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit("d").alias("description"), F.lit("s").alias("source"), F.concat(F.lit("body "), "id").alias("body"))
    hops = spark.createDataFrame([(q, 7 * q + i, 1.0 / (1 + i), "structural", 1.0) for q in range(3) for i in range(4)], "qid long, entity_id long, score double, layer string, priority double")
    edges = spark.createDataFrame([(8, "uses", "3"), (8, "uses", "x"), (400, "uses", "1")], "source_id long, rel_type string, target_id string")
    names = e.select(F.col("entity_id").cast("string").alias("entity_id"), "name")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        blocks = context.pack_blocks(hops, e, context.first_relations(edges, names), most=most)
        plan = blocks._jdf.queryExecution().sparkPlan().toString()
        found = {(r["qid"], r["pos"]): (r["entity_id"], r["block"]) for r in blocks.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == ((True, False) if most else (False, True))
    assert len(found) == 12 and found[1, 2] == (8, "Entity: n8 (api, confidence: 50%)\nDescription: d\nRelationships:\n  uses → n3\n  uses → x\nSource: s\n\nbody 8\n")
    assert {(r["qid"], r["blocks"]) for r in context.context_text(blocks).collect()} == {(q, 4) for q in range(3)}


def test_ingest_reads_new_changed_and_failed_documents_only(spark, tmp_path):
    src, state, seen = str(tmp_path / "in"), f"file://{tmp_path}/state", []

    def process(todo):
        seen.append(sorted(r["filename"] for r in todo.collect()))
        return todo.select("filename", (F.col("text") != "bad").alias("ok"))

    def load(rows):
        spark.createDataFrame(rows, "filename string, text string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("filename string, text string").parquet(src)
        return {r["filename"]: r["status"] for r in ingest.ingest_stream(stream, process, state).collect()}

    assert load([("a", "one"), ("b", "bad"), ("c", None)]) == {"a": "analyzed", "b": "failed", "c": "failed"}
    assert load([("a", "ONE"), ("b", "bad"), ("d", "new")]) == {"a": "analyzed", "b": "failed", "c": "failed", "d": "analyzed"}
    assert load([("a", "two"), ("b", "good")])["b"] == "analyzed"
    assert seen == [["a", "b", "c"], ["b", "d"], ["a", "b"]]

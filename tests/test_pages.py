"""Front matter, question understanding, graph list."""

from pyspark.sql import functions as F

from kbquarry.operators import fuse, search
from kbquarry.operators.understanding import understand
from kbquarry.sources import frontmatter


def test_front_matter_is_a_mapping(spark, tmp_path):
    good = "---\nid: one\nname: 'A: b'\ntype: system\nconfidence: 1\nowned_by: team\nrelated_to:\n- x\n- ''\n- 3\n- {a: b}\ntriggers: |\n  block\n  text\nother: y\nsource_documents: [d1]\ndate: 2024-01-02\n---\n\nbody --- more\n"
    pages = {"system/one.md": good, "team/two.md": "---\nstatus: active\n---\nx", "a/no.md": "plain", "a/bad.md": "---\na: [\n---\nx", "a/list.md": "---\n- a\n---\nx", "a/empty.md": "---\n---\nx"}
    for name, text in pages.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["entity_id"]: r for r in frontmatter.read_entities(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"one", "two"}
    one, two = got["one"], got["two"]
    assert (one["name"], one["entity_type"], one["confidence"], one["source_documents"], one["body"]) == ("A: b", "system", 1.0, ["d1"], "body --- more")
    assert (two["name"], two["entity_type"], two["confidence"], two["source_documents"]) == ("two", "team", 0.5, [])
    edges = frontmatter.frontmatter_edges(frontmatter.read_entities(spark, f"file://{tmp_path}")).collect()
    assert sorted((r["source_id"], r["rel_type"], r["target_id"]) for r in edges) == [("one", "owned_by", "team"), ("one", "related_to", "x"), ("one", "triggers", "block\ntext\n")]


def test_questions_are_understood(spark):
    asked = [(1, "Who owns the claims gateway team?"), (2, "list all systems and compare them"), (3, "How does the flow of steps work"), (4, None), (5, "zzz")]
    got = {r["qid"]: r for r in understand(spark.createDataFrame(asked, "qid long, question string")).collect()}
    assert got[1]["dominant"] == "ownership" and got[1]["edge_types"] == ["owned_by", "belongs_to", "managed_by", "executed_by"] and got[1]["keywords"] == ["owns", "claims", "gateway", "team"]
    assert got[2]["is_listing"] and got[2]["is_comparison"] and got[2]["dominant"] == "listing" and got[2]["edge_types"] is None
    assert got[3]["dominant"] == "process" and "triggers" in got[3]["edge_types"] and got[3]["l_behavioral"] == 1.5
    assert got[4]["dominant"] == got[5]["dominant"] == "entity" and got[5]["w_entity"] == 0.3 and not got[5]["is_listing"]


def test_graph_list_keeps_its_order_and_known_ids(spark):
    edges = spark.createDataFrame([("a", "x", "r"), ("a", "c", "r"), ("b", "d", "q"), ("x", "e", "r"), ("c", "b", "r")], "source_id string, target_id string, rel_type string")
    seeds = spark.createDataFrame([(1, "b", 1), (1, "a", 0)], "qid long, id string, ord int")
    known = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    got = search.graph_search(seeds, edges, known=known).orderBy("ord").collect()
    assert [(r["id"], r["hop"], r["rel_from"], r["rel_type"]) for r in got] == [("a", 0, None, None), ("b", 0, None, None), ("c", 1, "a", "r"), ("d", 1, "b", "q")]


def test_provenance_and_caps_of_listings(spark):
    row = "qid long, entity_id long, rank int, score double"
    lists = [spark.createDataFrame(r, row) for r in ([(1, 7, 0, 0.9)], [(1, 7, 0, 4.0), (1, 8, 1, 1.0)], [(1, 8, 0, 1.0)])]
    graph = spark.createDataFrame([(1, 8, 2, 7, "r"), (1, 7, 0, None, None)], "qid long, entity_id long, hop int, rel_from long, rel_type string")
    got = {r["entity_id"]: r for r in fuse.rrf(fuse.union_methods(vector=lists[0], keyword=lists[1], graph=lists[2]), graph=graph).collect()}
    assert (got[7]["found_by"], got[7]["matched_by"], got[7]["hop"]) == ("vector,keyword", "keyword", None)
    assert (got[8]["found_by"], got[8]["matched_by"], got[8]["hop"], got[8]["rel_from"]) == ("keyword,graph", "keyword", 2, 7)
    rows = spark.createDataFrame([(q, i, 1.0 - i / 10, "t", "l", q == 2, q == 3) for q in (1, 2, 3) for i in range(6)], "qid long, entity_id long, score double, entity_type string, layer string, is_listing boolean, is_comparison boolean")
    assert {r["qid"]: r["n"] for r in fuse.diversify(rows).groupBy("qid").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 6, 3: 3}

"""Lists of questions that have a vector but no row of their own, against SQL."""

import random

import pytest

from kbquarry.plans import QUERIES, SQL, kb_queries, more_queries


def test_graph_search_null_type_names_no_edge(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", None)], "source_id string, target_id string, rel_type string")
    seeds = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "a", 0)], "qid long, id string, ord int")
    types = spark.createDataFrame([(1, None), (3, None), (3, "r")], "qid long, rel_type string")
    got = kb_queries.search.graph_search(seeds, edges, types=types)
    assert {(r["qid"], r["id"]) for r in got.collect()} == {(1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b")}


def test_questions_without_a_row_keep_their_seeds_only(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    rng, d = random.Random(3), str(tmp_path)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    tables = {
        "documents": ([(i, text(12), rng.choice(["en", "de"]), f"src{i % 4}", 40) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(i, text(8)) for i in range(3)], "item_id long, text string"),
        "embeddings": ([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)], "vec_id long, embedding array<float>"),
    }
    oracle = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
        oracle.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    lists = kb_queries.method_lists(spark, d)
    assert {r["qid"] for r in lists[0].collect()} == set(range(7))
    assert {r["qid"] for r in lists[2].where("hop > 0").collect()} <= {0, 1, 2}
    monkeypatch.setattr(kb_queries, "method_lists", lambda s, d: lists)
    assert more_queries.candidates is kb_queries.candidates
    for name in ("u1_union_methods", "r5_rrf", "r7_provenance", "r9_dedup_exact", "r17_merge_subqueries", "w2_rank_within"):
        df = QUERIES[name](spark, d)
        want = oracle.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr), name

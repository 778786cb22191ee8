"""Graph search by hops alone, and the edges that it probes."""

import random

import pytest
from pyspark.sql import functions as F

from kbquarry.operators import search
from kbquarry.plans import adapters


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_graph_search_without_visits(spark, most):
    """Hops alone, by brute force: repeated edges, cycles, two seeds of a question, ids that lead nowhere."""
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", "r", f"n{rng.randrange(60)}") for _ in range(90)]
    edges += edges[:20] + [("hub", "s", f"n{i}") for i in range(60)] + [(f"n{i}", "s", "hub") for i in range(3)]
    seeds = [(q, f"n{q}", 0) for q in range(8)] + [(7, "n3", 1), (9, "none", 0)]
    want = {(q, i): 0 for q, i, _ in seeds}
    for hop in (1, 2, 3):
        for q, i in [k for k, h in want.items() if h == hop - 1]:
            for a, _, b in edges:
                if a == i:
                    want.setdefault((q, b), hop)
    e, s = spark.createDataFrame(edges, "source_id string, rel_type string, target_id string"), spark.createDataFrame(seeds, "qid long, id string, ord int")
    got = search.graph_search(s, e, visits=False, keep=False, most=most)
    assert got.columns == ["qid", "id", "hop", "score"] and {(r["qid"], r["id"]): r["hop"] for r in got.collect()} == want and got.count() == len(want)
    assert {(r["qid"], r["id"]): r["hop"] for r in search.graph_search(s, e, most=most).collect()} == want


def test_edges_that_leave_a_front_are_found_without_sorting_the_graph(spark):
    edges = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("to"))
    front = spark.createDataFrame([("3",), ("3",), ("7",), ("-",)], "id string")
    assert all(sorted(r["id"] for r in search.leaving(edges, front, most).collect()) == ["3", "7"] for most in (10, 0))


def test_edges_of_the_tables_may_repeat_without_a_shuffle(spark):
    once, every = (adapters.edges(spark, "/root/testdata/sf0.001", once) for once in (True, False))
    assert "Exchange" not in every._jdf.queryExecution().executedPlan().toString()
    assert every.count() > once.count() and every.distinct().count() == once.distinct().count() == once.count()

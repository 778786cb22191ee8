"""Searches by tiles against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from kbquarry.operators import search
from kbquarry.operators.tiled_scores import tiled_top_k


@pytest.mark.parametrize("per_block,asked_per_block", [(1_000_000, 200_000), (300, 20)])
def test_tiles_equal_all_hits(spark, per_block, asked_per_block):
    rng = random.Random(5)
    postings = [(f"hot{j}", i, rng.choice([1, 1, 2])) for j in range(3) for i in range(300)] + [(f"rare{j}", rng.randrange(300), 9) for j in range(20)]
    postings += postings[:40] + [("hot0", None, 50), ("hot0", None, 1)]  # repeated ones add up
    asked = [(q, t, rng.choice([1, 2])) for q in range(25) for t in (f"hot{q % 3}", f"rare{q % 20}", "none")] + [(3, "hot0", 1), (99, "none", 1), (98, "hot1", 0)]
    score: dict = {}
    for q, t, f in asked:
        for term, e, w in postings:
            if term == t and f > 0:
                score.setdefault(q, {}).setdefault(e, []).append(f * w)
    want = []
    for q, by in score.items():
        best = sorted((-sum(v), -1 if e is None else e, e) for e, v in by.items())[:5]
        want += [(q, e, -float(s), r) for r, (s, _, e) in enumerate(best)]
    p, a = spark.createDataFrame(postings, "term string, entity_id long, weight int"), spark.createDataFrame(asked, "qid long, term string, factor int")
    got = [tuple(r) for r in tiled_top_k(p, a, 5, per_block=per_block, asked_per_block=asked_per_block).select("qid", "entity_id", F.col("score").cast("double"), "rank").collect()]
    key = lambda r: (r[0], r[3])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_tiles_take_names_as_ids_and_empty_sides(spark):
    p = spark.createDataFrame([("a", "b", 1), ("a", "a", 1), ("b", "c", 3)], "term string, entity_id string, weight int")
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 1)], "qid string, term string, factor int")
    assert [(r["entity_id"], r["score"]) for r in tiled_top_k(p, a, 2).orderBy("rank").collect()] == [("c", 3.0), ("a", 1.0)]
    assert tiled_top_k(p.limit(0), a, 2).count() == 0 and tiled_top_k(p, a.limit(0), 2).count() == 0


def test_keyword_search_shuffles_no_hits(spark):
    """Every entity holds every word of every question: 500 entities x 40 questions x 20 words are 400 000 hits."""
    text = " ".join(f"w{i}" for i in range(20))
    e = spark.range(500).select(F.col("id").alias("entity_id"), F.lit("n").alias("name"), F.lit("d").alias("description"), F.lit(text).alias("body"))
    q = spark.range(40).select(F.col("id").alias("qid"), F.lit(text).alias("question"))
    found = search.keyword_search(q, e, 3)
    assert [tuple(r) for r in found.where("qid = 7").orderBy("rank").collect()] == [(7, i, 1.0, i) for i in range(3)]
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "term" not in plan.split("== Physical Plan ==")[1]  # no join on words after the tiles


def test_vector_search_ranks_what_it_shows(spark):
    """Cosines that differ after the digits asked for are ties, which go by id."""
    v = spark.createDataFrame([(2, [1.0, 1e-6]), (1, [1.0, 2e-4]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "entity_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<double>")
    ids = lambda **how: [r["entity_id"] for r in search.vector_search(q, v, 3, **how).orderBy("rank").collect()]
    assert ids(digits=6) == [1, 2, 3] and ids() == [2, 3, 1]


def test_pairs_are_dealt_to_tasks_of_a_bounded_number_of_rows(spark):
    """One shuffle, before any hash table of pairs, and as many tasks as the rows need."""
    from kbquarry.plans.adapters import distinct_pairs

    rows = spark.range(1000).select((F.col("id") % 300).alias("a"), (F.col("id") % 7).alias("b"))
    found = distinct_pairs(rows, "a", per_task=100)
    assert sorted(map(tuple, found.collect())) == sorted({(i % 300, i % 7) for i in range(1000)}) and found.rdd.getNumPartitions() == 10
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.rindex("HashAggregate") < plan.index("Exchange")


@pytest.mark.parametrize("per_block", [25_000, 30])
def test_pairs_of_sets_by_tiles_equal_all_pairs(spark, per_block):
    from kbquarry.operators.tiled_sets import overlapping_pairs, similar_pairs

    rng = random.Random(3)
    sets = {i: {f"w{int(rng.random() ** 3 * 30)}" for _ in range(rng.choice([1, 2, 4, 9, 14]))} for i in range(120)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(500, [])], "rep long, words array<string>")
    pairs = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b]
    for run, holds in ((similar_pairs, lambda c, n, m: c / (n + m - c) > 0.5), (overlapping_pairs, lambda c, n, m: c / min(n, m) > 0.5)):
        want = sorted((a, b) for a, b, c in pairs if holds(c, len(sets[a]), len(sets[b])))
        assert want and sorted(tuple(r) for r in run(df, 0.5, per_block=per_block).collect()) == want
        assert run(df.limit(0), 0.5).count() == 0


def test_question_pairs_carry_no_words_through_a_shuffle(spark, monkeypatch):
    """Candidates are counted within tasks: no join verifies them on the sets"""
    from kbquarry.operators import resolve

    seen = []
    monkeypatch.setattr(resolve, "keep_first", lambda rows, members, links: seen.append(links) or rows)
    verified = []
    monkeypatch.setattr(resolve, "_verified", lambda found, *a: verified.append(1) or found)
    qs = spark.createDataFrame([(1, "which service stores customer orders"), (2, "which service stores customer orders today"), (3, "who owns billing")], "id long, question string")
    resolve.dedup_questions(qs, ["which", "who"])
    assert not verified and seen[0].select("a.rep", "b.rep").distinct().collect() == [(1, 2)]


def test_vector_search_ranks_no_more_rows_of_a_larger_table(spark, monkeypatch):
    """A query's rows to rank come from a fixed number of blocks, not from one block more for every ``per_block`` rows."""
    rng, seen, last = random.Random(9), [], search.top_k
    vectors = [[rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(6)] for _ in range(800)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "entity_id long, embedding array<double>")
    asked = df.where("entity_id % 100 = 0").select(F.col("entity_id").alias("qid"), "embedding")
    monkeypatch.setattr(search, "top_k", lambda rows, *a: seen.append(rows) or last(rows, *a))
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / max(1e-12, sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 9)
    found = sorted((r["qid"], r["rank"], r["entity_id"]) for r in search.vector_search(asked, df, 4, per_block=10).collect())
    want = [(q, r, e) for q in range(0, 800, 100) if any(vectors[q]) for r, (_, e) in enumerate(sorted((-cosine(vectors[q], v), e) for e, v in enumerate(vectors))[:4])]
    assert found == want and seen[0].count() <= 8 * 4 * 16


def test_labels_meet_documents_without_a_shuffle_of_texts(spark, tmp_path):
    """Also where labels are over the size that Spark broadcasts by itself; more than ``most`` labels take the shuffle and give the same rows."""
    from kbquarry.plans import adapters

    spark.createDataFrame([(i, f"text {i}", "en", f"src{i}", 6) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i % 30, i % 2, i % 3) for i in range(35)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = adapters.entities(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
        few, many = (sorted(map(repr, adapters.entities(spark, str(tmp_path), *most).collect())) for most in ((), (10,)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and few == many and len(few) == 55


def test_pairs_of_large_sets_equal_all_pairs_a_few_matches_at_a_time(spark):
    """Sets of up to 200 words, most of them edited copies, so that sizes, places and bits all decide"""
    from kbquarry.operators.tiled_sets import overlapping_pairs, similar_pairs

    rng = random.Random(6)
    sets: dict = {}
    for i in range(90):
        old = list(sets[rng.randrange(i)]) if i > 5 and rng.random() < 0.7 else []
        kept = {w for w in old if rng.random() < rng.choice([0.5, 0.8, 1.0])}
        sets[i] = kept | {f"w{int(rng.random() ** 2 * 900)}" for _ in range(rng.choice([1, 3, 30, 120]) if len(kept) < 120 else 1)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "rep long, words array<string>")
    pairs = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b]
    for run, t, holds in ((similar_pairs, 0.55, lambda c, n, m: c / (n + m - c) > 0.55), (overlapping_pairs, 0.7, lambda c, n, m: c / min(n, m) > 0.7)):
        want = sorted((a, b) for a, b, c in pairs if holds(c, len(sets[a]), len(sets[b])))
        for how in ({"matches": 40, "least": 20}, {}):
            assert len(want) > 10 and sorted(tuple(r) for r in run(df, t, **how).collect()) == want


def test_a_tile_meets_many_sets_at_a_time(spark, tmp_path):
    """What holds is asked for many pairs at a time, not set by set"""
    import numpy as np

    from kbquarry.operators.tiled_sets import tiled_pairs

    def keep(c, n, m):
        with open(tmp_path / "asked", "a") as f:
            f.write("x")
        return c / (n + m - c) > 0.5

    rng = random.Random(2)
    df = spark.createDataFrame([(i, [f"w{rng.randrange(60)}" for _ in range(5)]) for i in range(1_000)], "rep long, words array<string>")
    first = lambda size: np.floor(0.5 * size).astype(np.int64) + 1
    assert tiled_pairs(df, keep, first, first).count() and (tmp_path / "asked").stat().st_size < 100

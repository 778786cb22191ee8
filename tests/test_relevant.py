"""Entities that texts name (J7) against brute force, and how their pairs are dealt."""

import random

from pyspark.sql import functions as F

from kbquarry.operators import dictionary


def test_relevant_entities_equal_all_pairs(spark):
    rng = random.Random(11)
    words = [f"word{i:02}" for i in range(30)] + ["abc", "of"]
    entities = [(i, f"n{i}", " ".join(rng.choice(words) for _ in range(3))) for i in range(40)] + [(40, "n40", None), (41, "n41", ""), (42, "n42", "word01 word01 x")]
    docs = [(d, " ".join(rng.choice([*words, f"N{rng.randrange(43)}"]).title() for _ in range(rng.randrange(30)))) for d in range(60)]
    docs += [(5, "Word01 word01 X"), (None, "word02 n3"), (None, "word03"), (7, None), (61, "")]  # rows that share a doc_id are one document
    texts: dict = {}
    for d, text in docs:
        texts.setdefault(d, []).append((text or "").lower())
    want = []
    for d, own in texts.items():
        has = lambda s, own=own: any(s in t for t in own)
        scores = [(3 * has(n.lower()) + 2 * has(i) + sum(has(w) for w in n.split() if len(w) >= 4), e) for e, i, n in entities if n]
        want += [(d, e, float(s), r) for r, (s, e) in enumerate(sorted(((s, e) for s, e in scores if s), key=lambda x: (-x[0], x[1]))[:5])]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(entities, "entity_id long, id string, name string")
    for per_task in (5_000, 7):
        got = [tuple(r) for r in dictionary.relevant_entities(d, e, 5, per_task=per_task).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_found_strings_are_dealt_before_any_hash_table(spark):
    """By doc_id, so many texts a task: no table of pairs grows with what a task reads, and no list of hits is joined."""
    texts = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    found = dictionary.find_strings(texts, spark.createDataFrame([("some",), ("text",)], "pattern string"), per_task=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and ", 10), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    assert plan.rindex("HashAggregate") < plan.index("Exchange") and found.count() == 200

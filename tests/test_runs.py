"""Names matched one to one, recall of a ground truth and differences of two runs, against brute force."""

import random

import pytest

from kbquarry.operators import matching


def brute(a, b, at):
    """Classes by kind and word set, their pairs in order, rows in the order of ids"""
    from kbquarry.ontology import NAME_STOPS

    classes = {}
    for side, rows in enumerate((a, b)):
        for i, kind, name in rows:
            words = frozenset((name or "").lower().split()) - set(NAME_STOPS)
            if words and kind is not None:
                classes.setdefault((kind, words), ([], []))[side].append(i)
    named = {min([(0, i) for i in c[0]] + [(1, i) for i in c[1]]): (k, sorted(c[0]), sorted(c[1])) for k, c in classes.items()}
    pairs = []
    for x, ((kx, wx), _, _) in named.items():
        for y, ((ky, wy), _, _) in named.items():
            score = round(len(wx & wy) / len(wx | wy), 9)
            if kx == ky and score >= at:
                pairs.append((-score, x, y))
    out = []
    for score, x, y in sorted(pairs):
        left, right = named[x][1], named[y][2]
        while left and right:
            out.append((left.pop(0), right.pop(0), -score))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_names_match_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    name = lambda: " ".join(rng.sample(["red", "blue", "queue", "gate", "claim", "router", "ledger"], rng.randint(1, 4)))
    hot = "claim router ledger"
    rows = lambda n: [(i, rng.choice(["system", "process"]), hot if rng.random() < 0.3 else name()) for i in rng.sample(range(1000), n)]
    a, b = rows(60), rows(45)
    a += [(2000, None, hot), (2001, "system", None), (2002, "system", "")]
    schema = "id long, kind string, name string"
    found = matching.match_names(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.5).collect()
    assert sorted(map(tuple, found)) == brute(a, b, 0.5)


def test_recall_and_differences(spark):
    schema = "entity_id string, entity_type string, name string"
    truth = [("a", "system", "claims gateway"), ("b", "system", "queue"), ("c", "process", "claim routing"), ("d", "role", "clerk"), ("d", "role", "clerk"), (None, "role", "x")]
    there = [("a", "system", "other"), ("b", "process", "queue"), ("c2", "process", "claim routing flow"), ("z", "process", "ledger"), ("c3", "system", "claim routing")]
    t, e = spark.createDataFrame(truth, schema), spark.createDataFrame(there, schema)
    rows = matching.ground_truth_recall(e, t)
    assert {(r["entity_id"], r["what"], r["found_id"], r["found_type"]) for r in rows.collect()} == {("a", "found", "a", None), ("b", "type-mismatch", None, "process"), ("c", "id-mismatch", "c2", None), ("d", "absent", None, None)}
    assert tuple(matching.recall(rows).first()) == (4, 1, 1, 1, 1, 0.25)
    assert tuple(matching.recall(matching.ground_truth_recall(e, t.limit(0))).first()) == (0, 0, 0, 0, 0, None)
    after = [("a", "system", "claims gateway two"), ("b", "system", "queue"), ("c9", "process", "claim routing"), ("e", "role", "judge"), ("d", "process", "clerk")]
    before = [r for r in dict.fromkeys(truth) if r[0]] + [("f", None, "never seen")]
    diff = matching.kb_diff(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema))
    assert {tuple(r) for r in diff.collect()} == {("a", "a", "changed"), ("b", "b", "same"), ("c", "c9", "renamed"), ("d", "d", "retyped"), ("f", None, "lost"), (None, "e", "added")}


def test_counts_of_two_runs(spark):
    schema = "entity_type string, source string"
    one, two = spark.createDataFrame([("system", "x"), ("role", "x"), ("role", None)], schema), spark.createDataFrame([("role", "y")], schema)
    assert {tuple(r) for r in matching.run_counts(one, two).collect()} == {("source", "x", 2, 0), ("source", None, 1, 0), ("source", "y", 0, 1), ("entity_type", "system", 1, 0), ("entity_type", "role", 2, 1)}

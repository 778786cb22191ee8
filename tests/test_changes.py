"""Merges, imports and proposals against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from kbquarry.operators import imports, merges
from kbquarry.streaming.tables import KeyedTable, latest

ENTITY = "entity_id long, name string, confidence double, source_documents array<string>, relationships map<string, array<string>>, body string"


def sequential(entities, verdicts):
    live, log = {e[0]: [e[1], e[2], sorted(set(e[3] or [])), {k: list(dict.fromkeys(v)) for k, v in (e[4] or {}).items()}, (e[5] or "").strip(" "), 1] for e in entities}, {}
    for pos, a, b, action, keep_id in sorted(verdicts):
        keep, gone = (b, a) if keep_id == b else (a, b)
        log[pos] = "kept" if action != "merge" else "skipped" if a == b or keep not in live or gone not in live else "merged"
        if log[pos] == "merged":
            k, g = live[keep], live.pop(gone)
            k[1], k[2], k[5] = max(0.5 if k[1] is None else k[1], 0.5 if g[1] is None else g[1]), sorted({*k[2], *g[2]}), k[5] + g[5]
            for rel, targets in g[3].items():
                own = k[3].setdefault(rel, [])
                own += [t for t in targets if t not in own]
    return {i: (e[0], 0.5 if e[1] is None else e[1], e[2] or None, e[3] or None, e[5]) for i, e in live.items()}, log


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_follow_the_order_of_verdicts(spark, seed):
    rng = random.Random(seed)
    entities = [(i, f"n{i}", rng.choice([None, rng.random()]), rng.sample(["x", "y", "z"], rng.randrange(3)), {"r": rng.sample(["1", "2", "3"], rng.randrange(1, 3))} if rng.random() < 0.6 else None, "") for i in range(25)]
    verdicts = []
    for pos in range(40):
        a, b = rng.randrange(27), rng.randrange(27)
        verdicts.append((pos, a, b, rng.choice(["merge", "merge", "merge", "keep"]), rng.choice([a, b, None])))
    want, log = sequential(entities, verdicts)
    after, told = merges.apply_merges(spark.createDataFrame(entities, ENTITY), spark.createDataFrame(verdicts, "pos long, a long, b long, action string, keep_id long"))
    assert {r["pos"]: r["status"] for r in told.collect()} == log
    assert {r["entity_id"]: (r["name"], r["confidence"], r["source_documents"], r["relationships"], r["members"]) for r in after.collect()} == want


def test_bodies_move_on_with_the_merged(spark):
    e = spark.createDataFrame([(i, f"n{i}", 0.5, [], None, b) for i, b in enumerate([" zero ", "one", "two", "", "one"])], ENTITY)
    v = spark.createDataFrame([(1, 1, 2, "merge", 1), (2, 0, 1, "merge", 0), (3, 0, 3, "merge", None), (4, 0, 4, "merge", 0), (5, 1, 4, "merge", 1)], "pos long, a long, b long, action string, keep_id long")
    after, log = merges.apply_merges(e, v)
    assert [r["body"] for r in after.collect()] == ["zero\n\n## Additional Details (merged from n1)\n\none\n\n## Additional Details (merged from n2)\n\ntwo"]
    assert [r["status"] for r in log.orderBy("pos").collect()] == ["merged"] * 4 + ["skipped"]
    none, empty = merges.apply_merges(e.limit(0), v.limit(0))
    assert none.count() == 0 and empty.count() == 0


ITEM = "pos long, directory string, id string, valid boolean, name string"
TABLE = "directory string, id string, name string, created_at timestamp, updated_at timestamp, updated_by string"


def sequential_import(items, there, on_conflict):
    seen, table, out = set(), set(there), []
    for pos, directory, i, valid, _ in items:
        if not valid or i is None:
            out.append((pos, "failed"))
        elif i in seen:
            out.append((pos, "failed"))
        elif (directory, i) in table and on_conflict != "overwrite":
            out.append((pos, "skipped" if on_conflict == "skip" else "failed"))
            seen |= {i} if on_conflict == "skip" else set()
        else:
            out.append((pos, "updated" if (directory, i) in table else "created"))
            seen.add(i)
    return out


@pytest.mark.parametrize("on_conflict", ["error", "skip", "overwrite"])
def test_import_equals_the_sequential_one(spark, tmp_path, on_conflict):
    rng = random.Random(4)
    items = [(p, rng.choice("ab"), rng.choice(["i1", "i2", "i3", "i4", "i5", None]), rng.choice([True, True, None, False]), f"v{p}") for p in range(40)]
    there = [("a", "i1"), ("b", "i1"), ("a", "i2"), ("b", "i9")]
    df, now = spark.createDataFrame(items, ITEM), F.lit("2024-06-01").cast("timestamp")
    old = spark.createDataFrame([(*k, "old") for k in there], "directory string, id string, name string").withColumns({"created_at": F.lit("2024-01-01").cast("timestamp"), "updated_at": F.lit("2024-01-01").cast("timestamp"), "updated_by": F.lit("x")})
    after, outcome, events = imports.bulk_import(df, old, now, on_conflict)
    want = sequential_import(items, there, on_conflict)
    assert sorted((r["pos"], r["status"]) for r in outcome.collect()) == want
    written = {p for p, s in want if s in ("created", "updated")}
    kept = {(r["directory"], r["id"]): (r["name"], r["created_at"].month, r["updated_by"]) for r in after.collect()}
    plain = {k: ("old", 1, "x") for k in there} | {(i[1], i[2]): (i[4], 1 if (i[1], i[2]) in there else 6, "import") for i in items if i[0] in written}
    assert kept == plain and events.count() == len(written)
    table = KeyedTable(spark, imports.KEY, TABLE, latest(imports.KEY, "updated_at"), f"file://{tmp_path}/t", buckets=3)
    table.upsert(old, 0)
    for _ in range(2):  # the second run changes nothing
        got = imports.import_batch(table, df, 1, now, f"file://{tmp_path}/events", on_conflict)
        assert sorted((r["pos"], r["status"]) for r in got.collect()) == want
        assert {(r["directory"], r["id"]): (r["name"], r["created_at"].month, r["updated_by"]) for r in table.read().collect()} == plain
    assert spark.read.parquet(f"file://{tmp_path}/events").count() == len(written)


def test_proposals(spark):
    rows = [(1, "new", False, True, None, "N"), (2, "old", False, True, None, "O"), (3, "old", True, True, "", "O"), (4, "none", True, True, "why", "X"), (5, "bad", False, False, None, "B"), (6, "old", True, True, "because", "P"), (7, None, False, True, None, "Z")]
    items = spark.createDataFrame(rows, "pos long, id string, update boolean, valid boolean, rationale string, name string")
    there = spark.createDataFrame([("old",)], "id string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    staged, outcome, events = imports.stage_proposals(items, there, F.lit("2024-06-01").cast("timestamp"))
    assert [(r["status"], r["error"]) for r in outcome.orderBy("pos").collect()] == [("proposed", None), ("failed", "already exists"), ("proposed-update", None), ("failed", "does not exist"), ("failed", "invalid"), ("proposed-update", None), ("failed", "invalid")]
    assert sorted((r["id"], r["name"], r["created_at"].month) for r in staged.collect()) == [("new", "N", 6), ("old", "P", 1)]
    assert [(r["action"], r["summary"]) for r in events.orderBy("pos").collect()] == [("proposed", "N"), ("proposed-update", "update old"), ("proposed-update", "because")]

"""Vector index, packs, streams with state: against brute force and by hand."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbquarry.operators import ann_index, mention_state, packs, resolve, scan, search
from kbquarry.streaming import jobs, tables

AT = datetime.datetime(2024, 1, 1)


def minutes(n):
    return AT + datetime.timedelta(minutes=n)


def test_places_and_running_sums(spark):
    df = spark.createDataFrame([(v % 3, v, None if v == 7 else v) for v in range(50)] + [(None, 1, 1)], "a int, b int, v int").repartition(7)
    got = [(r["place"], r["a"], r["b"]) for r in scan.numbered(df, "a", "b").orderBy("place").collect()]
    want = sorted(((v % 3, v) for v in range(50)), key=lambda x: x)
    assert got == [(0, None, 1), *[(i + 1, *x) for i, x in enumerate(want)]]
    sums, total = scan.running(df, F.col("v"), "a", "b").orderBy("a", "b").collect(), 0
    for r in sums:
        total += r["v"] or 0
        assert r["total"] == total
    assert scan.numbered(df.limit(0), "a").count() == 0


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_vector_index_finds_most_and_meets_few(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 32)) if kind == "noise" else np.repeat(rng.standard_normal((30, 32)), 50, axis=0) + 0.3 * rng.standard_normal((1500, 32))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, [0.0] * 32), (5001, None), (5002, [float("nan")] * 32), (5003, [])]
    df = spark.createDataFrame(rows, "entity_id long, embedding array<double>")
    asked = df.where("entity_id % 10 = 0").selectExpr("entity_id as qid", "embedding")
    found = ann_index.ann_search(asked, df, 10).collect()
    exact = {(r["qid"], r["entity_id"]) for r in search.vector_search(ann_index.usable(asked, "qid"), ann_index.usable(df, "entity_id"), 10).collect()}
    assert len(exact & {(r["qid"], r["entity_id"]) for r in found}) >= 0.9 * len(exact)
    assert found[0]["recall"] >= 0.85 and found[0]["met"] < 0.1 and len(found) == 1500
    one = {(r["qid"], r["rank"]): r["score"] for r in found}
    assert all(one[q, 0] == 1.0 for q in range(0, 1500, 10))


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], "entity_id long, embedding array<float>")
    assert ann_index.ann_search(none.selectExpr("entity_id as qid", "embedding"), none, 3).count() == 0


def sequential_budget(rows, layers, budget):
    out, left = [], budget
    for layer in layers:
        run = 0
        for i, size in sorted((i, s or 0) for k, i, s in rows if k == layer):
            if run + size > left:
                break
            run += size
            out.append((layer, i, run))
        left -= run
    return sorted(out)


def test_layered_budget_equals_the_sequential_one(spark):
    rng = random.Random(1)
    for budget in (0, 7, 100, 10_000):
        rows = [(rng.choice("abcx"), i, rng.choice([0, 1, 5, 40, None])) for i in range(120)]
        df = spark.createDataFrame(rows, "layer string, i int, size int")
        got = packs.layered_budget(df, ["b", "a", "c"], [F.col("i")], "size", budget)
        assert sorted((r["layer"], r["i"], r["running"]) for r in got.collect()) == sequential_budget(rows, ["b", "a", "c"], budget)


def test_pack_text(spark):
    rows = [("e1", "One", "system", "structural", 0.9, "first", "Seen. Known.", ["owned by: t"]), ("e2", None, "data-model", "structural", 0.5, None, "", None), ("e3", "Three", "process", "behavioral", 1.0, "third", None, []), ("e4", "lost", "odd", "nowhere", 1.0, "x", None, [])]
    e = spark.createDataFrame(rows, "entity_id string, name string, entity_type string, layer string, confidence double, description string, overview string, relations array<string>")
    text = lambda **how: "\n".join(r["text"] for r in packs.export_pack(e, "T", ["structural", "behavioral"], **how).orderBy("section", "place").collect())
    start = "# T\n\n> 4 entities across 4 types.\n\n## Entity Types\n\n- **Data Model** (1)\n- **Odd** (1)\n- **Process** (1)\n- **System** (1)\n"
    one, two, three = "### One\n*system* | confidence: 0.9\n> first\n\nSeen. Known.\n\n- owned by: t\n", "### e2\n*data-model* | confidence: 0.5\n", "### Three\n*process* | confidence: 1.0\n> third\n"
    assert text() == f"{start}\n## Structural Layer\n\n{one}\n{two}\n## Behavioral Layer\n\n{three}"
    used = sum(map(len, start.split("\n"))) + sum(map(len, one.split("\n"))) + sum(map(len, two.split("\n")))
    assert text(max_tokens=-(-used // 4)) == f"{start}\n## Structural Layer\n\n{one}\n{two}\n## Behavioral Layer\n\n*(1 more entities truncated due to token budget)*"
    stats = {r["layer"]: r for r in packs.pack_stats(packs.export_pack(e, "T", ["structural", "behavioral"], max_tokens=-(-used // 4))).collect()}
    assert stats[None]["chars"] == len(text(max_tokens=-(-used // 4))) and (stats["behavioral"]["truncated"], stats["structural"]["entities"]) == (1, 2)


MENTION = "entity_type string, entity_id long, pos long, name string, status string, description string, confidence double, source string, tags string, relationships map<string, array<string>>, body string, details string"


def mention(i, rng):
    edges = {"uses": [f"x{rng.randrange(4)}", f"x{rng.randrange(4)}"], "owns": []} if rng.random() < 0.7 else None
    return (rng.choice("ab"), rng.randrange(4), i, f"n{i}", None, rng.choice(["", None, f"d{i}"]), rng.random(), rng.choice([None, "s1", "s2"]), f"t{i}", edges, f"b{i} ", rng.choice(["", None, f"more{i}"]))


def sequential_merge(rows):
    out = {}
    for kind, i, _, name, status, desc, conf, source, tags, edges, body, details in sorted(rows, key=lambda r: r[2]):
        new = (kind, i) not in out
        e = out.setdefault((kind, i), {"description": None, "confidence": 0, "sources": [], "relationships": {}, "body": body.rstrip(" "), "n": 0})
        e.update(name=name, status=status, tags=tags, description=e["description"] or desc or None, confidence=max(e["confidence"], conf), n=e["n"] + 1)
        if source is not None and source not in e["sources"]:
            e["sources"].append(source)
        for rel, targets in (edges or {}).items():
            for t in targets:
                own = e["relationships"].setdefault(rel, [])
                own += [] if t in own else [t]
        if not new and details:
            e["body"] += f"\n\n## Additional Details\n[from {source or ''}]\n\n{details}"
    return {k: (e["name"], e["status"], e["description"], e["confidence"], e["tags"], e["body"], e["n"], ",".join(e["sources"]), e["relationships"] or None) for k, e in out.items()}


def merged(df):
    return {(r["entity_type"], r["entity_id"]): (r["name"], r["status"], r["description"], r["confidence"], r["tags"], r["body"], r["n_mentions"], r["sources"], r["relationships"]) for r in df.collect()}


def test_merge_of_mentions_equals_the_sequential_one_in_one_or_many_folds(spark, tmp_path):
    rng = random.Random(2)
    rows = [mention(i, rng) for i in range(60)]
    want, df = sequential_merge(rows), spark.createDataFrame(rows, MENTION)
    assert merged(resolve.merge_mentions(df)) == want
    parts = [mention_state.fold_facts(mention_state.mention_facts(df.where(f"pos % 3 = {k}"))) for k in range(3)]
    assert merged(mention_state.entities_of(mention_state.fold_facts(parts[2].unionByName(parts[0]).unionByName(parts[1])))) == want
    for k in range(3):  # a file a batch
        df.where(f"pos % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(MENTION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = f"file://{tmp_path}/state"
    assert merged(jobs.merge_stream(stream(), state)) == want
    assert merged(jobs.merge_stream(stream(), state)) == want  # nothing new: nothing changes
    assert merged(resolve.merge_mentions(df.limit(0))) == {}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    table = tables.KeyedTable(spark, ["k"], "k string, n long", fold, f"file://{tmp_path}/t", buckets=4)
    batch = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    assert table.read().count() == 0
    table.upsert(batch(("a", 1), ("b", 2), ("a", 1)), 0)
    table.upsert(batch(("a", 5)), 1)
    table.upsert(batch(("a", 5)), 1)
    assert sorted(map(tuple, table.read().collect())) == [("a", 7), ("b", 2)]
    table.upsert(batch(("b", 1), ("c", 1)), 2)
    assert sorted(map(tuple, table.read().collect())) == [("a", 7), ("b", 3), ("c", 1)]
    table.upsert(batch(), 3)
    assert len(table.versions()) <= 4 and table.read().count() == 3


EVENT = "id long, at timestamp, effort_id string, kind string, is_gap boolean, outcome string, action string, actor string"


def stream_of(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{path}/in")
        files = sorted((path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        import os

        os.utime(files[-1], (1_700_000_000 + 100 * k,) * 2)  # the order in which they are read
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_efforts_with_timeouts_and_late_calls(spark, tmp_path):
    e = lambda n, who, kind, at, gap=False, outcome=None: (n, minutes(at), who, kind, gap, outcome, "x", "y")
    first = [e(1, "a", "open", 0), e(2, "a", "call", 5, True), e(3, "b", "open", 1), e(4, "c", "call", 3)]
    second = [e(5, "a", "end", 20, outcome="resolved"), e(6, "a", "call", 10), e(7, "d", "open", 200)]
    third, fourth = [e(9, "d", "call", 210)], [e(8, "b", "call", 10, True), e(10, "a", "end", 15, outcome="early")]  # beyond the watermark
    table = jobs.effort_table(stream_of(spark, tmp_path, [first, second, third, fourth]), f"file://{tmp_path}/state", idle_minutes=30)
    got = {r["effort_id"]: (r["started_at"], r["ended_at"], r["call_count"], r["gap_count"], r["outcome"]) for r in table.collect()}
    assert got == {"a": (minutes(0), minutes(20), 2, 1, "resolved"), "b": (minutes(1), minutes(1), 0, 0, "timeout"), "c": (minutes(3), minutes(3), 1, 0, "timeout"), "d": (minutes(200), None, 1, 0, None)}


def test_window_counts_come_early_and_whole(spark, tmp_path):
    e = lambda n, at, action: (n, minutes(at), "w", "call", False, None, action, "z")
    got = jobs.event_count_table(stream_of(spark, tmp_path, [[e(1, 1, "x"), e(2, 40, "x")], [e(3, 45, "x"), e(4, 50, "y")]]), f"file://{tmp_path}/state")
    assert sorted((r["start"], r["action"], r["n"]) for r in got.collect()) == sorted([(minutes(-30), "x", 1), (minutes(0), "x", 3), (minutes(30), "x", 2), (minutes(0), "y", 1), (minutes(30), "y", 1)])


def test_a_mention_is_one_row_of_facts_and_an_entity_one_row_of_state(spark, tmp_path):
    """What is shuffled and kept grows with mentions and entities, not with what each of them says"""
    rng = random.Random(4)
    df = spark.createDataFrame([mention(i, rng) for i in range(60)], MENTION)
    facts = mention_state.mention_facts(df)
    folded = mention_state.fold_facts(facts)
    n = df.select("entity_type", "entity_id").distinct().count()
    assert facts.count() == 60 and folded.count() == n
    for k in range(2):
        df.where(f"pos % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MENTION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.merge_stream(stream, f"file://{tmp_path}/state")
    state = tables.KeyedTable(spark, mention_state.ENTITY, mention_state.SCHEMA.format(id="bigint"), mention_state.merge_facts, f"file://{tmp_path}/state").read()
    assert state.count() == n
    sort = lambda df: sorted((tuple(r[c] for c in df.columns if c != "items"), sorted(map(tuple, r["items"]), key=str)) for r in df.collect())
    assert sort(state) == sort(folded)

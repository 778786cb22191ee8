"""Dictionary matching and impact-ordered search against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kbquarry.operators import dictionary
from kbquarry.operators.impact_index import ImpactIndex

NAMES = ["claims gateway", "claims", "gateway", "api", "naïve x", "a+b", "the owner", "owner team", "zz", "claims gateway v2"]
PIECES = ["claims", "gateway", "the", "owner", "team", "v2", "naïve", "x", "a+b", "zz", "apis", "api", "\n", "\n# ", "[[known]]", "é"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 25)))) for i in range(n)] + [(900, None), (901, "")]


@pytest.mark.parametrize("how", [{}, {"limit_bytes": 0}, {"limit_bytes": 0, "per_part": 2}])
def test_strings_in_texts(spark, how):
    rows = texts(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = spark.createDataFrame([(n,) for n in [*NAMES, "", None, "claims"]], "pattern string")
    got = sorted(map(tuple, dictionary.find_strings(df, names, **how).collect()))
    assert got == sorted((i, n) for i, t in rows for n in NAMES if t is not None and n in t)
    assert dictionary.find_strings(df, names.limit(0), **how).count() == 0


def linked(text, names):
    done, out = set(), []
    for line in text.split("\n"):
        if not line.startswith("#") and "[[" not in line:
            k, new = 0, ""
            while k < len(line):
                hit = next((n for n in sorted(names, key=lambda n: (-len(n), n)) if re.compile(r"\b" + re.escape(n) + r"\b").match(line, k)), None)
                new += line[k] if hit is None else hit if hit in done else f"[[{hit}]]"
                k += len(hit or "-")
                done |= {hit}
            line = new
        out.append(line)
    return "\n".join(out)


@pytest.mark.parametrize("how", [{}, {"limit_bytes": 0}])
def test_all_names_are_linked(spark, how):
    rows = texts(60, 2)
    got = {r["doc_id"]: r["text"] for r in dictionary.link_all(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(n,) for n in [*NAMES, None]], "name string"), **how).collect()}
    assert got == {i: None if t is None else linked(t, [n for n in NAMES if len(n) >= 4]) for i, t in rows}


def test_vault_pages(spark):
    e = spark.createDataFrame([("e1", "system", "Claims Gateway", "structural", "d", "# Claims Gateway\nneeds Owner Team and Claims Gateway\n"), ("e2", "team", "Owner Team", "organizational", None, None)], "entity_id string, entity_type string, name string, layer string, description string, body string")
    edges = spark.createDataFrame([("e1", "owned_by", "e2"), ("e1", "owned_by", "e0")], "source_id string, rel_type string, target_id string")
    got = {r["path"]: r["text"] for r in dictionary.vault(e, edges).collect()}
    assert got["system/e1.md"] == "---\ntype: system\nid: e1\nname: Claims Gateway\naliases:\n- e1\n- Claims Gateway\ndescription: d\n---\n\n# Claims Gateway\n\n## Relationships\n\n**Owned By:** [[e0]], [[Owner Team]]\n\nneeds [[Owner Team]] and [[Claims Gateway]]\n"
    assert got["team/e2.md"].endswith("\n# Owner Team\n") and got["index/structural/0.md"] == "## Structural\n\n- [[Claims Gateway]] (system)\n" and len(got) == 4


@pytest.mark.parametrize("block", [3, 64])
def test_impact_search_equals_all_hits(spark, block):
    rng = random.Random(3)
    postings = [(f"hot{j}", i, rng.choice([1, 1, 1, 2, 6])) for j in range(3) for i in range(400)] + [(f"rare{j}", rng.randrange(400), 9) for j in range(20)]
    postings = list({(t, e): (t, e, w) for t, e, w in postings}.values())
    asked = [(q, t, 1) for q in range(30) for t in {f"hot{q % 3}", f"hot{(q + 1) % 3}", f"rare{q % 20}", f"rare{(q * 3) % 20}", "none"}] + [(99, "none", 1), (98, "hot0", 1)]
    counts = []
    got = ImpactIndex.build(spark.createDataFrame(postings, "term string, entity_id long, weight int")).search(spark.createDataFrame(asked, "qid long, term string, factor int"), 5, block=block, counts=counts, direct=0)
    want = []
    for q in {a[0] for a in asked}:
        score = {}
        for _, t, f in (a for a in asked if a[0] == q):
            for term, e, w in postings:
                if term == t:
                    score[e] = score.get(e, 0) + f * w
        want += [(q, e, -s, r) for r, (s, e) in enumerate(sorted((-s, e) for e, s in score.items())[:5])]
    assert sorted((r["qid"], r["entity_id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)
    assert counts[0] < len(postings)


def test_impact_search_leaves_hot_lists_unread(spark):
    rows = [("hot", i, 1 + (i % 97 == 0)) for i in range(20_000)] + [("rare", i, 9) for i in range(30)]
    counts = []
    index = ImpactIndex.build(spark.createDataFrame(rows, "term string, entity_id long, weight int"))
    got = index.search(spark.createDataFrame([(1, "hot", 1), (1, "rare", 1)], "qid long, term string, factor int"), 10, counts=counts, direct=0)
    assert [r["entity_id"] for r in got.orderBy("rank").collect()] == [0, *range(1, 10)] and sum(counts) < 1000


def test_names_are_not_read_where_no_text_could_hold_them(spark):
    """A name that can't be read: nothing asks for it as long as no entity has a body"""
    broken = spark.range(3).select(F.col("id").cast("string").alias("name"), F.raise_error(F.lit("read")).cast("string").alias("pattern"))
    bodies = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert dictionary.find_strings(bodies, broken.select("pattern")).count() == 0
    linked = dictionary.link_all(bodies, broken.select(F.col("pattern").alias("name")))
    assert sorted(map(tuple, linked.collect())) == [(1, None), (2, "")]

import random

from pyspark.sql import functions as F

from kbquarry.components import connected_components
from kbquarry.functions import text as X
from kbquarry.functions.vectorized import html_to_text, link_mentions
from kbquarry.ontology import QUESTION_STOPS
from kbquarry.operators import fuse, resolve, search, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_are_the_transitive_closure(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(3)
    sets = [(i, rng.sample("abcdefghij", rng.randrange(0, 6))) for i in range(120)]
    members = resolve.set_members(spark.createDataFrame(sets, "id long, words array<string>"), [])
    links = resolve.similar_sets(members.where("id = rep").select("rep", "words"), 0.6, [])
    comps = dict(rows(connected_components(links.unionByName(members.selectExpr("rep as a", "id as b")))))
    links = [(i, j) for i, x in sets for j, y in sets if i < j and x and y and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))]
    assert comps == dict(rows(connected_components(spark.createDataFrame(links, "a long, b long"))))


def test_greedy_keep_first_equals_the_sequential_one(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)]
    near = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    kept = []
    for i in range(60):
        if not any((k, i) in near for k in kept):
            kept.append(i)
    got = resolve.greedy_keep_first(spark.range(60), spark.createDataFrame(pairs, "a long, b long"))
    assert [r[0] for r in rows(got)] == kept


def test_question_dedup_equals_the_sequential_one(spark):
    rng = random.Random(6)
    pool = ["could", "which", "claims", "gateway", "owner", "team", "about", "what", "is", "the", "flow", "process", "routing", "api"]
    questions = [(i, " ".join(rng.sample(pool, rng.randrange(0, 7)))) for i in range(150)] + [(500, None), (501, "the what is"), (502, "is the what")]
    words = {i: set((q or "").split()) for i, q in questions}
    content, long = {i: w - set(QUESTION_STOPS) for i, w in words.items()}, {i: {x for x in w - set(QUESTION_STOPS) if len(x) >= 5} for i, w in words.items()}
    near = lambda a, b: bool(content[a] and content[b] and len(content[a] & content[b]) / len(content[a] | content[b]) > 0.55) or bool(long[a] and long[b] and len(long[a] & long[b]) / min(len(long[a]), len(long[b])) > 0.7)
    kept = []
    for i, _ in questions:
        if not any(near(k, i) for k in kept):
            kept.append(i)
    got = resolve.dedup_questions(spark.createDataFrame(questions, "id long, question string"), QUESTION_STOPS)
    assert [r[0] for r in rows(got)] == kept


def test_names_dedup_without_names_and_suffixes(spark):
    df = spark.createDataFrame([(1, "system", None), (2, "process", None), (3, "system", ""), (4, "system", "claims gateway"), (5, "api", "Claims Gateway v2"), (6, "system", "gateway of claims"), (7, "api", "gateway of claims")] + [(100 + i, "system", "same name") for i in range(50)], "entity_id long, entity_type string, name string")
    got = dict(rows(resolve.dedup_classes(df)))
    assert {k: got[k] for k in range(1, 8)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4, 7: 4} and {got[100 + i] for i in range(50)} == {100}


def test_text_dedup_fold_and_judge(spark):
    long = " ".join(f"w{i}" for i in range(20))
    scored = spark.createDataFrame([(1, 1, 0.9, long), (1, 2, 0.8, long + " x"), (1, 3, 0.7, "other words"), (2, 2, 0.8, long + " x"), (2, 4, 0.1, None), (2, 5, 0.1, "")], "qid long, entity_id long, score double, description string")
    assert rows(resolve.dedup_text(scored).select("qid", "entity_id")) == [(1, 1), (1, 3), (2, 2), (2, 4), (2, 5)]
    e = spark.createDataFrame([(1, "a", None, ["z", "b"], {"owned_by": ["t"]}, "one"), (2, "b", 0.7, ["b", "c"], {"owned_by": ["u", "t"], "uses": ["x"]}, "two"), (3, "c", 0.2, [], {}, "one"), (4, "d", None, None, None, None)], "entity_id long, name string, confidence double, source_documents array<string>, relationships map<string, array<string>>, body string")
    got = {r["entity_id"]: r for r in resolve.fold_members(e, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "entity_id long, keep long")).collect()}
    assert (got[1]["name"], got[1]["confidence"], got[1]["source_documents"], got[1]["relationships"], got[1]["body"]) == ("a", 0.7, ["b", "c", "z"], {"owned_by": ["t", "u"], "uses": ["x"]}, "one\n\ntwo")
    assert (got[4]["confidence"], got[4]["members"], got[4]["relationships"]) == (0.5, 1, None)
    names = spark.createDataFrame([(1, "claims", 0.2), (2, "Claims v3", 0.9), (3, "other", None)], "entity_id long, name string, confidence double")
    assert rows(resolve.judge_pairs(spark.createDataFrame([(2, 1), (1, 2), (1, 3)], "a long, b long"), names)) == [(1, 2, "merge", 2), (1, 3, "keep", 3)]


def test_vector_blocks_and_buckets(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(200, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "entity_id long, embedding array<double>")
    asked = df.where("entity_id % 20 = 0").selectExpr("entity_id as qid", "embedding")
    one, many = (rows(search.vector_search(asked, df, 5, per_block=n).select("qid", "entity_id", F.round("score", 6))) for n in (5000, 30))
    assert one == many and len(one) == 50 and {q for q, _, _ in one} == set(range(0, 200, 20))


def test_graph_search_follows_edge_types(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "c", "q"), ("b", "d", "q")], "source_id string, target_id string, rel_type string")
    seeds = spark.createDataFrame([(1, "a", 0), (2, "a", 0)], "qid long, id string, ord int")
    got = search.graph_search(seeds, edges, types=spark.createDataFrame([(1, "r")], "qid long, rel_type string"))
    assert {(r["qid"], r["id"]) for r in got.collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d")}


def test_graph_search_first_visit_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "a", "r"), ("a", "c", "r"), ("b", "d", "r"), ("c", "d", "r"), ("d", "e", "r"), ("e", "f", "r")], "source_id string, target_id string, rel_type string")
    got = search.graph_search(spark.createDataFrame([(1, "a", 0)], "qid long, id string, ord int"), edges)
    assert {(r["id"], r["hop"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}


def test_scores_equal_are_not_boosted(spark):
    df = spark.createDataFrame([(1, 1, 0.1, 0.9, 5, 1), (1, 2, 0.1, 0.1, 0, 0)], "qid long, entity_id long, score double, confidence double, n_edges int, n_docs int")
    assert [r["score"] for r in fuse.adjust_scores(df).orderBy("entity_id").collect()] == [0.1, 0.1]


def test_budget_and_caps(spark):
    df = spark.createDataFrame([("x", i, 40, "t" if i < 4 else "u") for i in range(6)], "p string, i int, size int, g string")
    assert windows.take_until_budget(df, ["p"], [F.col("i")], "size", 120).count() == 3
    assert windows.cap_share(df, "p", "g", 0.5, [F.col("i")]).count() == 5


def test_text_functions(spark):
    df = spark.createDataFrame([("Ünder The_under x", "N", "# N\nbody\n## Open Questions\n- why so late\n- no\n## Z\n- not this one", "so [a] and [b]\nPARTIAL\nNOT_ANSWERABLE")], "t string, name string, body string, answer string")
    r = df.select(X.word_set(F.col("t")), X.clean_body(F.col("body"), F.col("name")), X.open_questions(F.col("body")), X.citations(F.col("answer")), X.answer_score(F.col("answer"))).first()
    assert r[0] == ["ünder", "the_under", "x"] and r[1] == "body" and r[2] == ["why so late"] and r[3] == ["a", "b"] and r[4] == "not_answerable"


def test_html_and_links(spark):
    df = spark.createDataFrame([("<title>T</title><nav>no</nav><p>a &amp; b</p><script>x</script>c", "# gateway\nthe gateway and gateway")], "h string, b string")
    r = df.select(html_to_text("h"), link_mentions(["gateway", "gat"])(F.col("b"))).first()
    assert r[0] == "T\n\na & b\n\nc" and r[1] == "# gateway\nthe [[gateway]] and gateway"

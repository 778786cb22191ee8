import collections
import random
import re
import string

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from kbquarry.llm import ann, bpe, line_dedup, maxent_lm, minhash, packing, quality_rules, substring_dedup, toxicity, url_filter

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (5, "x " * 3000), (None, "no id here at all")]


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def repeats(rows, window=35):
    count, out = collections.Counter(), {}
    split = [(i, (t or "").split()) for i, t in rows]
    for _, w in split:
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    for i, w in split:
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substring_dedup_equals_brute_force(spark, hot):
    shared, other = words(60, 1), words(36, 2)
    rows = [(i, " ".join(words(50, 10 + i) + (shared[i % 5 : 40 + i % 20] if i % 2 else other) + words(30, 90 + i))) for i in range(30)]
    rows += [(100, " ".join(other[:34])), (101, " ".join(words(45, 7) * 2)), (102, rows[0][1]), (103, None), (104, ""), (105, "a " * 80)]
    for i in range(12):  # edits that repeat elsewhere, near and far from each other
        w = list(words(200, 4))
        for k in (20 + 3 * i, 60 + i, 100, 103 + i, 150 + 2 * i):
            w[k] = f"e{k % 3}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, "long " * 40_000)]
    got = substring_dedup.remove_repeats(spark.createDataFrame([(*r, 1, 2) for r in rows], DOC + ", rid int, own int"), hot=hot, per_index=7)
    assert {r["doc_id"]: r["kept_text"] for r in got.collect()} == repeats(rows)
    same = [(1, " ".join(words(50, 1))), (1, " ".join(words(20, 2) + words(50, 1)[:30])), (1, " ".join(words(50, 1))), (None, " ".join(words(40, 5))), (None, " ".join(words(40, 5) + ["x"]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(same, DOC), hot=hot)
    assert sorted((r["n_words"], r["n_removed"]) for r in got.collect()) == [(40, 40), (41, 40), (50, 0), (50, 50), (50, 50)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


def test_bpe_round_trip_and_library(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice([" ", "  ", "\n", "foo", "'s", "é", "日本", "12", ".", "\x1c", "　", "😀"]) for _ in range(12)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "a" * 3000])]
    coded = bpe.decode(bpe.encode(spark.createDataFrame(rows, DOC), path, P.PATTERN), path)
    for r in coded.collect():
        text = rows[r["doc_id"]][1] or ""
        assert r["ids"] == own.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


def test_fold_table_equals_the_library(spark):
    path, rng = P.path("byte_bpe_50k.tiktoken"), random.Random(5)
    ranks = bpe.load_ranks(path)
    texts = sorted({"".join(rng.choice(["th", "e", "é", "日", "1", ".", " ", "ing", "q", "zx"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)} | {"a", "hello", "aaaaaaaaaaaa"})
    got = bpe.fold_table(spark.createDataFrame([(t,) for t in [*texts, ""]], "word string"), path).collect()
    assert {r["word"]: r["ids"] for r in got} == {t: bpe.fold_merges(t.encode(), ranks) for t in texts}


def test_bpe_odd_rows(spark):
    rows = [*ODD, ((1 << 53) + 1, "wide id"), ((1 << 53) + 1, "wide id"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", n_tokens string")
    got = bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    assert bpe.digests(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_quality_and_urls_odd_rows(spark):
    docs = spark.createDataFrame([(*r, None, "x") for r in ODD], DOC + ", source string, n_words string")
    assert [r["kept"] for r in quality_rules.quality(docs).collect()].count(False) == len(ODD)
    assert quality_rules.quality(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, "h"), (None, "http://a.b/" + "x" * 100_000, "h"), (1, None, "h")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert [r["verdict"] for r in url_filter.filter_urls(pages, none, []).collect()] == ["allow"] * 3
    assert url_filter.filter_urls(pages.limit(0), none, []).count() == 0


def test_url_rules_and_shrinkage(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.net/en/x?q"), (2, "http://example.net"), (3, None), (4, "no scheme"), (5, "https://m.spam.org/a"), (6, "https://x.example.com/de/1#t")], "page_id long, url string")
    bad = spark.createDataFrame([(5, True)], "page_id long, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, bad, [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block")]).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "", None, "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[6][2:] == ("example.com/de/", "block")
    many = spark.createDataFrame([(f"h{i % 4}.{'bad' if i % 4 == 0 else 'good'}.org", i % 4 == 0) for i in range(400)], "host string, bad boolean")
    lower = {r["host"]: r["lower"] for r in url_filter.reputation(many).collect()}
    assert lower["h0.bad.org"] > 0.5 > lower["h1.good.org"]


def test_url_hosts_without_labels_follow_domain_and_suffix(spark):
    hosts = [f"h{i % 4}.{d}" for d in ("bad.org", "good.org", "worse.zz", "evil.zz", "fine.aa") for i in range(80)]
    bad = [not ("good" in h or "fine" in h) for h in hosts]
    new = ["new.bad.org", "new.good.org", "new.unseen.zz", "new.unseen.aa", "new.unseen.qq"]
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts + new)], "page_id long, url string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(list(enumerate(bad)), "page_id long, bad boolean"), []).collect()
    verdict = {r["host"]: r["verdict"] for r in got}
    assert len(got) == len(hosts) + len(new) and all(r["bad_rate"] is not None for r in got)
    assert verdict["new.bad.org"] == "block" and verdict["new.good.org"] == verdict["new.unseen.aa"] == "allow"


def test_line_dedup(spark):
    rows = [(i, f"own words of {i} and some more of them\nSHARED line here\n\nlast {i}", f"s{i}") for i in range(12)] + [(50, "shared line here", "s0"), (51, None, None), (52, "", "s1")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).collect()}
    assert got[3] == ("own words of 3 and some more of them\n\nlast 3", 1)
    assert got[50] == ("shared line here", 0) and got[51] == (None, 0) and got[52] == ("", 0)
    assert line_dedup.remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_line_dedup_equals_brute_force_without_near_copies(spark):
    rng = random.Random(11)
    shared = [f"Shared line number {k} of many" for k in range(30)]
    rows = []
    for i in range(120):
        lines = [" ".join(words(9, 5000 + 40 * i + k)) for k in range(rng.randrange(0, 4))] + rng.sample(shared[: 5 + i // 5], min(4, 5 + i // 5)) + ["", " "]
        rng.shuffle(lines)
        rows.append((rng.choice([i, None]), "\n".join(lines), rng.choice([f"s{i % 13}", None])))
    rows += rows[:5] + [(900, None, "s1"), (901, "\n".join([shared[0]] * 3000 + ["own"]), "s1")]
    sites = collections.defaultdict(set)
    for t in {t for _, t, _ in rows if t}:
        home = min((s for _, u, s in rows if u == t), key=lambda s: (s is not None, s))
        for line in t.split("\n"):
            if line.strip():
                sites[line.strip().lower()].add(home)
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).collect()), key=str)
    # sites of a text's copies count as one: here copies share their site, but for those that share a text by chance
    bad = {line for line, s in sites.items() if len(s) >= 10}

    def clean(t):
        lines = (t or "").split("\n")
        left = [x for x in lines if x.strip().lower() not in bad]
        return "\n".join(left) if any(x.strip() for x in left) else t

    assert bad and got == sorted(((i, clean(t)) for i, t, _ in rows), key=str)


def test_line_dedup_cleans_thin_pages_and_spares_copies(spark):
    footer = "\n".join(" ".join(words(12, 700 + k)) for k in range(3))
    thin = [(i, f"{' '.join(words(20, 800 + i))}\n{footer}", f"s{i}") for i in range(12)] + [(None, f"no id at all\n{footer}", "s1")]
    lines = [" ".join(words(30, 900 + k)) for k in range(8)]
    near = [(100 + i, "\n".join([*lines, f"edit {i}"]), f"s{i}") for i in range(12)]
    exact = [(200 + i, "one text\nwith two lines", f"s{i}") for i in range(12)] + [(300, "one text\nand its own", "s3")]
    rows = thin + near + exact
    clash = [(*r, "x", 1, 2, 3, 4, 5) for r in rows]
    found = line_dedup.remove_boilerplate(spark.createDataFrame(clash, "doc_id long, text string, source string, bad string, n_lines int, n_removed int, lines int, stay int, r1 int"), 10)
    assert found.columns == ["doc_id", "text", "source", "bad", "lines", "stay", "r1", "n_lines", "n_removed"]
    found = found.select("doc_id", "text", "source", "n_lines", "n_removed").collect()
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in found}
    assert len(found) == len(rows)
    assert all(got[i] == (t.split("\n")[0], 3) for i, t, _ in thin)
    assert all(got[i] == (t, 0) for i, t, _ in near + exact)


@pytest.mark.parametrize("size", [36, 60, 120, 300])
def test_line_dedup_takes_long_footers_from_thin_pages(spark, size):
    footer = "\n".join(" ".join(words(12, 40 * size + k)) for k in range(size // 12))
    thin = [(i, f"{' '.join(words(20, 8000 + i))}\n{footer}", f"s{i}") for i in range(30)]
    body = [words(30, 9000 + k) for k in range(8)]
    near = []  # a word of two lines of eight is another one in each of sixteen copies
    for i in range(16):
        lines = [list(x) for x in body]
        lines[i % 8][7], lines[(i + 3) % 8][20] = f"edit{i}", f"other{i}"
        near.append((100 + i, "\n".join(map(" ".join, lines)), f"s{i}"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(spark.createDataFrame(thin + near, "doc_id long, text string, source string"), 10).collect()}
    assert all(got[i] == t.split("\n")[0] for i, t, _ in thin)
    assert all(got[i] == t for i, t, _ in near)


def test_toxicity_learns_words_stems_and_folds(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(200):
        toxic = i % 5 == 0
        w = words(40, i) + ([rng.choice(["scumbag", "grumphen", "grumpheit", "grumphung"])] * 2 if toxic else [])
        rows.append((i, " ".join(w))), labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, DOC)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(lexicon.weights) >= {"grum*"} and any(t.rstrip("*") in "scumbag" for t in lexicon.weights)
    score = lambda t: lexicon.score(lexicon.features(lexicon.automaton(), t))
    assert score("you sсumb4g, scumbag") > 0.3 > score("plain words only") and score(None) == score("")
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}
    odd = [*ODD, ((1 << 53) + 1, "long scumbag " * 30_000), ((1 << 53) + 1, None)]
    got = toxicity.score(spark.createDataFrame([(*r, "s") for r in odd], DOC + ", score string"), lexicon, "doc_id", "score").collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in odd) and all(0 < r["score"] < 1 for r in got)
    assert toxicity.score(spark.createDataFrame([], DOC), lexicon, "doc_id").count() == 0


def test_maxent_scores(spark):
    rows = [(i, t, i % 5 != 1, 7) for i, t in enumerate(["the cat sat on the mat", "der hund lief weg"] * 20 + [None, "", "zz unknown", "zz\x1cunknown zz", "long " * 50_000])] + [(None, "the cat", True, 7)] * 2
    got = maxent_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean, row int"), head=5).collect()
    count = collections.Counter(w for _, t, train, _ in rows if train for w in [*maxent_words(t), "\n"])
    n, v = sum(count.values()), len(count)
    text = {i: t for i, t, _, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        tokens = [*maxent_words(text[r["doc_id"]]), "\n"]
        assert r["base_score"] == pytest.approx(sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[t] > 0 for t in tokens), n) and r["score"] < 0
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[0] > scores[1] - 10 and scores[0] > next(r["base_score"] for r in got if r["doc_id"] == 0)
    assert maxent_lm.score_texts(spark.createDataFrame([], "doc_id long, text string, train boolean")).count() == 0
    none = maxent_lm.score_texts(spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in none] == [(3, 0, 0)]


def maxent_words(text):
    return [w for w in re.split("[\\x20\\x09-\\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]


def test_maxent_probabilities_sum_to_one_and_equal_a_dense_softmax():
    rng = np.random.default_rng(4)
    names = [f"w{i}" for i in range(3000)]
    c, domain = np.sort(rng.zipf(1.3, 3000).clip(1, 10**6).astype(float))[::-1], rng.integers(0, 6, 3000)
    v = maxent_lm.Vocabulary(pa.array(names), np.zeros(3000), cls=np.zeros(3000, np.int64), end_base=0.0, unknown_end=False, bits=12, **maxent_lm.paths(c, domain))
    weights = rng.normal(size=(1 << 12, maxent_lm.FAN)).astype(np.float32)
    # every member of the root but the domains, and every word of the vocabulary, after the same two words
    last = ["", "aa", "aaaaaaaaaaaa", "a-1", *("é" * k for k in (1,)), "ж", "日"]
    batch = maxent_lm.Batch(v, pa.array([f"w5 w9 {w}" for w in [*names, *last]]))
    logs = batch.log_words(weights, v)
    place = np.concatenate([[0], batch.stop[:-1]]) + 2
    p = np.exp(logs[place])
    root = {int(-1 - i): q for i, q in zip(batch.ids[place][3000:], p[3000:], strict=True)}
    assert sum(root) == sum(range(1 + maxent_lm.SHAPES)) or len(root) < 7  # shapes that these words hit
    missing = [m for m in range(1 + maxent_lm.SHAPES) if m not in root]
    where = batch.first[place[0]]
    rows = batch.rows(np.array([where]), 6, 12)
    z = sum(weights[r[0]] for r in rows)[: 1 + maxent_lm.SHAPES + maxent_lm.DOMAINS].astype(float)
    dense = np.exp(z) / np.exp(z).sum()
    assert p[:3000].sum() + sum(root.values()) + sum(dense[m] for m in missing) == pytest.approx(1, abs=1e-4)
    assert all(root[m] == pytest.approx(dense[m], rel=1e-3) for m in root)


def test_quality_base_figures(spark):
    docs = spark.createDataFrame([(1, "a b c d e x a b c d e", "s"), (2, None, None), (3, "#a\n#a\n\n*b", "s"), (4, "z " * 2000, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: tuple(r)[2:7] for r in quality_rules.base_figures(docs).collect()}
    assert got == {1: (11, 11, 0, 0, 10), 2: (0, 0, 0, 0, 0), 3: (3, 6, 3, 1, 0), 4: (2000, 2000, 0, 0, 2000)}
    assert {r["doc_id"]: r["kept"] for r in quality_rules.quality(docs).collect()} == {1: False, 2: False, 3: False, 4: False}


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).round(2)
    x[300:340] = x[300]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, None, 1), (9050, [], 1), (9001, [0.0] * 8, 1), (9002, [float("nan")] * 8, 1), (9003, [None] * 8, 1), (None, [1.0] * 8, 1), (7, x[7].tolist(), 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    got, report = ann.neighbours(vectors, vectors.where("vec_id % 50 = 0"), leaves=40, per_task=10)
    found = collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    assert found[300] == [301, 302, 303, 304, 305] and report["recall"] >= 0.9 and report["visits"] < report["leaves"]
    f = x.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    truth = {q: set(np.argsort(-(f @ f[q]) + 9 * (np.arange(600) == q), kind="stable")[:5].tolist()) for q in range(0, 600, 50)}
    assert sum(len(truth[q] & set(found[q])) for q in truth if q != 300) >= 0.9 * 5 * (len(truth) - 1)
    assert len(found) == 12 and all(len(v) == 5 for v in found.values())
    for few in ([], [(50, [1.0, 0.0])], [(50, [1.0, 0.0]), (51, [0.0, 1.0])]):
        small = spark.createDataFrame(few, "vec_id long, embedding array<float>")
        assert ann.neighbours(small, small.where("vec_id % 50 = 0"))[0].count() == max(0, len(few) - 1)


def test_packing_bounds_and_offsets(spark):
    assert packing.lower_bound(np.array([1100] * 4), 2048) == 4 and packing.lower_bound(np.array([700] * 3), 2048) == 2
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng.randrange(0, 700), i))) for i in range(60)] + [(100, None), (101, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, DOC), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    pieces = [(i, 0, 0, rng.randrange(1, 2049), i) for i in range(3000)]
    small = packing.pack(spark.createDataFrame(pieces, packing.PIECES), 2048, per_group=200)
    assert packing.certify(small) == (small.select("sequence_id").distinct().count(), packing.lower_bound(np.array([p[3] for p in pieces]), 2048))
    bound = packing.lower_bound(np.array([p[3] for p in pieces]), 2048)  # not the volume alone: long pieces leave room that nothing fills
    total = [r[0] for r in small.groupBy("sequence_id").sum("length").select("sum(length)").collect()]
    assert max(total) <= 2048 and small.count() == 3000 and bound <= len(total) <= 1.02 * bound + 15


def components(texts, percent=75, size=5):
    """Brute force: class of each text by place, and its set."""
    sets = [frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(x) for x in range(len(sets))], sets


@pytest.mark.parametrize("block", [4096, 8])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = random.Random(9)
    base, under = words(120, 0), words(100, 77)
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w if i % 2 else words(100, i))))
    for i in range(40):  # pairs a little under and over the threshold
        w = list(under)
        for k in rng.sample(range(0, 100, 9), 2):
            w[k] = f"u{i}-{k}"
        rows.append((300 + i, " ".join(w)))
    rows += [(200, rows[1][1].upper()), (201, "a b"), (202, "A b"), (203, None), (204, ""), (205, "long " * 40_000), (206, "long " * 39_000)]
    rows += [(7, " ".join(words(100, 2))), (7, rows[1][1]), (7, rows[1][1]), (None, rows[2][1]), (None, "nobody else says so"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC + ", node string, key int")
    got = minhash.near_duplicates(docs, block=block).collect()
    cls, sets = components([t for _, t in rows])
    least = {c: min((i for (i, _), k in zip(rows, cls, strict=True) if k == c and i is not None), default=None) for c in cls}
    want = [(i, len(s), least[c] if s else i, (least[c] if s else i) in (i, None)) for (i, _), c, s in zip(rows, cls, sets, strict=True)]
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r)[:4] for r in got), key=order) == sorted(want, key=order)
    assert minhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_bucket_links_skip_what_is_joined():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[k // 3 : k // 3 + 270], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for k in range(30)]
    sketches = np.stack([np.frombuffer(minhash.sketch(s), np.uint8) for s in sets])
    similar = lambda a, b: 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))
    assert all(similar(sets[0], s) for s in sets)
    home, needed = np.ones(30, bool), minhash.needed_matches(0.75, 1e-7)
    links = list(minhash.bucket_links(sketches, sets, np.arange(30), home, needed, 75))
    assert len(links) == 29
    assert not list(minhash.bucket_links(sketches, sets, np.zeros(30, np.int64), home, needed, 75))

"""The operators 11 to 13 against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbquarry.llm import burst_trie, periodic_runs, projection_dedup, queries

SF = "/root/testdata/sf0.001"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def linked(rows, threshold=0.95):
    """n_links and component_id of each row."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n, at = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for k, i in enumerate(good):
        for j in good[k + 1 :]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and (a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()) >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                at[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return [(v, n[i], least.get(find(i)), least.get(find(i)) == v) for i, (v, _) in enumerate(rows)]


def vectors(n, rng, spread=0.16, dim=16):
    centres = rng.standard_normal((12, dim))
    return [[float(c) for c in np.float32(centres[k % 12] * (1 + k % 3) + spread * rng.standard_normal(dim) * (k % 2))] for k in range(n)]


@pytest.mark.parametrize("window,block", [(256, 1024), (4, 8), (3, 16)])
def test_projection_dedup_equals_brute_force(spark, window, block):
    rng = np.random.default_rng(5)
    rows = list(enumerate(vectors(160, rng)))
    rows += [(500 + i, [float(c) for c in rng.standard_normal(16)]) for i in range(60)]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [None] + [1.0] * 15), (604, [float("nan")] * 16), (605, [float("inf")] + [0.0] * 15), (606, rows[1][1][:8]), (607, rows[1][1][:8]), (608, [1e-40] * 16), (609, [1e38] * 16), (None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n int, node string")
    got = projection_dedup.near_duplicates(df, window=window, block=block, miss=1e-9)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    want = [(v, n, c, v == c if v is not None else c is None) for v, n, c, _ in linked([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])]
    assert sorted(map(key, (tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()))) == sorted(map(key, want))


def test_projection_dedup_of_nothing_and_of_one_place(spark):
    assert projection_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rng = np.random.default_rng(1)
    rows = [(i, [1.0 + 0.001 * float(c) for c in rng.standard_normal(8)]) for i in range(300)]  # one run for every block
    got = projection_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=8, block=16).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)} and sum(r["kept"] for r in got) == 1


def test_projection_dedup_compares_each_pair_once():
    bits, passes = projection_dedup.passes_needed(100_000, 0.95, 256, 1e-4)
    share = (1 - np.arccos(0.95) / np.pi) ** bits
    assert 100_000 / 2**bits <= 256 and (1 - share) ** passes <= 1e-4


def trie(turns, heads=9):
    own = collections.defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((-1 if t is None else t, r or "", x or ""))
    own = {c: [v[1:] for v in sorted(rows, key=lambda v: v[:2])] for c, rows in own.items()}
    seqs = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + rows[h:])
    members, children, ends = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for c, s in seqs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[q] for q in children[p]]
        own_saving = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(b[0] for b in below) or 1, own_saving + sum(b[1] for b in below))
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *sums[p], digest))
    return out


def built(df, **how):
    nodes, members = burst_trie.prefix_trie(*burst_trie.rebuilt(df), **how)
    found = nodes.join(burst_trie.ends_digests(members), "ends", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(burst_trie.EMPTY)))
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.select(*NODE).collect())


@pytest.mark.parametrize("how", [{}, {"segment": 2, "limit": 7}, {"segment": 50, "limit": 4}])
def test_burst_trie_equals_brute_force(spark, how):
    rng = random.Random(3)
    turns = [(c, t, "user", f"very common {t}" if rng.random() < 0.8 else f"ä{rng.randrange(3)}") for c in range(120) if c % 7 for t in range(rng.choice([0, 1, 3, 6, 14]))]
    turns += [(200, None, "user", "first"), (200, 1, None, None), (200, 0, "user", ""), (201, 0, "a", "b"), (None, 0, "user", "lost"), (203, 5, "user", "x"), (205, 1, "a", "1"), (205, 1, "b", "2"), (205, 1, "a", "1")]
    rng.shuffle(turns)
    df = spark.createDataFrame([(*t, 1, "y") for t in turns], "conv_id long, turn long, role string, text string, pos int, level string")
    want = sorted(tuple(-1 if v is None else v for v in r) for r in trie(turns))
    assert built(df, **how) == want


def test_burst_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert built(empty) == []


def test_registered_trie_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(-1 if v is None else v for v in r) for r in queries.op12_burst_trie(spark, SF).select(*NODE).collect())
    assert got == sorted(tuple(-1 if v is None else v for v in r) for r in trie(rows))


def runs_of(w):
    """All runs by definition: for each period the maximal stretches, the smallest period of each."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def judged(i, text, rewrite=True):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(i).encode())
    if rewrite and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs, gone = runs_of(w), set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    text = "".join("%d,%d,%d\n" % r for r in runs)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *figures, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_lag_scan_equals_definition():
    rng = random.Random(9)
    for turn in range(400):
        kinds = rng.choice([1, 2, 3, 5])
        w = [rng.randrange(kinds) for _ in range(rng.randrange(0, 90))]
        if turn % 2:
            block = [rng.randrange(kinds) for _ in range(rng.randrange(1, 12))]
            w[len(w) // 2 : len(w) // 2] = block * rng.randrange(2, 9) + block[: rng.randrange(len(block))]
        got = periodic_runs.batch_runs([np.array(w, np.int64), np.zeros(0, np.int64), np.array(w[::-1], np.int64)])
        assert got == [runs_of(w), [], runs_of(w[::-1])]


def test_periodic_runs_of_documents(spark):
    rows = [(i, " ".join(random.Random(i).choices("abcdefg hij".split() + ["w", "x　y", "\x1c"], k=i * 3))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\t "), (72, "\n\t "), (None, "a " * 50), (73, "one " * 30_000), (74, "a b c d e " * 12_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, start int, runs string")
    found = periodic_runs.periodic_runs(df, slice_bytes=500)
    got = [(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"])) for r in found.collect()]
    for i, text in rows:
        if i in (73, 74):
            continue
        runs = runs_of((text or "").encode().split())
        mine = [g for g in got if g[0] == i]
        assert all(g[5] == [tuple(r) for r in runs] for g in mine) and mine
    assert [g for g in got if g[0] == 73][0][1:5] == (1, 0, 30_000, 1) and [g for g in got if g[0] == 74][0][6] == b"a b c d e"
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_runs_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 30_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    for i, text in rows:
        assert got[i] == judged(i, text)


def test_registered_vectors_equal_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_projection_dedup(spark, SF).collect()) == sorted(linked(rows))

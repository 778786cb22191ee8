"""Near-duplicate documents by MinHash, with sequential Bayesian verification.

1. Each text gives its set of word shingles, two hashes of the whole set and band keys of a MinHash signature.  Texts
   with equal sets are linked at once and go on as one node, whatever their ids.
2. Band keys that several nodes share are buckets; of buckets with the same members one is kept.  Members come with their
   full set and a sketch: a byte each of further signature values, which the bands don't know, so that estimates are
   unbiased.
3. A bucket is settled in one task.  Sketches of a pair are compared batch by batch: after n values, m of them equal, the
   pair is dropped if P(similarity >= threshold | m of n) is under ``miss``.  With a uniform prior that is
   P(Bin(n + 1, threshold) <= m).  Survivors are verified on full sets.  Pairs that links already join are skipped, so
   that a task gives fewer links than it has members.
4. Buckets of over ``block`` members are dealt to blocks, with some members of the bucket in each.  Where such a bucket
   still holds several components, members outside its largest one visit all its blocks; all pairs between components
   are then tested.

With 32 bands of 3 values a pair at similarity 0.75 shares no band with a chance of 2.4e-8; ``miss`` is 1e-7.

Defined cases: null texts and texts without words have an empty set and no links; texts with fewer words than a shingle
have one shingle; equal rows are linked by their equal sets; rows that share an id but not their text are nodes of their
own; texts are taken whole; an empty table gives an empty table; further columns are ignored.  Rows without an id take
part: they get the smallest id of their component, and are kept only where it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from . import bpe
from .common import HashCache, groups, save

BANDS, ROWS, BATCH, SKETCH = 32, 3, 50, 400
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(0, 1 << 64, BANDS * ROWS + SKETCH, dtype=np.uint64) | np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS + SKETCH, dtype=np.uint64)
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, cache: HashCache, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words, A-Z folded; bytes.lower() and bytes.split() know
    ASCII only, as asked."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    s = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            s = s * _PRIME + h[j : len(h) - n + 1 + j]
        s = (s + np.uint64(n)) * _MIX
        s ^= s >> np.uint64(32)
        s *= _PRIME
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(shingles: np.ndarray, which: slice) -> np.ndarray:
    multiply, flip = _MULTIPLY[which], _FLIP[which]
    low = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 512):
            np.minimum(low, ((shingles[a : a + 512, None] ^ flip) * multiply).min(axis=0), out=low)
    return low


def sketch(shingles: np.ndarray) -> bytes:
    """A byte of each value, mixed first: minima of large sets all start with zeros."""
    low = signature(shingles, slice(BANDS * ROWS, None))
    with np.errstate(over="ignore"):
        low = (low ^ (low >> np.uint64(31))) * _MIX
    return (low >> np.uint64(56)).astype(np.uint8).tobytes()


def row_key() -> list[Column]:
    """128 bits of a row's id and text, never null.  With the id, copies of a text have keys of their own."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2")]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """rid (of the row), doc_id, r1, r2 (row_key()), n_shingles, h1, h2 (of the set; null if empty), keys."""
    own = ["rid", "doc_id", "r1", "r2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, powers = HashCache(), _PRIME ** np.arange(ROWS, dtype=np.uint64)
        for whole in batches:
            for batch in bpe.slices(whole, "text"):
                n, h, keys = [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingle_set(text, cache, size)
                    n.append(len(s))
                    if not len(s):
                        h.append((None, None)), keys.append(None)
                        continue
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    h.append(tuple(int(v) for v in np.array([d & (1 << 64) - 1, d >> 64], np.uint64).view(np.int64)))
                    low = signature(s, slice(0, BANDS * ROWS))
                    with np.errstate(over="ignore"):
                        k = ((low.reshape(BANDS, ROWS) * powers).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)) * _MIX
                    keys.append((k ^ (k >> np.uint64(31))).view(np.int64))
                h1, h2 = zip(*h, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in own), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    [*own, "n_shingles", "h1", "h2", "keys"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), *row_key(), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, r1 long, r2 long, n_shingles long, h1 long, h2 long, keys array<long>")


def with_sets(texts: DataFrame, size: int) -> DataFrame:
    """node, sketch, shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for batch in bpe.slices(whole, "text", 2 << 20):
                sets = [shingle_set(t, cache, size) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "sketch", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, sketch binary, shingles binary")


def needed_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on) after each batch."""
    out = []
    for n in range(BATCH, SKETCH + 1, BATCH):
        tail, m = 0.0, -1
        while True:
            tail += comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            m += 1
            if tail >= miss:
                break
        out.append((n, m))
    return out


def survivors(one: np.ndarray, sketches: np.ndarray, live: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Those of the places ``live`` that no batch prunes."""
    matches, before = np.zeros(len(live), np.int64), 0
    for n, least in needed:
        matches = matches + (sketches[live, before:n] == one[before:n]).sum(axis=1)
        on = matches >= least
        live, matches, before = live[on], matches[on], n
        if not len(live):
            break
    return live


def bucket_links(sketches: np.ndarray, sets: list[np.ndarray], comps: np.ndarray, home: np.ndarray, needed: list[tuple[int, int]], percent: int) -> Iterator[tuple[int, int]]:
    """Places (i, j) of similar members that neither ``comps`` nor earlier links join.  Members are compared with those at
    home: visitors with all of these, others with the ones behind them."""
    size = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    kinds, number = np.unique(np.concatenate(sets), return_inverse=True)
    mark, at_home = np.zeros(len(kinds), bool), np.nonzero(home)[0]
    comps = np.unique(comps, return_inverse=True)[1]
    for i in range(len(sets)):
        others = at_home[np.searchsorted(at_home, i, "right") :] if home[i] else at_home
        others = others[comps[others] != comps[i]]
        if len(others):
            others = survivors(sketches[i], sketches, others, needed)
        if not len(others):
            continue
        own = number[begin[i] : begin[i] + size[i]]
        mark[own] = True
        for part in np.array_split(others, -(-int(size[others].sum()) // 4_000_000)):
            where = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(size[part])])[:-1], size[part]) + np.arange(int(size[part].sum()))
            both = np.add.reduceat(mark[number[where]], np.concatenate([[0], np.cumsum(size[part])])[:-1], dtype=np.int64)
            for j in part[100 * both >= percent * (size[i] + size[part] - both)].tolist():
                if comps[j] != comps[i]:
                    comps[comps == comps[j]] = comps[i]
                    yield i, j
        mark[own] = False


def _links(members: DataFrame, needed: list[tuple[int, int]], percent: int) -> DataFrame:
    """Links (a, b) within the groups (key, part) of members (node, comp, home, sketch, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for g in groups(batches, "key", "part"):
            if len(g["node"]) > 1:
                sketches = np.frombuffer(b"".join(g["sketch"].tolist()), np.uint8).reshape(len(g["node"]), -1)
                sets = [np.frombuffer(s, np.uint64) for s in g["shingles"].tolist()]
                out += [(g["node"][i], g["node"][j]) for i, j in bucket_links(sketches, sets, g["comp"], g["home"].astype(bool), needed, percent)]
            if len(out) > 20_000:
                yield _link_batch(out)
                out = []
        yield _link_batch(out)

    dealt = members.select("key", "part", "node", "comp", "home", "sketch", "shingles").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _link_batch(rows: list) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _across_blocks(large: DataFrame, comps: DataFrame, drawn: DataFrame, block: int, needed: list[tuple[int, int]], percent: int) -> DataFrame:
    """Links between components of ``large`` (key, node, parts): all blocks of a bucket are visited by the members outside
    its largest component, in chunks."""
    placed = large.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    counts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("major"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    placed = save(placed.join(mixed, "key").withColumn("chunks", F.ceil(F.col("others") / block)), "mixed-buckets")
    part = lambda h, v: (h * (1 << 24) + v).alias("part")
    own, chunk = F.pmod(F.xxhash64("node"), F.col("parts")), F.pmod(F.xxhash64("node", F.lit(9)), F.col("chunks"))
    homes = placed.select("key", "node", "comp", F.lit(True).alias("home"), own.alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("v"))
    visits = placed.where("comp <> major").select("key", "node", "comp", F.lit(False).alias("home"), chunk.alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("h"))
    dealt = homes.unionByName(visits).select("key", "node", "comp", "home", part(F.col("h"), F.col("v")))
    return _links(dealt.join(drawn, "node"), needed, percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, miss: float = 1e-7, block: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id linked, directly or not), kept (doc_id = component_id), and r1, r2
    (row_key(), to find the row again)."""
    needed = needed_matches(percent / 100, miss)
    sigs = save(signatures(docs, size), "signatures")
    sets = save(sigs.where("h1 is not null").groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least")), "sets")
    own = sigs.select(F.col("rid").alias("node"), "n_shingles", "r1", "r2", "keys").join(sets.select("node"), "node", "left_semi")
    banded = save(own.select("node", "n_shingles", F.explode("keys").alias("key")), "banded")
    # of all keys with the same members (128 bits of them) the smallest stands for the others
    members = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"m{k}") for k in (1, 2)]
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), *members).where("n > 1")
    shared = shared.groupBy("n", "m1", "m2").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / (1000 * block)))
    buckets = save(banded.select("node", "key").join(shared.select("key", "n", parts.alias("parts")), "key"), "buckets")
    wanted = sigs.select(F.col("rid").alias("node"), "r1", "r2").join(buckets.select("node").distinct(), "node", "left_semi")
    texts = docs.select(*row_key(), "text").join(wanted, ["r1", "r2"]).dropDuplicates(["node"])
    drawn = save(with_sets(texts, size), "sketches")

    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    several = F.when(F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")) < 64, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(part))
    first = buckets.select("key", "node", F.col("node").alias("comp"), F.lit(True).alias("home"), F.explode(several).alias("part"))
    links = save(_links(first.join(drawn, "node"), needed, percent), "links")
    comps = connected_components(links)
    large = buckets.where("parts > 1").select("key", "node", "parts")
    if not large.isEmpty():
        more = save(_across_blocks(large, comps, drawn, block, needed, percent), "links")
        if not more.isEmpty():
            comps = connected_components(links.unionByName(more))
    placed = sets.join(comps, "node", "left").select("h1", "h2", "least", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = placed.join(least, "component").select("h1", "h2", "component_id")
    out = sigs.select("doc_id", "n_shingles", "r1", "r2", "h1", "h2").join(by_set, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"), "r1", "r2")

"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors are one node with its number of copies.
2. Each pass gives every node a key: the signs of its products with random directions, put one behind the other.  Nodes are
   sorted by that key; a node's neighbours are those within ``window`` places, and all those with the same first ``bits``
   signs however many they are, so that a dense place loses nothing to the window.
3. Sorted nodes are cut into blocks.  A node goes to its own block and to those behind it that its window or its run of
   equal first signs reaches; every tile of at most two blocks is one task's product of matrices, exact cosines decide.
4. A pair counts in the first pass that compares it: nodes carry their places in all passes, so tasks give only sums of
   links and a spanning forest, never the pairs.  Forests of all passes are united by connected components.

Two vectors at the threshold share the first ``bits`` signs of a pass with probability (1 - angle / pi) ** bits; ``bits`` follows
from the number of nodes, and there are as many passes as it takes to miss such a pair in all of them with a chance under
``miss``.  Nearer pairs are missed less.  Work in a dense group (many different vectors, each within the threshold of
the others) grows with the square of its size, since every one of its links is counted; what is shuffled grows with
the square over the block size.

Nearness is the cosine in double precision of the original components.  Defined cases: vectors that are null, empty or
zero, or hold null or non-finite components, link with nothing; vectors of different lengths don't link; every row is a
vector of its own, also where ids repeat; rows without an id take part, get the smallest id of their component and are
kept only where it has none; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from ..operators.scan import numbered
from .common import groups, save

KEY_BITS = 62


def passes_needed(n: int, threshold: float, window: int, miss: float) -> tuple[int, int]:
    """(first signs that make a run, number of passes) for ``n`` nodes."""
    bits = min(40, max(0, ceil(log2(max(1, n) / window))))
    share = (1 - acos(threshold) / pi) ** bits
    return bits, 1 if share >= 1 else ceil(log(miss) / log(1 - share))


def directions(turn: int, dim: int) -> np.ndarray:
    return np.random.default_rng([11, turn, dim]).standard_normal((dim, KEY_BITS))


def unit(packed: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_key(x: np.ndarray, turn: int) -> np.ndarray:
    signs = x @ directions(turn, x.shape[1]) >= 0
    return (signs.astype(np.int64) << np.arange(KEY_BITS - 1, -1, -1)).sum(axis=1)


def keyed(nodes: DataFrame, passes: int) -> DataFrame:
    """band (vectors' length and pass), key, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, packed = batch.column("node").to_numpy(), batch.column("x").to_pylist()
            size = np.array([len(v) for v in packed])
            for s in np.unique(size):
                at = np.nonzero(size == s)[0]
                x = unit([packed[i] for i in at])
                for turn in range(passes):
                    band = np.full(len(at), int(s) // 8 * passes + turn, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(sign_key(x, turn)), pa.array(node[at])], ["band", "key", "node"])

    return nodes.select("node", "x").mapInArrow(run, "band long, key long, node long")


def tiles(placed: DataFrame, block: int, window: int) -> DataFrame:
    """h, v (tile), home (is the row of block h, or a visitor from a block before), node, band, place."""
    rows = placed.withColumn("h", F.floor(F.col("place") / block)).withColumn("run", F.struct("band", "prefix"))
    blocks = rows.groupBy("h").agg(F.min("run").alias("first"), F.max("run").alias("last"))
    to, since = blocks.groupBy(F.col("first").alias("last")).agg(F.max("h").alias("to")), blocks.groupBy(F.col("last").alias("first")).agg(F.min("h").alias("since"))
    blocks = save(blocks.join(to, "last", "left").join(since, "first", "left"), "blocks")
    rows = rows.join(blocks, "h")
    until = F.greatest(F.floor((F.col("place") + window) / block), F.when(F.col("run") == F.col("last"), F.col("to")), F.col("h"))
    tile = lambda h, v, home: F.struct(h.alias("h"), v.alias("v"), F.lit(home).alias("home"))
    span = lambda a, b, f: F.when(a <= b, F.transform(F.sequence(a, b), f)).otherwise(F.array())
    h = F.col("h")
    spots = F.concat(
        F.array(tile(h, h, True)),
        F.when(until > h, F.array(tile(h + 1, h + 1, False))).otherwise(F.array()),
        span(h + 2, until, lambda g: tile(g, h, False)),
        F.when(F.col("run") == F.col("first"), span(F.coalesce("since", h), h - 2, lambda v: tile(h, v, True))).otherwise(F.array()),
    )
    return rows.select("node", "band", "place", F.explode(spots).alias("spot")).select("spot.*", "node", "band", "place")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place is linked with, directly or not."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[a], at[b])
        new = at.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, at[a], low)
        np.minimum.at(new, at[b], low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def tile_links(x: np.ndarray, home: np.ndarray, places: np.ndarray, turn: int, inside: bool, threshold: float, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one tile that no earlier pass compares: members at home with each other (``inside``) and with visitors."""
    at_home, visit = np.nonzero(home)[0], np.nonzero(~home)[0]
    left = np.concatenate([at_home, visit]) if inside else visit
    found_a, found_b = [], []
    for part in np.array_split(left, -(-len(left) // 512) or 1):
        near = x[part] @ x[at_home].T
        i, j = np.nonzero(near >= threshold - 1e-9)
        a, b = part[i], at_home[j]
        one = (a < b) | ~home[a]
        found_a.append(a[one])
        found_b.append(b[one])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    close = np.abs((x[a] * x[b]).sum(axis=1) - threshold) < 1e-9 if len(a) else np.zeros(0, bool)
    keep = np.ones(len(a), bool)
    keep[close] = (x[a[close]] * x[b[close]]).sum(axis=1) >= threshold
    a, b = a[keep], b[keep]
    if not len(a):
        return a, b
    used, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = pos[: len(a)], pos[len(a) :]
    for p in range(turn + 1):
        prefix = sign_key(x[used], p) >> (KEY_BITS - bits)
        met = (np.abs(places[used, p][ia] - places[used, p][ib]) <= window) | (prefix[ia] == prefix[ib])
        keep = met if p == turn else ~met
        a, b, ia, ib = a[keep], b[keep], ia[keep], ib[keep]
    return a, b


def links(dealt: DataFrame, passes: int, threshold: float, window: int, bits: int) -> DataFrame:
    """node, n (its new links, copies counted), root (a node it is linked with, directly or not) of every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "h", "v"):
            inside = g["h"][0] == g["v"][0]
            for band in np.unique(g["band"]):
                at = np.nonzero(g["band"] == band)[0]
                home = g["home"][at].astype(bool)
                if not home.any() or len(at) < 2 or not inside and home.all():
                    continue
                x, places = unit(g["x"][at].tolist()), np.stack(g["places"][at])
                a, b = tile_links(x, home, places, int(band % passes), inside, threshold, window, bits)
                if not len(a):
                    continue
                node, copies = g["node"][at], g["copies"][at]
                n = np.bincount(a, copies[b], len(at)) + np.bincount(b, copies[a], len(at))
                live, root = np.nonzero(n)[0], _forest(len(at), a, b)
                yield pa.RecordBatch.from_arrays([pa.array(node[live]), pa.array(n[live].astype(np.int64)), pa.array(node[root[live]])], ["node", "n", "root"])

    near = dealt.repartition("h", "v").sortWithinPartitions("h", "v", "node")
    return near.mapInArrow(run, "node long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, window: int = 256, block: int = 1024, miss: float = 1e-4) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (vec_id =
    component_id) of every row of ``vectors`` (vec_id, embedding)."""
    e = F.col("embedding")
    good = (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    keys = [F.when(good, F.xxhash64(*salt, e)).alias(f"h{i}") for i, salt in enumerate(([], [F.lit(1)]))]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).select("vec_id", "embedding", *keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "embedding"]
            packed = [np.asarray(v, np.float64).tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(packed, pa.binary())], [*kept, "x"])

    once = rows.where("h0 is not null").groupBy("h0", "h1").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    packed = once.withColumn("node", F.monotonically_increasing_id()).mapInArrow(pack, "h0 long, h1 long, copies long, least long, node long, x binary")
    nodes = save(packed, "vectors")
    if window > block:
        raise ValueError("a window may reach the next block, not further")
    bits, passes = passes_needed(nodes.count(), threshold, window, miss)
    placed = save(numbered(keyed(nodes, passes), "band", "key", "node").select("node", "band", F.shiftright("key", KEY_BITS - bits).alias("prefix"), "place"), "passes")
    places = placed.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "place"))), lambda p: p["place"]).alias("places"))
    carried = nodes.select("node", "copies", "x").join(places, "node")
    found = save(links(tiles(placed, block, window).join(carried, "node"), passes, threshold, window, bits), "links")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = nodes.select("node", "h0", "h1", "copies", "least").join(counts, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    result = joined.join(least, "component").select("h0", "h1", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = rows.drop("embedding").join(result, ["h0", "h1"], "left")
    component = F.when(F.col("h0").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(component == F.col("vec_id"), component.isNull())
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))

"""Approximate nearest neighbours by a hierarchical k-means tree.

1. A tree of about ``leaves`` leaves is fitted on a bounded sample (``sample`` vectors, the only rows that reach the driver).
   Its size doesn't grow with the table, so it is small enough for every task.
2. Every vector of the table is put into the leaf that it reaches by best-first descent.
3. A query walks the tree best bin first: a priority queue holds the open branches by their centre's nearness and gives
   the leaves in the order in which they are to be visited.
4. How many leaves a query visits is calibrated: for a bounded set of queries the true neighbours are found by brute
   force in blocks, and the visit list is widened until the recall of one half of them reaches ``recall``; the other half
   measures it.
5. Queries meet vectors in tiles: a region of the tree (a branch of its root) has its vectors dealt to parts of ``per_task``,
   queries are dealt to chunks as large, and a query goes once to each part of a region in which it visits leaves.  A tile
   compares leaf by leaf, gives every query's best k, and a window picks the best of those.

Nearness is the cosine in double precision of the original components.  Defined cases: null, empty or zero vectors and
such with null or non-finite components take no part (nor do vectors of another length than most); equal scores are
ordered by the smaller id; rows without an id take no part; repeated ids count as one row (the smallest vector); an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

FOUND = "query_id long, vec_id long, score double"


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(turns):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-30)[:, None], centres)
    return np.unique(centres, axis=0)


class Tree:
    """nodes[i] = (centres, children); a child is a node's number, or -1 - leaf."""

    def __init__(self, x: np.ndarray, branch: int, leaf_size: int, seed: int = 7):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(x, branch, leaf_size, rng)

    def _grow(self, x: np.ndarray, branch: int, leaf_size: int, rng: np.random.Generator) -> int:
        centres = _kmeans(x, branch, rng) if len(x) > leaf_size else x[:0]
        own = np.argmax(x @ centres.T, axis=1) if len(centres) > 1 else np.zeros(len(x), int)
        if len(np.unique(own)) < 2:  # few vectors, or equal ones that no centre parts
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append((centres, []))
        children = [self._grow(x[own == j], branch, leaf_size, rng) for j in range(len(centres))]
        self.nodes[at] = (centres, children)
        return at

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            centres, children = self.nodes[node]
            own = np.argmax(x[rows] @ centres.T, axis=1)
            todo += [(child, rows[own == j]) for j, child in enumerate(children) if (own == j).any()]
        return out

    def regions(self) -> list[int]:
        """The branch of the root that each leaf lies in."""
        out = [0] * self.leaves
        todo = [(child, i) for i, child in enumerate(self.nodes[self.root][1])] if self.root >= 0 else []
        while todo:
            node, region = todo.pop()
            if node < 0:
                out[-1 - node] = region
            else:
                todo += [(child, region) for child in self.nodes[node][1]]
        return out

    def visit(self, q: np.ndarray, leaves: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``leaves`` leaves of best-bin-first traversal, and more until they hold ``least`` vectors."""
        queue, found, held = [(-2.0, self.root)], [], 0
        while queue and (len(found) < leaves or held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                held += sizes.get(-1 - node, 0) if sizes else least
                continue
            centres, children = self.nodes[node]
            for near, child in zip((centres @ q).tolist(), children, strict=True):
                heapq.heappush(queue, (-near, child))
        return found


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, ids once."""
    e = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size(e) > 0)).where(F.forall(e, finite) & F.exists(e, lambda v: v != 0))
    dim = rows.groupBy(F.size(e).alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.select("vec_id", e.cast("array<double>").alias("embedding"))
    return rows.where(F.size("embedding") == (dim["d"] if dim else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _best(ids: np.ndarray, x: np.ndarray, xn: np.ndarray, qid: int, q: np.ndarray, rough: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best of one block.  ``rough`` only preselects; scores are sums in one fixed order, equal for equal vectors."""
    rough = np.where(ids == qid, -np.inf, rough)
    top = k + 1
    cut = np.partition(rough, len(rough) - top)[len(rough) - top] if len(rough) > top else -np.inf
    near = np.nonzero((rough >= cut - 1e-9) & (rough > -np.inf))[0]
    score = (x[near] * q).sum(axis=1) / (xn[near] * np.sqrt((q * q).sum()))
    order = np.lexsort((ids[near], -score))[:k]
    return [(qid, int(ids[near[i]]), float(score[i])) for i in order]


def _block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, leaf: np.ndarray | None = None, visits: list | None = None) -> pd.DataFrame:
    """The k best of the block for each query; with ``leaf`` and ``visits``, of the leaves that it visits."""
    xn = np.sqrt((x * x).sum(axis=1))
    unit, out = x / xn[:, None], []
    if leaf is not None:
        order = np.argsort(leaf, kind="stable")
        names, starts = np.unique(leaf[order], return_index=True)
        columns = dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))
    for a in range(0, len(qids), 256):
        asked = q[a : a + 256] / np.linalg.norm(q[a : a + 256], axis=1, keepdims=True)
        if leaf is None:
            rough = asked @ unit.T
        else:
            rough, going = np.full((len(asked), len(x)), -np.inf), {}
            for j, own in enumerate(visits[a : a + 256]):
                for name in own:
                    going.setdefault(name, []).append(j)
            for name, js in going.items():
                if name in columns:
                    rough[np.ix_(js, columns[name])] = asked[js] @ unit[columns[name]].T
        for j, row in enumerate(rough):
            out += _best(ids, x, xn, int(qids[a + j]), q[a + j], row, k)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _brute(rows: DataFrame, qids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """True neighbours of a bounded set of queries among all rows, block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _block(b["vec_id"].to_numpy(), np.array(b["embedding"].tolist()), qids, q, k)

    return _top(rows.mapInPandas(run, FOUND), k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.94, sample: int = 20_000, branch: int = 8, leaves: int = 128, calibrate: int = 400, per_task: int = 20_000) -> tuple[DataFrame, dict]:
    """query_id, rank, vec_id, score of the k nearest found for each row of ``queries`` (vec_id of ``vectors``), and what
    calibration found: leaves, visits, recall (of the queries that it widened for), held_out (of the others)."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), {"leaves": 0, "visits": 0, "recall": 1.0, "held_out": 1.0}
    rows = save(usable(vectors), "vectors")
    n = rows.count()
    if n < 2:
        return none
    picked = rows.orderBy(F.xxhash64("vec_id")).limit(sample).toPandas() if n > sample else rows.toPandas()
    tree = Tree(_unit(picked["embedding"].tolist()), branch, max(8, len(picked) // leaves))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=shared.value.assign(_unit(b["embedding"].tolist())))

    placed = save(rows.mapInPandas(assign, "vec_id long, embedding array<double>, leaf long"), "leaves")
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row a leaf: bounded by the sample

    asked = save(rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi"), "queries")
    chosen = asked.orderBy(F.xxhash64("vec_id", F.lit(1))).limit(calibrate).toPandas()
    if not len(chosen):
        return none
    q, qids = np.array(chosen["embedding"].tolist()), chosen["vec_id"].to_numpy()
    truth = _brute(rows, qids, q, k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    order = {int(i): {leaf: at for at, leaf in enumerate(tree.visit(v / np.linalg.norm(v), tree.leaves))} for i, v in zip(qids, q, strict=True)}
    needed = np.array([order[a][b] + 1 for a, b in zip(truth["query_id"], truth["leaf"], strict=True)])
    fitted = truth["query_id"].isin(qids[::2].tolist()).to_numpy()
    visits = 1
    while visits < tree.leaves and (needed[fitted] <= visits).mean() < recall:
        visits = min(tree.leaves, visits + max(1, visits // 16))
    found = lambda at: float((needed[at] <= visits).mean()) if at.any() else 1.0
    report = {"leaves": tree.leaves, "visits": visits, "recall": found(fitted), "held_out": found(~fitted)}

    region_of = tree.regions()
    parts: dict[int, int] = {}
    for leaf, c in sizes.items():
        parts[region_of[leaf]] = parts.get(region_of[leaf], 0) + c
    parts = {r: -(-c // per_task) for r, c in parts.items()}
    chunks = -(-asked.count() // per_task)
    region, part_of = (F.create_map(*[F.lit(int(v)) for pair in items for v in pair]) for items in (enumerate(region_of), parts.items()))
    dealt = placed.withColumn("region", region[F.col("leaf")])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), part_of[F.col("region")])).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in _unit(b["embedding"].tolist()) if len(b) else ():
                own: dict[int, list[int]] = {}
                for leaf in shared.value.visit(v, visits, sizes, k + 1):
                    own.setdefault(region_of[leaf], []).append(leaf)
                out.append([{"region": r, "part": p, "leaves": leaf} for r, leaf in own.items() for p in range(parts.get(r, 0))])
            yield b.assign(at=out)

    spread = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    visiting = spread.mapInPandas(walk, "vec_id long, embedding array<double>, at array<struct<region: int, part: long, leaves: array<int>>>")
    visiting = visiting.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(chunks)).cast("int").alias("chunk"), F.inline("at"))

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _block(left["vec_id"].to_numpy(), np.array(left["embedding"].tolist()), right["vec_id"].to_numpy(), np.array(right["embedding"].tolist()), k, left["leaf"].to_numpy(), right["leaves"].tolist())

    keys = ("region", "part", "chunk")
    met = dealt.groupBy(*keys).cogroup(visiting.groupBy(*keys)).applyInPandas(meet, FOUND)
    return _top(met, k).select("query_id", "rank", "vec_id", "score"), report

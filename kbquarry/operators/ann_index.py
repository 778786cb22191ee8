"""Approximate vector search (R19): inverted lists with product codes, exact re-rank, measured recall.

The index is fitted on a bounded sample (``sample`` rows, those with the smallest hashes of their ids) and holds every row: a
row lies in the list of its nearest centre, with a code of ``bytes_per_row`` bytes for what is left after the centre.  The number
of lists grows with the root of the table as far as the sample can tell centres apart.

A query scans the codes of its nearest lists: the score of a code is a sum of looked-up products.  Lists are cut into
parts of a bounded number of rows, so a hot list is several tasks; every part gives its own shortlist, a window takes the
best of these, and only those rows are met with their vectors.  How many lists are scanned and how many rows are met is
widened on one half of a bounded set of queries, until the share found of their true neighbours reaches the target with
a margin of its own uncertainty; the other half measures it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .search import vector_search
from .windows import top_k

FOUND = "qid long, entity_id long, rough double"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 10) -> np.ndarray:
    """Centres by squared distance; an empty one keeps its place."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(turns):
        own = np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


@dataclass
class Codebook:
    """Centres of lists, and for each slice of a vector the words of its code.  Its size depends on the sample, never on the
    table."""

    centres: np.ndarray
    words: np.ndarray  # slices x words x width

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, slices: int, seed: int = 5) -> Codebook:
        rng = np.random.default_rng(seed)
        centres = _kmeans(x, lists, rng)
        left = x - centres[cls.nearest(x, centres)]
        width = -(-x.shape[1] // slices)
        left = np.pad(left, ((0, 0), (0, slices * width - x.shape[1]))).reshape(len(x), slices, width)
        size = min(256, max(1, len(x) // 4))
        return cls(centres, np.stack([np.pad(w := _kmeans(left[:, s], size, rng), ((0, size - len(w)), (0, 0))) for s in range(slices)]))

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.nearest(x, self.centres)
        slices, _, width = self.words.shape
        left = np.pad(x - self.centres[own], ((0, 0), (0, slices * width - x.shape[1]))).reshape(len(x), slices, width)
        return own, np.stack([self.nearest(left[:, s], self.words[s]) for s in range(slices)], axis=1).astype(np.uint8)

    def lookup(self, q: np.ndarray) -> np.ndarray:
        """queries x slices x words: products of a query's slices with all code words"""
        slices, _, width = self.words.shape
        parts = np.pad(q, ((0, 0), (0, slices * width - q.shape[1]))).reshape(len(q), slices, width)
        return np.einsum("qsw,skw->qsk", parts, self.words)


def usable(df: DataFrame, key: str) -> DataFrame:
    """Rows with an id whose vector has only finite components and isn't zero."""
    e = F.col("embedding")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    return df.select(key, e.cast("array<double>").alias("embedding")).where(F.col(key).isNotNull() & (F.size("embedding") > 0) & good)


@dataclass
class Index:
    """``codes``: entity_id, list, part, code of every row; ``rows``: their vectors."""

    book: Codebook
    codes: DataFrame
    rows: DataFrame
    size: int


def build_index(vectors: DataFrame, sample: int = 20_000, slices: int = 16, per_part: int = 50_000) -> Index | None:
    """None for a table without a usable row.  Rows of another length than the sample's first are left out."""
    rows = save(usable(vectors, "entity_id"), "vectors")
    drawn = rows.orderBy(F.xxhash64("entity_id"), "entity_id").limit(sample).toPandas()
    if drawn.empty:
        return None
    dim, size = len(drawn["embedding"].iloc[0]), rows.count()
    rows = rows.where(F.size("embedding") == dim)
    x = _unit(np.array([v for v in drawn["embedding"] if len(v) == dim], np.float64))
    book = Codebook.fit(x, max(1, min(ceil(sqrt(size)), len(x) // 8)), slices)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own, code = book.encode(_unit(np.array(batch["embedding"].tolist(), np.float64)))
                yield pd.DataFrame({"entity_id": batch["entity_id"], "list": own, "code": [c.tobytes() for c in code]})

    coded = rows.mapInPandas(encode, "entity_id long, list int, code binary")
    coded = save(coded, "codes")
    counts = coded.groupBy("list").agg(F.ceil(F.count("*") / per_part).alias("parts"))  # a row a list, of a bounded number
    return Index(book, save(coded.join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("parts"))), "lists"), rows, size)


def scan(index: Index, queries: DataFrame, lists: int, short: int, per_chunk: int = 5_000) -> DataFrame:
    """qid, entity_id, rough: the ``short`` best codes of each query's ``lists`` nearest lists.  Queries go in chunks of at most
    about ``per_chunk`` that share their nearest list (all in one if they are few), and a chunk meets the lists only that
    its queries scan."""
    book, few = index.book, queries.count() <= per_chunk

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q = _unit(np.array(batch["embedding"].tolist(), np.float64))
                near = np.argsort(-(q @ book.centres.T), axis=1, kind="stable")[:, :lists]
                yield pd.DataFrame({"qid": np.repeat(batch["qid"].to_numpy(), near.shape[1]), "list": near.ravel(), "first": np.repeat(near[:, 0], near.shape[1])})

    wanted = queries.mapInPandas(order, "qid long, list int, first int")
    hot = wanted.where("list = first").groupBy("first").agg(F.ceil(F.count("*") / per_chunk).alias("cuts"))  # a row a list
    parts = index.codes.groupBy("list").agg(F.first("parts").alias("parts"))
    asked = wanted.join(F.broadcast(parts), "list").join(F.broadcast(hot), "first").join(queries, "qid")
    asked = asked.withColumn("chunk", F.lit(0).cast("long") if few else F.col("first") * F.lit(1 << 32) + F.pmod(F.xxhash64("qid"), F.col("cuts")))
    asked = save(asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))), "asked")
    pairs = save(asked.select("list", "part", "chunk").distinct(), "tiles")
    held = index.codes.join(pairs, ["list", "part"]).select("list", "part", "chunk", "entity_id", "code")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": np.zeros(0, np.int64), "entity_id": np.zeros(0, np.int64), "rough": np.zeros(0)})]
        if len(left) and len(right):
            ids = left["entity_id"].to_numpy()
            code = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
            centre = book.centres[int(left["list"].iloc[0])]
            for a in range(0, len(right), 64):
                q = _unit(np.array(right["embedding"].iloc[a : a + 64].tolist(), np.float64))
                table = book.lookup(q)
                score = np.repeat((q @ centre)[:, None], len(left), axis=1)
                for s in range(code.shape[1]):
                    score += table[:, s, code[:, s]]
                for i in range(len(q)):
                    best = np.argpartition(-score[i], short - 1)[:short] if len(left) > short else np.arange(len(left))
                    out.append(pd.DataFrame({"qid": right["qid"].iloc[a + i], "entity_id": ids[best], "rough": score[i][best]}))
        return pd.concat(out)

    keys = ["list", "part", "chunk"]
    found = held.groupBy(*keys).cogroup(asked.select("qid", "embedding", *keys).groupBy(*keys)).applyInPandas(meet, FOUND)
    return top_k(found, ["qid"], [F.desc("rough"), F.col("entity_id")], short)


def rerank(index: Index, queries: DataFrame, shortlist: DataFrame, k: int) -> DataFrame:
    """The k best by the cosine of the original vectors"""
    pair = shortlist.select("qid", "entity_id").join(queries.select("qid", F.col("embedding").alias("q")), "qid").join(index.rows, "entity_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    score = F.round(dot("q", "embedding") / F.sqrt(dot("q", "q")) / F.sqrt(dot("embedding", "embedding")), 9)
    return top_k(pair.select("qid", "entity_id", score.alias("score")), ["qid"], [F.desc("score"), F.col("entity_id")], k)


def calibrate(index: Index, tested: DataFrame, k: int, target: float) -> tuple[int, int, DataFrame, DataFrame]:
    """(lists, shortlist, the queries kept for measuring, their true neighbours).  Only counts of found neighbours and the
    bounded query set's ranks reach the driver."""
    truth = save(vector_search(tested, index.rows, k).select("qid", "entity_id", F.col("rank").alias("true_rank")), "truth")
    half = F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(2))
    fit = tested.where(half == 0)
    want = truth.where(half == 0)
    n = max(1, want.count())
    margin = 1.64 * sqrt(target * (1 - target) / n)
    every = len(index.book.centres)
    place = want.join(index.codes.select("entity_id", "list"), "entity_id").join(fit, "qid").toPandas()  # k rows a query of a bounded set
    q = _unit(np.array(place["embedding"].tolist(), np.float64).reshape(len(place), index.book.centres.shape[1]))
    near = np.argsort(np.argsort(-(q @ index.book.centres.T), axis=1, kind="stable"), axis=1)
    at = np.sort(near[np.arange(len(place)), place["list"].to_numpy(int)]) if len(place) else np.zeros(1, int)
    lists = min(every, int(at[min(len(at) - 1, int(ceil((target + (1 - target) / 2 + margin) * len(at))) - 1)]) + 1)
    short = max(k, min(index.size, 40 * k))
    ranked = scan(index, fit, lists, short).join(want.select("qid", "entity_id"), ["qid", "entity_id"])
    seen = np.sort([r["rank"] for r in ranked.select("rank").collect()])  # k rows a query again
    need = int(ceil(min(1.0, target + margin) * n))
    short = int(max(k, seen[need - 1] + 1)) if len(seen) >= need else short
    return lists, short, tested.where(half == 1), truth.where(half == 1)


def ann_search(queries: DataFrame, vectors: DataFrame, k: int, target: float = 0.9, tested: int = 400) -> DataFrame:
    """qid, entity_id, rank, score, and of the whole search recall (measured on held-out queries), met (share of the rows
    whose vectors a query meets) and scanned (share of the lists whose codes it reads).

    Defined cases: null, empty or zero vectors and such with null or non-finite components take no part; equal scores go
    by id; an empty side gives an empty table."""
    empty = "qid long, entity_id long, rank int, score double, recall double, met double, scanned double"
    index, wanted = build_index(vectors), save(usable(queries, "qid"), "queries")
    if index is None or wanted.isEmpty():
        return queries.sparkSession.createDataFrame([], empty)
    wanted = wanted.where(F.size("embedding") == index.book.centres.shape[1])
    sample = save(wanted.orderBy(F.xxhash64("qid", F.lit(2)), "qid").limit(tested), "tested")
    lists, short, kept, truth = calibrate(index, sample, k, target)
    found = save(rerank(index, wanted, scan(index, wanted, lists, short), k), "found")
    hit = truth.join(found.select("qid", "entity_id", F.lit(1).alias("hit")), ["qid", "entity_id"], "left")
    recall = hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    share = [F.lit(recall).cast("double").alias("recall"), F.lit(short / index.size).alias("met"), F.lit(lists / len(index.book.centres)).alias("scanned")]
    return found.select("qid", "entity_id", F.col("rank").cast("int").alias("rank"), "score", *share)

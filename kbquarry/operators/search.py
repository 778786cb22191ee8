"""Retrieval: keyword, vector and graph search for many questions at once (R rows)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import save
from .tiled_scores import asked_terms, tiled_top_k, weighted_words
from .windows import top_k


def word_fields(body_chars: int = 2000) -> list[tuple]:
    """A word counts 3 in the name, 2 in the description, 1 in the body's start."""
    return [(X.word_set(F.col("name")), 3), (X.word_set(F.col("description")), 2), (X.word_set(F.substring("body", 1, body_chars)), 1)]


def keyword_search(questions: DataFrame, entities: DataFrame, k: int, body_chars: int = 2000, divide: bool = True) -> DataFrame:
    """Qid, entity_id, score, rank; hits are summed as whole numbers and divided by the question's words at the end"""
    words = save(questions.select("qid", X.word_set(F.col("question")).alias("ws")), "questions")
    asked = words.select("qid", F.explode("ws").alias("term"), F.lit(1).alias("factor"))
    found = tiled_top_k(weighted_words(entities, word_fields(body_chars)), asked, k)
    sizes = words.groupBy("qid").agg(F.max(F.size("ws")).alias("n"))
    return found.join(sizes, "qid").select("qid", "entity_id", (F.col("score") / (F.col("n") if divide else F.lit(1.0))).alias("score"), "rank")


def bm25_search(questions: DataFrame, entities: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """R18"""
    tokens = save(entities.select("entity_id", X.words(F.col("body")).alias("ws")), "words")  # each text is split once
    n, mean = tokens.agg(F.count("*"), F.coalesce(F.avg(F.size("ws")), F.lit(1.0))).first()
    asked = save(questions.select("qid", F.explode(X.word_set(F.col("question"))).alias("term"), F.lit(1).alias("factor")), "asked")
    terms = asked_terms(asked)
    found = tokens.select("entity_id", F.size("ws").alias("len"), F.explode("ws").alias("term")).join(terms.select("term"), "term", "left_semi")
    hits = save(found.groupBy("entity_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "postings")
    df = save(hits.groupBy("term").agg(F.count("*").alias("df")), "terms")  # a row an asked term
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    postings = hits.join(df, "term").select("term", "entity_id", part.alias("weight"))
    return tiled_top_k(postings, asked, k, digits=6, terms=terms).select("qid", "entity_id", "score", "rank")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, per_block: int = 5_000, digits: int = 9, blocks: int = 16, most_per_block: int = 50_000) -> DataFrame:
    """Cosine, each query against all rows.  Queries are dealt to blocks of about ``per_block`` by their ids, rows to about ``blocks``
    blocks of ``per_block`` to ``most_per_block``, so that a query's rows to rank don't grow with the table before that is reached;
    every two blocks meet in a task, which gives its own best k, and a window the best of those.  Cosines are rounded to ``digits``
    before they are ranked.  A query of zeros finds nothing."""
    wanted = save(queries.select("qid", F.col("embedding").alias("q")), "queries")
    rows = vectors.select("entity_id", "embedding")
    n = rows.count()
    nq, nv = max(1, -(-wanted.count() // per_block)), max(1, -(-n // min(max(per_block, -(-n // blocks)), max(per_block, most_per_block))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("vb", F.pmod(F.xxhash64("entity_id"), F.lit(nv)).cast("int")).withColumn("qb", every(nq))
    right = wanted.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("vb", every(nv))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": np.zeros(0, np.int64), "entity_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(left) and len(right):
            x, ids = np.array(left["embedding"].tolist(), np.float64), left["entity_id"].to_numpy()
            x /= np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
            step = max(1, min(256, 1_280_000 // len(x)))  # as many cosines at a time as a block of 5 000 has
            for a in range(0, len(right), step):
                q = np.array(right["q"].iloc[a : a + step].tolist(), np.float64)
                norm = np.linalg.norm(q, axis=1, keepdims=True)
                s = np.round((q / np.where(norm == 0, 1, norm)) @ x.T, digits)
                for i in np.nonzero(norm[:, 0])[0]:
                    far = -s[i]
                    near = np.nonzero(~(far > np.partition(far, k - 1)[k - 1]))[0] if len(ids) > k else np.arange(len(ids))
                    best = near[np.lexsort((ids[near], far[near]))[:k]]
                    out.append(pd.DataFrame({"qid": right["qid"].iloc[a + i], "entity_id": ids[best], "score": s[i][best]}))
        return pd.concat(out)

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(meet, "qid long, entity_id long, score double")
    return top_k(found, ["qid"], [F.desc("score"), F.col("entity_id")], k)


def leaving(edges: DataFrame, front: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of ``edges`` (id) that leave an id of ``front``, saved, so that joins see how few they are.  Edges are probed against the distinct ids, of
    which up to ``most`` go to every task, and are never sorted."""
    ids = save(front.select("id").distinct(), "ids")
    return save(edges.join(F.broadcast(ids) if ids.count() <= most else ids.hint("shuffle_hash"), "id", "left_semi"), "leaving")


def graph_search(seeds: DataFrame, edges: DataFrame, hops: int = 3, decay: tuple[float, ...] = (1.0, 0.85, 0.7, 0.55), types: DataFrame | None = None, known: DataFrame | None = None, visits: bool = True, keep: bool = True, most: int = 1_000_000) -> DataFrame:
    """(qid, id, ord) -> qid, id, hop, score, ord (order of visit), rel_from, rel_type (of the first visit; null for seeds);
    outgoing edges, of the question's edge types where ``types`` (qid, rel_type) names some, first visit wins, in
    first-in-first-out order.  A null rel_type names no edge: a question with that one alone keeps its seeds only.  With ``known``
    (id) other ids are neither returned nor expanded.  Repeated edges change nothing.
    Without ``visits`` only qid, id, hop and score, which need no order; without ``keep`` the edges, which every hop
    reads, aren't saved first (for plain scans).  ``most``: see leaving()."""
    if known is not None:
        seeds, edges = seeds.join(known.select("id"), "id", "left_semi"), edges.join(known.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    none = F.lit(None).cast("string")
    edges = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to"), "rel_type")
    edges = save(edges, "edges") if keep else edges
    seen = save(seeds.select("qid", "id", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("hop"), F.lit(None).cast(seeds.schema["id"].dataType).alias("rel_from"), none.alias("rel_type")), "seen")
    front = seen
    for hop in range(1, hops + 1):
        reached = front.select("qid", "id", "ord").join(leaving(edges, front, most), "id")
        if types is not None:
            limited = types.select("qid").distinct().withColumn("limited", F.lit(True))
            reached = reached.join(limited, "qid", "left").join(types.withColumn("named", F.lit(True)), ["qid", "rel_type"], "left").where("limited is null or named")
        reached = reached.select("qid", F.col("to").alias("id"), "ord", "rel_type", F.col("id").alias("rel_from"))
        if visits:  # many edges lead to few ids: grouped before they meet what was seen
            first = reached.groupBy("qid", "id").agg(F.min(F.struct("ord", "rel_type", "id", "rel_from")).alias("o")).join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
            place = F.row_number().over(Window.partitionBy("qid").orderBy("o"))
            first = first.select("qid", "id", (place + hop * (1 << 32)).alias("ord"), F.lit(hop).alias("hop"), F.col("o.rel_from").alias("rel_from"), F.col("o.rel_type").alias("rel_type"))
        else:
            first = reached.select("qid", "id").distinct().join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
            first = first.select("qid", "id", F.lit(None).cast("long").alias("ord"), F.lit(hop).alias("hop"), F.lit(None).cast(seeds.schema["id"].dataType).alias("rel_from"), none.alias("rel_type"))
        front = save(first, "front")
        seen = seen.unionByName(front)
    score = F.get(F.array(*map(F.lit, decay)), F.col("hop"))
    return seen.select("qid", "id", "hop", score.alias("score"), *(["ord", "rel_from", "rel_type"] if visits else []))

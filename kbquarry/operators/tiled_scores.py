"""Top-k of summed term weights by tiles (R2, R3, R18): blocks of entities meet blocks of queries, hits are summed within a
task and only each tile's best rows are shuffled.

What is written and shuffled are the postings of asked words, once a block of queries; all hits together (postings times
the queries that ask for their word) are never rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .scan import numbered
from .windows import top_k


def asked_terms(asked: DataFrame, most: int = 200_000) -> DataFrame:
    """term, t: the distinct terms of ``asked`` and a number of each; up to ``most`` go to every task"""
    terms = save(numbered(asked.select("term").where("term is not null").distinct(), "term", name="t"), "terms")
    return F.broadcast(terms) if terms.count() <= most else terms


def tiled_top_k(postings: DataFrame, asked: DataFrame, k: int, digits: int = 9, terms: DataFrame | None = None, per_block: int = 1_000_000, asked_per_block: int = 200_000) -> DataFrame:
    """``postings`` (term, entity_id, weight > 0) x ``asked`` (qid, term, factor) -> qid, entity_id, score, rank: the ``k``
    greatest sums of factor * weight (factor > 0), rounded to ``digits``, equal ones by entity_id.  Entities are dealt to blocks
    of about ``per_block`` postings by their ids, queries to blocks of about ``asked_per_block`` rows.

    Defined cases: repeated postings and repeated rows of ``asked`` add up; a term without postings adds nothing; a query that
    finds nothing gives no row; fewer than k entities give them all; rows without an entity_id count as one entity, queries
    without a qid take no part."""
    terms = asked_terms(asked) if terms is None else terms
    wanted = save(asked.where("factor > 0 and qid is not null").join(terms, "term").groupBy("qid", "t").agg(F.sum("factor").cast("double").alias("factor")), "asked")
    rows = save(postings.join(terms, "term").select("t", "entity_id", F.col("weight").cast("double").alias("weight")), "postings")
    nq, nv = max(1, -(-wanted.count() // asked_per_block)), max(1, -(-rows.count() // per_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("entity_id is not null").withColumn("vb", F.pmod(F.xxhash64("entity_id"), F.lit(nv)).cast("int")).withColumn("qb", every(nq))
    right = wanted.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("vb", every(nv))
    q, e = (df.schema[c].dataType.simpleString() for df, c in ((asked, "qid"), (postings, "entity_id")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        qids, found, scores = [], [], []
        if len(left) and len(right):
            at, ids = pd.factorize(left["entity_id"], sort=True)
            order = np.argsort(left["t"].to_numpy(), kind="stable")
            at, weight = at[order], left["weight"].to_numpy()[order]
            known, starts = np.unique(left["t"].to_numpy()[order], return_index=True)
            ends = np.append(starts[1:], len(at))
            for qid, mine in right.groupby("qid", sort=False):
                t, factor = mine["t"].to_numpy(), mine["factor"].to_numpy()
                place = np.minimum(np.searchsorted(known, t), len(known) - 1)
                parts = [(starts[p], ends[p], f) for p, f in zip(place[known[place] == t], factor[known[place] == t], strict=True)]
                if not parts:
                    continue
                total = np.bincount(np.concatenate([at[a:b] for a, b, _ in parts]), np.concatenate([weight[a:b] * f for a, b, f in parts]), len(ids))
                hit = np.nonzero(total)[0]
                score = np.round(total[hit], digits)
                if len(hit) > k:
                    near = score >= np.partition(score, -k)[-k]
                    hit, score = hit[near], score[near]
                best = np.lexsort((hit, -score))[:k]
                qids += [qid] * len(best)
                found.append(ids[hit[best]])
                scores.append(score[best])
        if not found:
            return pd.DataFrame({"qid": right["qid"].iloc[:0], "entity_id": left["entity_id"].iloc[:0], "score": np.zeros(0)})
        return pd.DataFrame({"qid": qids, "entity_id": np.concatenate(found), "score": np.concatenate(scores)})

    tiles = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(meet, f"qid {q}, entity_id {e}, score double")
    unnamed = rows.where("entity_id is null").join(wanted, "t").groupBy("qid").agg(F.round(F.sum(F.col("factor") * F.col("weight")), digits).alias("score"))
    tiles = tiles.unionByName(unnamed.select("qid", F.lit(None).cast(e).alias("entity_id"), "score"))
    return top_k(tiles, ["qid"], [F.desc("score"), F.col("entity_id")], k)


def weighted_words(entities: DataFrame, fields: list[tuple]) -> DataFrame:
    """term, entity_id, weight: a row for each field (array of words, weight) that holds the word"""
    weighted = lambda words, v: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(v).alias("weight")))
    return entities.select("entity_id", F.explode(F.concat(*[weighted(words, v) for words, v in fields])).alias("x")).select("entity_id", "x.*")

"""Top-k of summed term weights without all hits (J7): impact-ordered postings, read in blocks under a
threshold of each query.

Postings of a term are placed by weight (and id), by one distributed sort of all postings: no term's list lies in one
task.  A round reads the first places of each term's list, scores what it finds there in full (a join on term and
entity) and settles every query whose k-th score is above the sum of the weights at which its lists stopped: nothing
unread can reach it.  Queries that aren't settled read on to ``grow`` times as many places, and after ``rounds`` rounds to
the end.  Rare terms' lists end in the first block; a hot term's list is read only as far as it can matter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .scan import numbered
from .windows import top_k


@dataclass
class ImpactIndex:
    """``postings``: term, entity_id, weight, place (from 0 in the term's own list)"""

    postings: DataFrame

    @classmethod
    def build(cls, postings: DataFrame) -> ImpactIndex:
        """``postings`` (term, entity_id, weight > 0), a row a term and entity"""
        placed = numbered(postings.select("term", "entity_id", "weight"), F.col("term"), F.desc("weight"), F.col("entity_id"), name="at")
        first = save(placed.groupBy("term").agg(F.min("at").alias("first")), "terms")
        return cls(save(placed.join(first, "term").select("term", "entity_id", "weight", (F.col("at") - F.col("first")).alias("place")), "postings"))

    def search(self, asked: DataFrame, k: int, block: int = 512, grow: int = 8, rounds: int = 3, counts: list | None = None, direct: int = 20_000_000) -> DataFrame:
        """``asked`` (qid, term, factor) -> qid, entity_id, score, rank: the ``k`` greatest sums of factor * weight (factor > 0),
        equal ones by entity_id.  Where all hits together are at most ``direct`` they are read at once, which gives the same.
        ``counts`` gets the number of postings that each round read.

        Defined cases: a term without postings adds nothing; a query that finds nothing gives no row; fewer than k
        entities give them all."""
        live, found, depth = save(asked.where("factor > 0").groupBy("qid", "term").agg(F.sum("factor").alias("factor")), "asked"), [], block
        lengths = self.postings.join(live.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
        hits = live.join(lengths, "term").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        for turn in range(rounds + 1):
            last = turn == rounds or hits <= direct
            terms = live.select("term").distinct()
            near = self.postings if last else self.postings.where(F.col("place") <= depth)
            near = near.join(terms, "term", "left_semi")
            if counts is not None:
                counts.append(near.count())
            stops = near.where(F.col("place") == depth).select("term", F.col("weight").alias("stop")) if not last else None
            if last:
                full = live.join(near.select("term", "entity_id", "weight"), "term")
            else:
                met = live.select("qid", "term").join(near.where(F.col("place") < depth), "term").select("qid", "entity_id").distinct()
                full = met.join(live, "qid").join(self.postings.select("term", "entity_id", "weight"), ["term", "entity_id"])
            scores = full.groupBy("qid", "entity_id").agg(F.round(F.sum(F.col("factor") * F.col("weight")), 9).alias("score"))  # whatever the order of summing
            best = save(top_k(scores, ["qid"], [F.desc("score"), F.col("entity_id")], k), "best")
            if last:
                found.append(best)
                break
            limit = live.join(stops, "term", "left").groupBy("qid").agg(F.coalesce(F.sum(F.col("factor") * F.col("stop")), F.lit(0)).alias("limit"))
            kth = best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
            settled = save(limit.join(kth, "qid", "left").where((F.col("limit") == 0) | ((F.col("n") == k) & (F.col("kth") > F.col("limit") * (1 + 1e-9)))).select("qid"), "settled")
            found.append(best.join(settled, "qid", "left_semi"))
            live = save(live.join(settled, "qid", "left_anti"), "asked")
            if live.isEmpty():
                break
            depth *= grow
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

"""The knowledge base as one object with three searches, its tunables, and the plug points (P rows)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search


@dataclass(frozen=True)
class RetrievalConfig:
    """P5"""

    rrf_k: int = 60
    hops: int = 3
    blend: float = 0.3
    confidence_weight: float = 0.3
    top: int = 15
    type_ratio: float = 0.5
    layer_ratio: float = 0.6
    text_overlap: float = 0.85
    token_budget: int = 24_000
    least_share: int = 250
    most_share: int = 2_500

    @staticmethod
    def candidates(entities: int) -> int:
        """How many rows a search asks for"""
        return max(20, min(200, entities // 5))

    @staticmethod
    def seeds(entities: int) -> int:
        """How many found rows the graph search starts from"""
        return min(15, max(5, entities // 100))


@dataclass(frozen=True)
class KnowledgeBase:
    """Entities (entity_id, name, description, body ..), their vectors (entity_id, embedding) and edges."""

    entities: DataFrame
    vectors: DataFrame
    edges: DataFrame
    config: RetrievalConfig = RetrievalConfig()

    def vector(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, embedding) -> qid, entity_id, score, rank.  Rows that aren't entities fall out after the cut."""
        return search.vector_search(queries, self.vectors, k).join(self.entities.select("entity_id"), "entity_id", "left_semi")

    def keyword(self, questions: DataFrame, k: int) -> DataFrame:
        """(qid, question) -> qid, entity_id, score, rank"""
        return search.keyword_search(questions, self.entities, k)

    def graph(self, seeds: DataFrame, types: DataFrame | None = None) -> DataFrame:
        """(qid, id, ord) -> qid, id, hop, score, ord"""
        return search.graph_search(seeds, self.edges, self.config.hops, types=types)


def hashing_embedder(size: int = 64):
    """A deterministic stand-in for an embedding service, as a vectorized function of a text column.  Each word adds
    one to or takes one from a place that its hash names; the vector has length one, or is zero for texts without words."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros((len(texts), size), np.float32)
            for row, words in zip(out, texts.fillna("").str.lower().str.findall(r"\w+"), strict=True):
                if words:
                    h = pd.util.hash_array(np.array(words, object), categorize=False)
                    np.add.at(row, (h % np.uint64(size)).astype(int), np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1))
                    row /= max(float(np.linalg.norm(row)), 1e-12)
            yield pd.Series(list(out))

    return embed


def synthesize_fallback(context: Column) -> Column:
    """P2 without a model: an answer from the context alone"""
    bare = F.trim(F.coalesce(context, F.lit(""))) == ""
    return F.struct(F.when(bare, "").otherwise(F.substring(context, 1, 500)).alias("answer"), F.when(bare, "not_answerable").otherwise("partial").alias("score"))

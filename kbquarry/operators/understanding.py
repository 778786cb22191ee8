"""What a question asks for (X14): intents, layers, edge types, flags and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology
from ..functions import text as X


def understand(questions: DataFrame, text: str = "question") -> DataFrame:
    """``questions`` plus w_<intent> (null: no pattern matches), l_<layer> (its priority, 1 at least), dominant (the first of the
    intents with the greatest weight), edge_types (those that it follows; null: all), is_listing, is_comparison, keywords."""
    weights = X.intents(F.col(text))
    rows = questions.withColumns({f"w_{i}": w for i, w in weights.items()})
    named = {i: F.col(f"w_{i}") for i in weights}
    top = F.greatest(*[F.coalesce(w, F.lit(0.0)) for w in named.values()])
    dominant = F.coalesce(*[F.when(w == top, F.lit(i)) for i, w in named.items()])
    rows = rows.withColumns({**{f"l_{k}": c for k, c in X.layer_priorities(named).items()}, "dominant": dominant})
    edges = F.lit(None).cast("array<string>")
    for intent, types in ontology.INTENT_EDGES.items():
        edges = F.when(F.col("dominant") == intent, F.array(*map(F.lit, types))).otherwise(edges)
    return rows.withColumns({"edge_types": edges, "is_listing": F.col("w_listing").isNotNull(), "is_comparison": F.col("w_comparison").isNotNull(), "keywords": X.keywords(F.col(text))})

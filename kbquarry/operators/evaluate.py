"""Batch evaluation of questions (R21): retrieval, diversity, context, answer and class, composed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import backend, context, fuse


def run_eval(questions: DataFrame, scored: DataFrame, entities: DataFrame, relations: DataFrame, config: backend.RetrievalConfig = backend.RetrievalConfig(), synthesize=backend.synthesize_fallback) -> DataFrame:
    """qid, question, answer, score, ddc_class, entities_retrieved.  ``scored``: the adjusted candidates (qid, entity_id,
    score, layer, entity_type, priority).  ``synthesize`` makes an answer and its score from a column of contexts.  A
    question that finds nothing, or whose answer fails, is MISSING."""
    kept = fuse.diversify(scored, config.top, config.type_ratio, config.layer_ratio)
    found = context.context_text(context.pack_blocks(kept, entities, relations, config))
    answered = found.select("qid", F.col("blocks").alias("n"), synthesize(F.col("context")).alias("a"))
    score = F.coalesce("a.score", F.lit("not_answerable"))
    rows = questions.join(answered, "qid", "left")
    return rows.select("qid", "question", F.coalesce("a.answer", F.lit("")).alias("answer"), score.alias("score"), X.ddc_class(score).alias("ddc_class"), F.coalesce("n", F.lit(0)).alias("entities_retrieved"))

"""Validation and coverage helpers (F1, A rows)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_kebab


def validation_errors(least_confidence: float = 0.0) -> Column:
    """messages of what is wrong with an entity"""
    checks = [(F.col("name") == "", "name"), (F.col("confidence") < least_confidence, "confidence"), (~is_kebab(F.col("entity_type")), "type")]
    return F.filter(F.array(*[F.when(bad, F.lit(what)) for bad, what in checks]), lambda x: x.isNotNull())


def coverage(rows: DataFrame) -> DataFrame:
    """A4: totals, classes, shares to one place, cost"""
    n = F.count("*")
    share = lambda c: F.coalesce(F.round(100 * F.try_divide(F.count_if(F.col("ddc_class") == c), n), 1), F.lit(0.0))
    return rows.agg(n.alias("total"), *[F.count_if(F.col("ddc_class") == c).alias(c.lower()) for c in ("CLEAN", "INCOMPLETE", "MISSING")], share("CLEAN").alias("clean_pct"), F.round(0.02 * n, 2).alias("cost"))


def coverage_by(rows: DataFrame, *dims: str) -> DataFrame:
    """A5: class counts by each dimension in one pass of grouping sets"""
    sets = [[F.col(c)] for c in dims]
    out = rows.groupingSets(sets, *[F.col(c) for c in dims]).agg(F.grouping_id().alias("g"), *[F.count_if(F.col("ddc_class") == c).alias(c.lower()) for c in ("CLEAN", "INCOMPLETE", "MISSING")])
    full = (1 << len(dims)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(dims):
        own = F.col("g") == full - (1 << (len(dims) - 1 - i))
        name, value = F.when(own, c).otherwise(name), F.when(own, F.col(c).cast("string")).otherwise(value)
    return out.select(name.alias("dim"), F.coalesce(value, F.lit("unclassified")).alias("value"), "clean", "incomplete", "missing").where("value <> ''")

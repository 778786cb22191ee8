"""Windows, top-k and keep-one (W, T rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import numbered


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rank from 0; the order must end in a tie-breaker"""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1).where(F.col(rank) < k)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W10"""
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def min_max_norm(df: DataFrame, part: str, score: str) -> DataFrame:
    """Shares of the part's maximum, and its least and greatest score"""
    w = Window.partitionBy(part)
    return df.withColumns({"lo": F.min(score).over(w), "hi": F.max(score).over(w)}).withColumn("norm", F.coalesce(F.try_divide(F.col(score), F.col("hi")), F.lit(0.0)))


def cap_share(df: DataFrame, part: str, group: str, ratio: float, order: list[Column], free: Column | None = None) -> DataFrame:
    """Of each group at most max(1, floor(ratio * rows of the part)); all rows where ``free`` is true"""
    n = F.count("*").over(Window.partitionBy(part))
    r = F.row_number().over(Window.partitionBy(part, group).orderBy(*order))
    return df.withColumns({"_n": n, "_r": r}).where((F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))) | F.coalesce(F.lit(False) if free is None else free, F.lit(False))).drop("_n", "_r")


def take_until_budget(df: DataFrame, part: list[str], order: list[Column], size: str, budget: float) -> DataFrame:
    """Rows until the running total first passes the budget"""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def interleave(df: DataFrame, part: str, group: str, order: list[Column], priority: list[Column]) -> DataFrame:
    """Round robin over groups, ``pos`` from 1"""
    turn = F.row_number().over(Window.partitionBy(part, group).orderBy(*order))
    return df.withColumn("turn", turn).withColumn("pos", F.row_number().over(Window.partitionBy(part).orderBy("turn", *priority)))


def budget_share(df: DataFrame, part: str, score: str, budget: int, lo: int, hi: int) -> DataFrame:
    """W6"""
    share = F.floor(budget * F.coalesce(F.try_divide(F.col(score), F.sum(score).over(Window.partitionBy(part))), F.lit(0.0)))
    return df.withColumn("share", F.greatest(F.lit(lo), F.least(F.lit(hi), share)).cast("long"))


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """Ties by key"""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def pages(rows: DataFrame, group: str, key: str, size: int = 1000) -> DataFrame:
    """Group, page, keys: each group's keys in order, in lists of ``size``: no list grows with the table"""
    placed = global_order(rows.select(group, key), [group, key])
    least = placed.groupBy(group).agg(F.min("pos").alias("_least"))
    paged = placed.join(least, group).withColumn("page", F.floor((F.col("pos") - F.col("_least")) / size))
    return paged.groupBy(group, "page").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def global_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` plus pos, their place (from 1) in the order of the columns ``by``"""
    return numbered(rows, *by, name="pos").withColumn("pos", F.col("pos") + 1)

"""Tables that batches change: copy-on-write versions of hash buckets, with every batch applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import scratch_path


class KeyedTable:
    """Rows with a key, in ``buckets`` parts by its hash.  A batch with a number is folded into the buckets that it touches: their
    rows and the batch's are united and given to ``fold``, and the result is written under the batch's number.  A log says
    which version of a bucket counts, and is written last: a batch that fails leaves nothing, one that runs again reads the
    versions before its own and gives the same.  Other buckets aren't read.

    ``fold`` takes a DataFrame of ``schema`` and returns one with a row a key (or what else a key's state is); it must give
    the same whether rows come at once or folded before.  Versions that no longer count stay for readers until
    expire()."""

    def __init__(self, spark: SparkSession, keys: list[str], schema: T.StructType | str, fold: Callable[[DataFrame], DataFrame], path: str | None = None, buckets: int = 32):
        self.spark, self.keys, self.fold, self.buckets = spark, keys, fold, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.path = path or scratch_path(spark, "keyed")

    def _log(self) -> DataFrame:
        """bucket, version: a row for each bucket that a batch wrote"""
        seen = self.spark.createDataFrame([], "bucket int, version long")
        seen.write.mode("ignore").parquet(f"{self.path}/log/version=-1")
        return self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/log")

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The version that counts of each bucket: ``buckets`` numbers at most"""
        log = self._log().where("version >= 0")
        log = log if before is None else log.where(F.col("version") < before)
        return {r["bucket"]: r["version"] for r in log.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """The table, or as it was before the batch with a number"""
        return self._rows(self.versions(before))

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, number: int) -> None:
        batch = batch.select(*self.schema.names).persist()
        try:
            touched = {r[0] for r in batch.select(self.bucket()).distinct().collect()}  # ``buckets`` numbers at most
            before = {b: v for b, v in self.versions(before=number).items() if b in touched}
            rows = self._rows(before).unionByName(batch) if before else batch
            folded = self.fold(rows).select(*self.schema.names, self.bucket().alias("bucket"))
            folded.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number}")
        finally:
            batch.unpersist()
        log = self.spark.createDataFrame([(b,) for b in sorted(touched)], "bucket int")
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={number}")


def latest(keys: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """The fold that keeps the last row of each key by ``order``"""

    def fold(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")

    return fold

"""What the operators of this subpackage share: scratch tables and word helpers."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import save  # noqa: F401  (for the operators)


#: A word is a run of anything but these seven ASCII characters.
SPACES = "\t\n\x0b\x0c\r "
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (Spark's lower() also folds other alphabets)."""
    return F.translate(c, UPPER, LOWER)


def text_words(c: Column) -> Column:
    """The words of a text, null as none.  split() once beats a regular-expression extraction."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def plain_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that further columns with clashing names do no harm."""
    return df.select(*[F.col(n) for n in names])


class HashCache(dict):
    """word (bytes) -> 64-bit hash, forgotten as a whole when it holds ``limit`` words: memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with equal keys, as arrays by column, from batches that are sorted by these keys (no null keys)."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        columns = {n: table.column(n).combine_chunks() for n in table.column_names}
        values = {n: c.to_numpy(zero_copy_only=False) for n, c in columns.items()}
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in keys:
            change |= values[k][1:] != values[k][:-1]
        edges = [0, *(np.nonzero(change)[0] + 1).tolist(), table.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield {n: v[a:b] for n, v in values.items()}

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tail = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        head = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and head != last:
            yield from cut(pa.Table.from_batches(held))
            held = []
        if held and tail == last:
            held.append(batch)
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held)
        stop = whole.num_rows
        columns = [whole.column(k).to_numpy() for k in keys]
        same = np.ones(stop, bool)
        for c, v in zip(columns, tail, strict=True):
            same &= c == v
        start = stop - int(same[::-1].argmin()) if not same.all() else 0
        if start:
            yield from cut(whole.slice(0, start))
        held, last = whole.slice(start).to_batches(), tail
    if held:
        yield from cut(pa.Table.from_batches(held))

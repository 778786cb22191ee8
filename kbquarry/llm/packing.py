"""Best-fit packing of token sequences, certified by bounds.

1. Every text becomes ids plus an end id; only longer ones are cut, the first piece being the shorter one.
2. Pieces that fill a sequence stand alone.  The others are dealt to groups of bounded size and each group is packed
   best-fit decreasing.  A dual feasible function maps lengths so that the mapped sum over the capacity can't exceed the
   number of bins of any packing; the largest such bound certifies a group's bin count.
3. Groups above their bound give up their loosest bins; these pieces are dealt anew to fewer groups and packed again.
   It stops when each group meets its bound or when a round saves no bin.
4. certify() gives the number of sequences of the whole packing and the bound of all its pieces, from a histogram.

Defined cases: null or empty text -> the end id alone; ties go by a piece's number in the stored table; equal rows are packed
as often as they occur, rows without an id like all others; texts are taken whole, in slices; an empty table -> an empty
table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import save

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "pid long, length long, gid long, bin long, offset long, bins long, bound long"


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece, without the ids themselves."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.library_encoder(path, pattern)
        for whole in batches:
            for batch in bpe.slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = enc(text) + end
                    n, at = len(ids) // 4, 0
                    cuts = [n] if n <= capacity else [*range(n % capacity or capacity, n + 1, capacity)]
                    for k, stop in enumerate(cuts):
                        rows.append((doc, k, at, stop - at, zlib.crc32(ids[at * 4 : stop * 4])))
                        at = stop
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """From the number of pieces of each length: the largest bound of two families of dual feasible functions: thresholds (lengths under t count nothing, those over
    capacity - t a whole bin) and roundings to k-ths."""
    size = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    by_t = mass[capacity - t] - mass[t - 1] + capacity * (number[-1] - number[capacity - t])
    best = max([int(mass[-1]), *by_t.tolist()])
    bound = -(-best // capacity)
    for k in range(1, 64):
        whole = (size * (k + 1)) % capacity == 0
        mapped = np.where(whole, size * k, (size * (k + 1)) // capacity * capacity)  # times k
        bound = max(bound, -(-int((mapped * count).sum()) // (capacity * k)))
    return bound


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each length, number of bins.  Bins are kept by room; a bit set finds the
    tightest room that suffices."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - room
        if room > n:
            rooms[room - n].append(b)
            open_ |= 1 << (room - n)
    return where, offset, bins


def _pack_groups(pieces: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        pdf["bin"], pdf["offset"], bins = best_fit(lengths, capacity)
        return pdf.assign(gid=salt * (1 << 24) + key[0], bins=bins, bound=lower_bound(lengths, capacity))[[c.split()[0] for c in PACKED.split(", ")]]

    gid = F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(groups))
    return pieces.select("pid", "length", gid.alias("gid")).groupBy("gid").applyInPandas(run, PACKED)


def pack(pieces: DataFrame, capacity: int, per_group: int = 10_000, release: int = 8) -> DataFrame:
    """``pieces`` (PIECES) plus sequence_id and offset.  A group holds ``per_group`` pieces on average."""
    cols = [c.split()[0] for c in PIECES.split(", ")]
    pieces = save(pieces.select(*cols).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).select(*cols, (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // per_group))
    packed, done, turn = save(_pack_groups(rest, groups, 0, capacity), "packed"), [], 0
    while True:
        turn += 1
        above = packed.where(F.col("bins") > F.col("bound"))
        if above.isEmpty() or groups == 1:  # certified, or nothing to exchange with
            break
        loose = above.groupBy("gid", "bin").agg((F.lit(capacity) - F.sum("length")).alias("room"), F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("room"), "bin"))
        loose = loose.withColumn("r", rank).where(F.col("r") <= release * (F.col("bins") - F.col("bound"))).select("gid", "bin")
        given = save(packed.join(loose, ["gid", "bin"], "left_semi").select("pid", "length", "gid", "bin"), "given")
        n, before = given.count(), given.select("gid", "bin").distinct().count()
        groups = max(1, -(-n // per_group))
        again = save(_pack_groups(given.drop("gid", "bin"), groups, turn, capacity), "repacked")
        if again.select("gid", "bin").distinct().count() >= before:
            break
        done.append(packed.join(given.select("gid", "bin").distinct(), ["gid", "bin"], "left_anti").select(*packed.columns))
        packed = again
    for part in done:
        packed = packed.unionByName(part)
    placed = packed.select("pid", (F.col("gid") * F.lit(1 << 30) + F.col("bin")).alias("sequence_id"), "offset")
    return pieces.join(placed, "pid").select(*cols, "sequence_id", "offset").unionByName(full)


def certify(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Sequences used, and a lower bound for any packing of the same pieces."""
    lengths = packed.groupBy("length").count().toPandas()  # ``capacity`` rows at most
    counts = np.bincount(lengths["length"].to_numpy(np.int64), lengths["count"].to_numpy(np.int64), capacity + 1).astype(np.int64)
    return packed.select("sequence_id").distinct().count(), bound_of(counts, capacity)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(token_pieces(docs, path, pattern, capacity), capacity)

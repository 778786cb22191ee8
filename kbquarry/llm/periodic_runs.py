"""Periodic runs of words in texts, by recursive frequency splitting and a scan of lags.

In a run of at least ``repeats`` periods every word occurs that often.  So a word that occurs less often within a segment
belongs to no run there and splits it; its parts have fewer words of each kind, and are split again until nothing is rare
in its segment.  What survives is scanned lag by lag: a run with period q holds three blocks in a row that begin at a
multiple of q, two of which equal their successors, so only those places are tested, with rolling hashes (n log n tests
in all), and every hit is extended to a maximal stretch and verified on the words themselves.

Defined cases: null texts have no words, texts without a run are kept as they are with null figures; of runs with equal
length the first counts, then the one with the shorter period; equal rows give equal rows; texts are taken whole, in
slices of a batch that are bounded by bytes; an empty table gives an empty table; a row without an id has no remainder and
isn't rewritten; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

LEAST, REPEATS = 6, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)


def split_by_frequency(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive and their final segments.  ``words``: numbers; ``segment``: ascending, of equal length."""
    at = np.arange(len(words))
    while len(at):
        _, kind, count = np.unique(segment * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        often = count[kind] >= REPEATS
        # survivors that lie side by side in one segment stay together
        breaks = np.ones(len(at), bool)
        breaks[1:] = (np.diff(at) != 1) | (np.diff(segment) != 0) | ~often[:-1]
        number = np.cumsum(breaks) - 1
        long = np.bincount(number[often], minlength=number[-1] + 1) >= LEAST
        stay = often & long[number]
        if stay.all():
            return at, segment
        at, segment = at[stay], number[stay]
    return at, segment


def _hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes by a power series that wraps around, and its powers (a filter only: hits are verified)."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(x), _BASE)]))
        mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[:-1])]), powers


def _stretch(x: np.ndarray, q: int, at: int) -> tuple[int, int]:
    """The maximal stretch with period q around the two equal blocks at ``at``: compared in growing steps."""
    start, end, step = at, at + q, 64
    while start > 0:
        a = max(0, start - step)
        odd = np.nonzero(x[a:start] != x[a + q : start + q])[0]
        if len(odd):
            start = a + int(odd[-1]) + 1
            break
        start, step = a, 2 * step
    step = 64
    while end < len(x) - q:
        b = min(len(x) - q, end + step)
        odd = np.nonzero(x[end:b] != x[end + q : b + q])[0]
        if len(odd):
            end += int(odd[0])
            break
        end, step = b, 2 * step
    return start, end + q


def lag_scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of one segment."""
    n, runs, seen, longer = len(x), [], set(), []
    prefix, powers = _hashes(x)
    for q in range(1, n // REPEATS + 1):
        at = np.arange(0, n - 3 * q + 1, q)
        at = at[(x[at] == x[at + q]) & (x[at + q] == x[at + 2 * q])]
        if not len(at):
            continue
        with np.errstate(over="ignore"):
            at = at[(prefix[at + 2 * q] - prefix[at]) * powers[q] == prefix[at + 3 * q] - prefix[at + q]]
        longer = [r for r in longer if r[1] >= REPEATS * q]
        for start, length, period in longer:  # within a run of a divisor there is no other stretch
            if q % period == 0 and len(at):
                at = at[(at < start) | (at + 3 * q > start + length)]
        done = -1
        for a in at.tolist():
            if a + 2 * q <= done or not (x[a : a + q] == x[a + q : a + 2 * q]).all():
                continue
            start, done = _stretch(x, q, a)
            length = done - start
            if length >= max(LEAST, REPEATS * q) and (start, length) not in seen:
                seen.add((start, length))
                runs.append((start, length, q))
                longer.append((start, length, q))
    return sorted(runs)


def batch_runs(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some documents (arrays of word numbers), sorted by start and period."""
    sizes = np.array([len(d) for d in docs])
    words = np.concatenate(docs) if len(docs) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at, segment = split_by_frequency(words, np.repeat(np.arange(len(docs)), sizes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    edges = np.concatenate([[0], np.nonzero(np.diff(segment))[0] + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        doc = int(np.searchsorted(begin, at[a], "right")) - 1
        first = int(at[a])
        out[doc] += [(first - int(begin[doc]) + s, length, q) for s, length, q in lag_scan(words[first : int(at[b - 1]) + 1])]
    return [sorted(r, key=lambda v: (v[0], v[2])) for r in out]


def planted(n: int, hashed: int | None) -> np.ndarray:
    """The places of original words that stand in for the words 0..n-1: for one text of ten its tail repeats."""
    at = np.arange(n)
    if hashed is None or hashed % 10 or not n:
        return at
    g = hashed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return np.cumsum(gone)[:n] == 0


OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, runs_text string, collapsed binary"


def periodic_runs(docs: DataFrame, rewrite: bool = False, slice_bytes: int = 1 << 20) -> DataFrame:
    """OUT for every row of ``docs`` (doc_id, text): all runs, the longest one's figures, and the text with each run cut
    down to its first period (words joined by one space; UTF-8).  ``rewrite``: one text of ten is made periodic first."""
    fields = [f.split(" ", 1)[0] for f in OUT.split(", ")]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [*[pa.int64()] * 6, run_type, pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.slices(whole, "text", slice_bytes):
                ids, number, split, docs_at = batch.column("doc_id").to_pylist(), {}, [], []
                for i, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                    own = (text or "").encode().split()
                    if rewrite:
                        at = planted(len(own), None if i is None else zlib.crc32(str(i).encode()))
                        own = [own[k] for k in at.tolist()]
                    split.append(own)
                    docs_at.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
                rows = []
                for i, own, runs in zip(ids, split, batch_runs(docs_at), strict=True):
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                    kept = own
                    if runs:
                        kept = [own[k] for k in np.nonzero(collapse(len(own), runs))[0].tolist()]
                    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                    rows.append((i, len(own), len(runs), *best, [{"start": s, "length": length, "period": q} for s, length, q in runs], lines, b" ".join(kept)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, OUT)

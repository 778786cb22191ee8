"""Pairs of similar sets by tiles (M9): blocks of sets meet in tasks, where candidates are met by their rarest words and
counted in full; only pairs that hold are rows.  Candidates, which grow with the square of the table, are never shuffled,
and a pair doesn't carry its sets' words.

Within a task matches of words are taken many sets at a time.  Before words are compared, a match must hold with the most that two
sets can share by their sizes, by its places in both (from there on), and by 512 bits of each that their words set.

What is shuffled are the sets as numbers, once a block: bytes grow with the table times the number of blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .scan import numbered


class _Block:
    """Sets of one block by size: ``ids`` are their words, rarest first, from ``at[i]`` for set i; ``sig`` are their bits"""

    def __init__(self, rows: pd.DataFrame):
        lists = rows["words"].tolist()
        size = np.array([len(w) for w in lists], np.int64)
        order = np.argsort(size, kind="stable")
        self.rep, self.size = rows["rep"].to_numpy()[order], size[order]
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = np.concatenate([lists[k] for k in order]).astype(np.int64)
        self.of = np.repeat(np.arange(len(size)), self.size)
        bits = np.zeros((len(size), 512), bool)
        bits[self.of, (self.ids.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(23)] = True
        self.sig = np.packbits(bits, axis=1).view(np.uint64)

    def shown(self, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """set, place and word of the first ``upto`` words of each set"""
        place = np.arange(len(self.ids)) - self.at[self.of]
        first = place < upto[self.of]
        return self.of[first], place[first], self.ids[first]


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... (count[k] of them) for each k"""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _shared(x: _Block, y: _Block, a: np.ndarray, b: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """How many words x's set a[k] and y's set b[k] share"""
    width = max(x.ids.max(), y.ids.max()) + 1
    known, out = y.of * width + y.ids, [np.zeros(0, np.int64)]  # in order, as words of a set are
    cuts = np.searchsorted(np.cumsum(x.size[a]), np.arange(most, x.size[a].sum() + most, most))
    for k in np.split(np.arange(len(a)), np.unique(cuts)):
        if len(k):
            n = x.size[a[k]]
            asked = np.repeat(b[k], n) * width + x.ids[_spread(x.at[a[k]], n)]
            hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
            out.append(np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n))
    return np.concatenate(out)


def tiled_pairs(sets: DataFrame, keep: Callable, first: Callable, other: Callable | None = None, per_block: int = 40_000, least: int = 5_000, matches: int = 1_000_000) -> DataFrame:
    """Pairs a < b of ``sets`` (rep, words; each set once) with ``keep(common, smaller size, larger size)``, which must hold for more in
    common, or a smaller larger set, where it holds.  ``first(size)`` says how many (one at least) of the smaller set's rarest words must
    meet the larger one, which shows its ``other(size)`` rarest words, or all.  All three take numpy arrays.  Blocks have up to
    ``per_block`` sets; there are up to 8 of ``least`` or more, so that small tables keep several tasks busy.  ``matches`` of words are
    held at a time, more only for one set that has more.

    Defined cases: empty sets and null words link with nothing; an empty table gives no pairs."""
    words = sets.select("rep", F.explode(F.array_distinct("words")).alias("w")).where("w is not null")
    rare = save(numbered(words.groupBy("w").agg(F.count("*").alias("df")), "df", "w", name="n").select("w", "n"), "numbers")
    number = F.col("n").cast("int") if rare.count() < 1 << 31 else F.col("n")
    rows = save(words.join(rare, "w").groupBy("rep").agg(F.sort_array(F.collect_list(number)).alias("words")), "sets")  # the words of one set
    n = rows.count()
    blocks = max(1, -(-n // per_block), min(8, n // least))
    kind = sets.schema["rep"].dataType.simpleString()
    own = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    left = rows.withColumn("i", own).withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1))))
    right = rows.select(F.col("rep").alias("rep"), F.col("words").alias("words")).withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))

    def probe(x: _Block, y: _Block, same: bool, ties: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of x and y those pairs in which x's set is the smaller one, or as large if ``ties``"""
        width = len(y.size) + 1
        met, place_y, words = y.shown(y.size if other is None else other(y.size))
        key = words * width + met
        order = np.argsort(key, kind="stable")
        key, met, place_y = key[order], met[order], place_y[order]
        owner, place, words = x.shown(np.minimum(first(x.size), x.size))
        # y's sets are in the order of their sizes: from the first that is large enough to the last one of which x's can be enough
        low = np.arange(1, len(x.size) + 1) if same else np.searchsorted(y.size, x.size, "left" if ties else "right")
        sizes, at = np.unique(x.size, return_inverse=True)
        larger = np.unique(y.size)
        most = [larger[(larger >= n) & keep(np.full(len(larger), n), np.full(len(larger), n), np.maximum(larger, n))] for n in sizes]
        high = np.searchsorted(y.size, np.array([m[-1] if len(m) else -1 for m in most])[at], "right")
        begin, end = np.searchsorted(key, words * width + low[owner]), np.searchsorted(key, words * width + np.maximum(low, high)[owner])
        some = end > begin
        owner, place, begin, count = owner[some], place[some], begin[some], (end - begin)[some]
        total = np.cumsum(count)
        found, a = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        while a < len(owner):  # whole sets of x at a time
            b = max(np.searchsorted(total, total[a] - count[a] + matches, "right"), a + 1)
            b = np.searchsorted(owner, owner[b], "left") if b < len(owner) and owner[b] != owner[a] else np.searchsorted(owner, owner[b - 1], "right")
            to = _spread(begin[a:b], count[a:b])
            i, j = np.repeat(owner[a:b], count[a:b]), met[to]
            n, m = x.size[i], y.size[j]
            fits = np.nonzero(keep(np.minimum(n - np.repeat(place[a:b], count[a:b]), m - place_y[to]), n, m))[0]
            i, j, n, m = i[fits], j[fits], n[fits], m[fits]
            p, q = x.sig[i], y.sig[j]
            missing = [np.bitwise_count(one & ~two).sum(axis=1, dtype=np.int64) for one, two in ((p, q), (q, p))]
            fits = keep(np.minimum(n - missing[0], m - missing[1]), n, m)
            pair = np.unique(i[fits] * width + j[fits])
            i, j = pair // width, pair % width
            if len(pair):
                fits = keep(_shared(x, y, i, j), x.size[i], y.size[j])
                found.append((i[fits], j[fits]))
            a = b
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"x": left["rep"].iloc[:0], "y": right["rep"].iloc[:0]})
        same = left["i"].iloc[0] == left["j"].iloc[0]
        x = _Block(left)
        y = x if same else _Block(right)
        a, b = probe(x, y, same, True)
        if not same:
            d, c = probe(y, x, False, False)
            a, b = np.concatenate([a, c]), np.concatenate([b, d])
        return pd.DataFrame({"x": x.rep[a], "y": y.rep[b]})

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, f"x {kind}, y {kind}")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_pairs(sets: DataFrame, threshold: float, **how) -> DataFrame:
    """Pairs with a Jaccard over ``threshold``"""
    first = lambda size: np.floor((1 - threshold) * size + 1e-9).astype(np.int64) + 1
    return tiled_pairs(sets, lambda c, n, m: c / (n + m - c) > threshold, first, first, **how)


def overlapping_pairs(sets: DataFrame, threshold: float, **how) -> DataFrame:
    """Pairs that share over ``threshold`` of the smaller set"""
    first = lambda size: size - np.floor(size * threshold + 1e-9).astype(np.int64)
    return tiled_pairs(sets, lambda c, n, m: c / np.minimum(n, m) > threshold, first, **how)

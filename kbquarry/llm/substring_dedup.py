"""Removes word passages that occur elsewhere, by FM-indexes over shards of candidate passages.

1. Each text's anchors are the minimizers of its 8-word grams: every window of 35 words holds one, and equal windows hold
   the same one at the same place.  Only anchors whose hash occurs twice in the corpus can lie in a repeated window.
2. The passage of an anchor is all that windows around it can cover (62 words).  Equal passages are counted and go on as
   one with their number as weight, so copies cost no more than one of them.  Where an anchor has one passage only, that
   weight is the answer for all its windows.
3. Passages are dealt to shards by anchor.  A shard is indexed (FM-index over a wavelet matrix), its passages are
   streamed through backward search, and window starts whose string has a weight of two or more are reported.  The
   anchor's first word has a symbol of its own, so that overlapping passages of one text don't count each other.
4. Anchors with more than ``hot`` distinct passages don't meet in one task: their windows are counted by hash instead.
5. Masks go back to the texts by passage hash, and the words that a reported window covers are removed.

Defined cases: null texts and such without words keep nothing (n_words 0); texts shorter than a window lose nothing;
repeated rows repeat each other, so that their windows go; texts are taken whole; an empty table gives an empty table;
rows are known by id and text, so that rows without an id, or with another row's id, take part like all others; further
columns are kept only where keep names them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import HashCache, groups, save
from .fm_index import FMIndex, repeated_windows

GRAM = 8
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _PRIME
    return x ^ (x >> np.uint64(32))


class Passages:
    """Anchors of one text and hashes of the passages around them."""

    def __init__(self, words: list[bytes], cache: HashCache, window: int):
        self.window, n = window, len(words)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(n + 1, _PRIME, np.uint64))
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * self.powers[:n], dtype=np.uint64)])
            grams = h[: n - GRAM + 1].copy()
            for j in range(1, GRAM):
                grams = grams * _PRIME + h[j : n - GRAM + 1 + j]
        grams = _mixed(grams)
        width = window - GRAM + 1
        self.at = np.unique(np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n - window + 1))
        self.anchor = grams[self.at].view(np.int64)
        self.left = np.maximum(0, self.at - (window - GRAM))
        self.right = np.minimum(n, self.at + window)
        self.passage = self._span(self.left, self.right, self.at).view(np.int64)

    def _span(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of words[left:right] and of the anchor's place in it, wherever in the text they are."""
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
            back = np.cumprod(np.full(len(self.powers), inverse, np.uint64))
            value = (self.prefix[right] - self.prefix[left]) * back[left]
            return _mixed(_mixed(value + (right - left).astype(np.uint64)) + (at - left).astype(np.uint64))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """rid, rid2, at, anchor, passage of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for batch in bpe.slices(whole, "text"):
                parts = []
                rids = zip(batch.column("rid").to_pylist(), batch.column("rid2").to_pylist(), strict=True)
                for (rid, rid2), text in zip(rids, batch.column("text").to_pylist(), strict=True):
                    words = _words(text)
                    if len(words) >= window:
                        p = Passages(words, cache, window)
                        parts.append((np.full(len(p.at), rid, np.int64), np.full(len(p.at), rid2, np.int64), p.at.astype(np.int32), p.anchor, p.passage))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["rid", "rid2", "at", "anchor", "passage"])

    return docs.select("rid", "rid2", "text").mapInArrow(run, "rid long, rid2 long, at int, anchor long, passage long")


def _cut(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """anchor, passage, n, at (of the anchor in the passage), words: the wanted passages (rid, rid2, at, anchor, passage, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.slices(whole, "text"):
                out = []
                for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                    if own:
                        words = _words(text)
                        for p in own:
                            left = max(0, p["at"] - (window - GRAM))
                            out.append((p["anchor"], p["passage"], p["n"], p["at"] - left, b" ".join(words[left : p["at"] + window])))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "passage", "n", "at", "words"])

    by_doc = wanted.groupBy("rid", "rid2").agg(F.collect_list(F.struct("at", "anchor", "passage", "n")).alias("own"))  # of one text
    return keyed.join(by_doc, ["rid", "rid2"]).select("text", "own").mapInArrow(run, "anchor long, passage long, n long, at int, words binary")


def search_shard(rows: list[dict[str, np.ndarray]], window: int, cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    """passage and mask (bit d: the window that starts d words before the anchor repeats) of a shard's passages."""
    join = {k: np.concatenate([r[k] for r in rows]) for k in ("anchor", "passage", "n", "at", "words")}
    _, once = np.unique(join["passage"], return_index=True)
    anchor, passage, n, at, words = (join[k][once] for k in ("anchor", "passage", "n", "at", "words"))
    split = [w.split(b" ") for w in words.tolist()]
    size = np.array([len(w) for w in split])
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    hashes = np.fromiter(map(cache.__getitem__, chain.from_iterable(split)), np.uint64, int(size.sum()))
    del split, words  # a shard's words as objects are its largest part
    _, symbol = np.unique(hashes, return_inverse=True)
    text = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = symbol + 1
    _, kind = np.unique(anchor, return_inverse=True)
    text[begin + at] = int(symbol.max()) + 2 + kind
    weights = np.repeat(n, size + 1) * inside
    last = np.minimum(at, size - window).astype(np.int64)
    starts = repeated_windows(FMIndex(text, weights, window + 1), text, begin, last, window)
    mask = np.zeros(len(passage), np.int64)
    for s in range(window - GRAM + 1):
        back = at - s
        mask |= np.where((back >= 0) & ((starts >> s) & 1 == 1), np.int64(1) << np.maximum(back, 0).astype(np.int64), 0)
    return passage[mask != 0], mask[mask != 0]


def _searched(passages: DataFrame, window: int, per_index: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, count = HashCache(200_000), [], 0
        for g in groups(batches, "anchor"):
            if count and count + len(g["anchor"]) > per_index:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in search_shard(held, window, cache)], ["passage", "mask"])
                held, count = [], 0
            held.append(g)
            count += len(g["anchor"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in search_shard(held, window, cache)], ["passage", "mask"])

    return passages.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "passage long, mask long")


def _counted(passages: DataFrame, window: int) -> DataFrame:
    """The same masks for anchors with very many passages, by counting window hashes: map-side sums, no group in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            out = []
            for anchor, passage, n, at, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "passage", "n", "at", "words")), strict=True):
                own = words.split(b" ")
                p = Passages(own, cache, window)
                s = np.arange(0, min(at, len(own) - window) + 1)
                h = p._span(s, s + window, np.full(len(s), at)).view(np.int64)
                out += [(anchor, passage, n, int(at - i), int(v)) for i, v in zip(s, h, strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["anchor", "passage", "n", "back", "w"])

    rows = passages.dropDuplicates(["passage"]).mapInArrow(run, "anchor long, passage long, n long, back int, w long")
    often = rows.groupBy("anchor", "back", "w").agg(F.sum("n").alias("c")).where("c > 1").drop("c")
    return rows.join(often, ["anchor", "back", "w"], "left_semi").groupBy("passage").agg(F.bit_or(F.expr("shiftleft(1L, back)")).alias("mask"))


def _remove(keyed: DataFrame, masks: DataFrame, window: int, keep: list[str]) -> DataFrame:
    kept = [f for f in keyed.schema.fields if f.name in keep]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.slices(whole, "text"):
                texts, words_, removed = [], [], []
                for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                    words = _words(text)
                    n = len(words)
                    if own:
                        at = np.array([p["at"] for p in own], np.int64)
                        mask = np.array([p["mask"] for p in own], np.int64)
                        bits = (mask[:, None] >> np.arange(window - GRAM + 1)) & 1
                        starts = (at[:, None] - np.arange(window - GRAM + 1))[bits == 1]
                        starts = starts[(starts >= 0) & (starts + window <= n)]
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + window, -1)
                        stay = np.cumsum(cover[:n]) == 0
                        words = [words[i] for i in np.nonzero(stay)[0].tolist()]
                    texts.append(b" ".join(words).decode())
                    words_.append(n)
                    removed.append(n - len(words))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(words_, pa.int64()), pa.array(removed, pa.int64())], [*names, "kept_text", "n_words", "n_removed"])

    by_doc = masks.groupBy("rid", "rid2").agg(F.collect_set(F.struct("at", "mask")).alias("own"))  # of one text, however often it is repeated
    schema = T.StructType([*kept, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return keyed.join(by_doc, ["rid", "rid2"], "left").select(*dict.fromkeys([*names, "text"]), "own").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = 35, keep: tuple[str, ...] = (), hot: int = 20_000, per_index: int = 12_000) -> DataFrame:
    """doc_id, the columns ``keep``, kept_text, n_words, n_removed."""
    rid = [F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64(F.lit(1), "doc_id", "text").alias("rid2")]  # never null
    keyed = docs.select(*dict.fromkeys(["doc_id", *keep, "text"]), *rid)
    found = save(anchors(keyed, window), "anchors")
    twice = save(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "twice")  # a table: the join's sides can then be split where skewed
    found = save(found.join(twice, "anchor").select("rid", "rid2", "at", "anchor", "passage"), "repeated-anchors")
    passages = found.groupBy("passage").agg(F.min(F.struct("rid", "rid2", "at", "anchor")).alias("one"), F.count("*").alias("n"))
    passages = save(passages.select("passage", "one.*", "n"), "passages")
    kinds = save(passages.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor-kinds")
    passages = save(passages.join(kinds, "anchor"), "passages-by-kind")
    alone = passages.where("kinds = 1").select("passage", F.lit((1 << (window - GRAM + 1)) - 1).cast("long").alias("mask"))
    varied = passages.where("kinds > 1")
    cut = _cut(keyed, varied.select("rid", "rid2", "at", "anchor", "passage", "n"), window)
    crowded = kinds.where(F.col("kinds") > hot).select("anchor")
    if crowded.isEmpty():
        masks = _searched(cut, window, per_index)
    else:
        cut = save(cut, "passage-words")
        masks = _searched(cut.join(crowded, "anchor", "left_anti"), window, per_index).unionByName(_counted(cut.join(crowded, "anchor", "left_semi"), window))
    masks = save(masks.unionByName(alone), "masks")
    placed = found.select("rid", "rid2", "at", "passage").join(masks, "passage").select("rid", "rid2", "at", "mask")
    return _remove(keyed, placed, window, ["doc_id", *keep])

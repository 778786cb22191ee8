"""Byte-level BPE: encoding by ranked merges over the distinct words of a task, decoding by concatenating pieces.

The rank table is a vocabulary file whose path is a parameter; tasks read it themselves (65 k short lines at most).
Each distinct word is folded once per task: its byte array loses its lowest-ranked adjacent pair until none is left.

Defined cases: null text -> no ids; empty text -> no ids; repeated rows -> repeated results; an empty table -> an
empty table; further columns are kept unless their names clash with the two result columns, which replace them.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode defines it, without the ASCII separators 1C-1F.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places where a run of white space reaches over a single blank: such texts are not split at blanks.
_CROSS = re.compile(f"[{_WS}] (?:[{_WS}]|\\Z)")
_NO_RANK = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """piece -> rank, from a .tiktoken file or from the vocabulary of a .json file."""
    if path.endswith(".json"):
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special = {t["content"] for t in whole.get("added_tokens", ())}
        return {bytes(back[c] for c in k): v for k, v in whole["model"]["vocab"].items() if k not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def added_tokens(path: str) -> dict[str, int]:
    """Strings that a .json file gives ids of their own, wherever they stand in a text; a .tiktoken file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 40:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(parts[i] + parts[i + 1], _NO_RANK) for i in range(len(parts) - 1)]
    while pairs and (low := min(pairs)) < _NO_RANK:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NO_RANK)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NO_RANK)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap, for words of any length in n log n."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def rank_map(path: str, buckets: int = 4096) -> Column:
    """The ranks as a literal: an array of maps from pieces (in hexadecimal digits) to ranks, by a hash of the piece, since
    Spark looks keys of a map up one after another."""
    parts: list[list[str]] = [[] for _ in range(buckets)]
    for piece, rank in load_ranks(path).items():
        parts[zlib.crc32(piece.hex().encode()) % buckets].append(f"{piece.hex()}:{rank}")
    return F.array(*[F.str_to_map(F.lit(",".join(p)), F.lit(","), F.lit(":")) for p in parts])


def fold_table(words: DataFrame, path: str) -> DataFrame:
    """word, ids of a table of distinct ``words`` (word), by DataFrame functions alone: aggregate() over a word's byte array
    merges the adjacent pair of lowest rank, leftmost first, as often as the word has bytes.  Each merge looks all pairs up
    again, so this is for words of some tens of bytes."""
    ranks, none = rank_map(path), 1 << 30

    def rank(piece: Column) -> Column:
        place = F.pmod(F.crc32(piece), F.lit(4096)).cast("int")
        return F.coalesce(F.try_element_at(F.get(ranks, place), piece).cast("int"), F.lit(none))

    def merge(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, i: rank(F.concat(a, F.get(parts, i + 1))))
        # an array of one binds its element, so that the pairs are looked up once
        return F.get(F.transform(F.array(pairs), lambda r: F.when(F.coalesce(F.array_min(r), F.lit(none)) == none, parts).otherwise(_joined(parts, F.array_position(r, F.array_min(r)).cast("int")))), 0)

    digits = F.lower(F.hex(F.encode("word", "UTF-8")))
    parts = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.substring(digits, i, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), parts, merge)
    return words.where("word <> ''").select("word", F.transform(folded, rank).alias("ids"))


def _joined(parts: Column, at: Column) -> Column:
    """``parts`` with the elements at and at + 1 (from 1) as one"""
    both = F.concat(F.get(parts, at - 1), F.get(parts, at))
    return F.concat(F.slice(parts, F.lit(1), at - 1), F.array(both), F.slice(parts, at + 2, F.size(parts)))


class _Bounded(dict):
    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Whole texts to ids (as little-endian 32-bit bytes).  Texts are cut at single blanks, where no match of a GPT-style
    pattern can cross; each distinct chunk, and each distinct word in it, is encoded once while the caches last."""

    def __init__(self, pattern: str, encode_word, limit: int = 300_000, by_chunk: bool = False):
        found = regex.compile(pattern).findall
        self.word = _Bounded(encode_word, limit)
        pieces = self.word.__getitem__
        self.whole = encode_word if by_chunk else lambda text: b"".join(map(pieces, found(text)))
        self.head = _Bounded(self.whole, 100_000)
        self.rest = _Bounded(lambda chunk: self.whole(" " + chunk), limit)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _CROSS.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.head[head] + b"".join(map(self.rest.__getitem__, rest))


_LOADED: dict = {}


def merge_encoder(path: str, pattern: str) -> Encoder:
    """By this module's own fold; one per Python worker."""
    if (key := ("merge", path, pattern)) not in _LOADED:
        ranks = load_ranks(path)
        _LOADED[key] = Encoder(pattern, lambda w: np.array(fold_merges(w.encode(), ranks), "<i4").tobytes())
    return _LOADED[key]


def library_encoder(path: str, pattern: str) -> Callable[[str | None], bytes]:
    """The same ids by a compiled library, for those who need ids only; added tokens get their own."""
    if (key := ("library", path, pattern)) not in _LOADED:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        added = {t: np.array([i], "<i4").tobytes() for t, i in added_tokens(path).items()}
        parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        _LOADED[key] = own, added, parts
    own, added, parts = _LOADED[key]
    plain = Encoder(pattern, lambda w: np.array(own.encode_ordinary(w), "<i4").tobytes(), 150_000, by_chunk=True)  # its caches go with the task

    def encode(text: str | None) -> bytes:
        if parts and text and any(t in text for t in added):
            return b"".join(added.get(p) or plain(p) for p in parts(text))
        return plain(text)

    return encode


def _pieces(path: str) -> pa.Array:
    if (key := ("pieces", path)) not in _LOADED:
        ranks = load_ranks(path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        _LOADED[key] = pa.array(pieces, pa.binary())
    return _LOADED[key]


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in all, one row at least."""
    sums, start = np.cumsum(sizes), 0
    while start < len(sums):
        stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, one row at least: long texts don't pile up."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    for start, stop in _cuts(sizes, most):
        yield batch.slice(start, stop - start)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` without its text, plus ``ids`` (array<int>)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, ids)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = merge_encoder(path, pattern)
        for whole in batches:
            for batch in slices(whole, text):
                rows = [enc(t) for t in batch.column(text).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                values = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, ids])

    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.select(*names, text).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` plus ``out`` (binary): the pieces of its ids, concatenated.  Null ids give null."""
    kept = [f for f in coded.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for whole in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(whole.column(ids)), 0), dtype=np.int64)
            for start, stop in _cuts(sizes, 2 << 20):
                batch = whole.slice(start, stop - start)
                # the pieces of all ids lie one after another: a row is the stretch from its first to its last
                taken = pieces.take(batch.column(ids).flatten())
                ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4) if len(taken) else np.zeros(1, np.int32)
                at = ends[np.concatenate([[0], np.cumsum(sizes[start:stop])])]
                joined = pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(at), taken.buffers()[2] or pa.py_buffer(b"")])
                joined = pc.if_else(pc.is_valid(batch.column(ids)), joined, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), joined], [*names, out])

    return coded.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text after a round trip through encode() and decode()."""
    both = decode(encode(docs.select("doc_id", "text"), path, pattern), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

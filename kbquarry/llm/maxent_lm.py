"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

Words stand in nested classes of at most 16 members.  The root's members are the end of a text, the shapes of words outside
the vocabulary, and the domains (say languages) in which the words of the vocabulary mostly occur; a domain's words, by
frequency, are parted into 16 classes of equal mass, and each of these into 16 again (frequent words are alone by then).
log P(word | before) is the sum over the classes on the word's path of log P(member | class, before): a softmax over the
class's members with hashed features of the words before: the last word, the last two, the one before the last (skip) and
classes of the last four at the root, fewer below it.  Words that share the innermost class have their share of it; a word
outside the vocabulary has its smoothed share of its shape.

Counts cover all training tokens and stay distributed.  The vocabulary is the ``head`` most frequent words (a bounded list,
known to every task); other words of a text are joined with the counts.  The hashed table has a row for every 64 training
tokens, between 2^12 and 2^``most_bits``.  Training goes by rounds: each task makes gradient steps over its share of the
texts from the same start and gives what its steps changed, by row; changes are averaged by how often a task used the row.
Every training text is used in one round; tasks take about ``per_task`` tokens, so that changes stay small beside the texts.  Scoring takes batches of sparse feature rows in numpy.

Defined cases: null and empty texts are an end alone; without training texts all probabilities are those of the
smoothing alone; a null domain is a domain; repeated rows get equal scores; null ids are scored like all others; texts are
taken whole, in slices; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import save

FAN, SHAPES, DOMAINS = 16, 6, 6
#: How many features a class has, by its depth: bias, last word, last two, skip, two pairs of classes.
FEATURES = (6, 3, 2)
END = 0  # member of the root; shapes follow, then domains
STEP = 1 << 13
_PRIME, _NODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, A-Z folded, one after another, and how many each text has.  Arrow's ASCII white space is the
    six characters that part words here."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    full = np.asarray(pc.binary_length(flat)) > 0
    return flat.filter(pa.array(full)), np.bincount(doc[full], minlength=len(lists))


def shape(word: bytes) -> int:
    """1 .. SHAPES: plain letters by length, other bytes by which."""
    if word.isalpha():
        return 1 if len(word) < 9 else 2
    if word.isascii():
        return 3
    return 4 + zlib.crc32(bytes(sorted({b for b in word if b > 127}))) % 3


def shapes_of(words: pa.Array) -> np.ndarray:
    kinds = words.dictionary_encode()
    each = np.array([shape(w.encode()) for w in kinds.dictionary.to_pylist()] or [0], np.int64)
    return each[np.asarray(kinds.indices, dtype=np.int64)] if len(words) else np.zeros(0, np.int64)


@dataclass
class Vocabulary:
    """Words and their paths: entry k of word i, for k in start[i] .. start[i + 1], is (node, member)."""

    words: pa.Array
    base: np.ndarray  # log10 base probability
    start: np.ndarray
    node: np.ndarray
    member: np.ndarray
    barred: np.ndarray  # of a node: 0 where it has a member, else very low
    depth: np.ndarray  # of a node
    share: np.ndarray  # log10 of a word's share of its innermost class
    cls: np.ndarray  # the first two classes on a word's path, as a feature
    end_base: float
    unknown_end: bool
    bits: int


def paths(counts: np.ndarray, domain: np.ndarray) -> dict[str, np.ndarray]:
    """start, node, member, barred, depth, share for words with these counts (falling) and domains (0 .. DOMAINS - 1)."""
    own: list[list[tuple[int, int]]] = [[] for _ in counts]
    share = np.zeros(len(counts))
    kids, depth = [1 + SHAPES + DOMAINS], [0]
    for d in range(DOMAINS):
        at = np.nonzero(domain == d)[0]
        for i in at.tolist():
            own[i].append((0, 1 + SHAPES + d))
        todo = [(at, 1)] if len(at) else []
        while todo:
            at, deep = todo.pop()
            mass = np.cumsum(counts[at])
            if deep == len(FEATURES):
                share[at] = np.log10(counts[at] / mass[-1])
                continue
            cuts = np.unique([0, *np.searchsorted(mass, mass[-1] * np.arange(1, FAN) / FAN, "right"), len(at)]) if len(at) > FAN else np.arange(len(at) + 1)
            for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
                for i in at[a:b].tolist():
                    own[i].append((len(kids), k))
                if b - a > 1:
                    todo.append((at[a:b], deep + 1))
            kids.append(len(cuts) - 1), depth.append(deep)
    start = np.concatenate([[0], np.cumsum([len(p) for p in own])]).astype(np.int64)
    flat = np.array([x for p in own for x in p], np.int32).reshape(-1, 2)
    return {"start": start, "node": flat[:, 0], "member": flat[:, 1], "barred": np.where(np.arange(FAN) < np.array(kids)[:, None], 0, -1e30).astype(np.float32), "depth": np.array(depth, np.int8), "share": share}


class Batch:
    """Tokens of some texts, one end after each, hashes of their features, and the classes on their paths."""

    def __init__(self, v: Vocabulary, texts: pa.Array):
        words, count = split_words(texts)
        size = count + 1
        self.stop = np.cumsum(size)
        n = int(self.stop[-1]) if len(size) else 0
        self.doc = np.repeat(np.arange(len(size)), size)
        ends = self.stop - 1
        inner = np.ones(n, bool)
        inner[ends] = False
        found = np.asarray(pc.fill_null(pc.index_in(words, value_set=v.words), -1), dtype=np.int64)
        unknown = found < 0
        self.rare = words.filter(pa.array(unknown))  # outside the vocabulary, and their shapes
        self.rare_shape = shapes_of(self.rare)
        found[unknown] = -1 - self.rare_shape
        ids = np.full(n, -1, np.int64)
        ids[inner] = found
        self.ids, self.rare_doc = ids, self.doc[inner][unknown]
        head = ids >= 0
        cls = np.where(head, v.cls[np.where(head, ids, 0)] if len(v.cls) else 0, -ids)
        place = np.arange(n) - np.repeat(self.stop - size, size)

        def back(values: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            out[k:] = values[: max(n - k, 0)]
            out[place < k] = 0
            return out

        word, cls = (ids + 64).astype(np.uint64), (cls + 1).astype(np.uint64)
        w1, w2 = back(word, 1), back(word, 2)
        with np.errstate(over="ignore"):
            c = [back(cls, k) for k in (1, 2, 3, 4)]
            pairs = [np.zeros(n, np.uint64), w1, w2 * np.uint64(1_000_003) + w1, w2, c[1] * np.uint64(4099) + c[0], c[3] * np.uint64(4099) + c[2]]
            self.features = [(f * np.uint64(8) + np.uint64(k)) * _PRIME for k, f in enumerate(pairs)]
        # the path of each token: of words outside the vocabulary and of ends, the root alone
        length = np.ones(n, np.int64)
        at = ids[head]
        length[head] = v.start[at + 1] - v.start[at]
        self.first = np.concatenate([[0], np.cumsum(length)])
        self.token = np.repeat(np.arange(n), length)
        self.node, self.member = np.zeros(len(self.token), np.int64), np.zeros(len(self.token), np.int64)
        known = np.repeat(head, length)
        step = np.arange(len(self.token)) - np.repeat(self.first[:-1], length)
        entry = (np.repeat(np.where(head, v.start[np.where(head, ids, 0)], 0), length) + step)[known]
        self.node[known], self.member[known] = v.node[entry], v.member[entry]
        self.member[self.first[:-1][~head]] = -1 - ids[~head]

    def parts(self, v: Vocabulary, step: int = STEP) -> Iterator[tuple[np.ndarray, int]]:
        """Places on paths, depth by depth and in parts, and how many features they have."""
        depth = v.depth[self.node]
        for d, many in enumerate(FEATURES):
            where = np.nonzero(depth == d)[0]
            for a in range(0, len(where), step):
                yield where[a : a + step], many

    def rows(self, where: np.ndarray, many: int, bits: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            node = self.node[where].astype(np.uint64) * _NODE
            mixed = [(self.features[f][self.token[where]] ^ node) * _PRIME for f in range(many)]
        return [(m >> np.uint64(64 - bits)).astype(np.int32) for m in mixed]

    def log_members(self, weights: np.ndarray, v: Vocabulary, where: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        s = v.barred.take(self.node[where], axis=0)
        for r in rows:
            s += weights.take(r, axis=0)
        s -= s.max(axis=1)[:, None]
        s -= np.log(np.exp(s) @ np.ones(FAN, np.float32))[:, None]
        return s

    def log_words(self, weights: np.ndarray, v: Vocabulary) -> np.ndarray:
        """Natural log of each token's probability, but for the share within a shape."""
        each = np.zeros(len(self.token))
        for where, many in self.parts(v):
            s = self.log_members(weights, v, where, self.rows(where, many, v.bits))
            each[where] = s[np.arange(len(where)), self.member[where]]
        out = np.bincount(self.token, each, len(self.ids))
        head = self.ids >= 0
        out[head] += v.share[self.ids[head]] * np.log(10)
        return out


def train_batch(weights: np.ndarray, squares: np.ndarray, uses: np.ndarray, v: Vocabulary, batch: Batch, rate: float) -> None:
    """Gradient steps (AdaGrad with a sum of squares a row), one for each part and feature."""
    for where, many in batch.parts(v):
        rows = batch.rows(where, many, v.bits)
        g = np.exp(batch.log_members(weights, v, where, rows))
        g[np.arange(len(where)), batch.member[where]] -= 1
        for r in rows:
            both = np.sort(r.astype(np.int64) * STEP + np.arange(len(r)))  # faster than an argsort
            r, order = both // STEP, both % STEP
            first = np.nonzero(np.diff(r, prepend=-1))[0]
            total, at = np.add.reduceat(g.take(order, axis=0), first, axis=0), r[first]
            uses[at] += np.diff(first, append=len(r))
            so_far = squares[at] + np.einsum("ij,ij->i", total, total)
            squares[at] = so_far
            total *= (rate / np.sqrt(so_far))[:, None]
            weights[at] = weights.take(at, axis=0) - total


def train(rows: DataFrame, shared, weights: np.ndarray, rounds: int, rate: float, tasks: int) -> None:
    """``shared``: a broadcast Vocabulary.  ``weights`` are changed in place."""
    columns = [f"w{i}" for i in range(FAN)]
    schema = "bucket int, n long, " + ", ".join(f"{c} float" for c in columns)
    for turn in range(rounds):
        begin = rows.sparkSession.sparkContext.broadcast(weights)  # bounded by most_bits

        def run(batches: Iterator[pa.RecordBatch], begin=begin, turn=turn) -> Iterator[pa.RecordBatch]:
            v, own = shared.value, begin.value.copy()
            squares, uses = np.full(len(own), 1.0 + 4.0 * turn, np.float32), np.zeros(len(own), np.int64)
            for whole in batches:
                for batch in bpe.slices(whole, "text", 1 << 20):
                    train_batch(own, squares, uses, v, Batch(v, batch.column("text")), rate)
            at = np.nonzero(uses)[0]
            for a in range(0, len(at), 1 << 16):
                k = at[a : a + (1 << 16)]
                change = own[k] - begin.value[k]
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(uses[k]), *[pa.array(change[:, i]) for i in range(FAN)]], ["bucket", "n", *columns])

        local = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).select("text").coalesce(tasks).mapInArrow(run, schema)
        mean = local.groupBy("bucket").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("float").alias(c) for c in columns]).toArrow()
        at = mean.column("bucket").to_numpy()  # 2^most_bits rows at most
        for i, c in enumerate(columns):
            weights[at, i] += mean.column(c).to_numpy()
        begin.destroy()


def count_words(rows: DataFrame) -> DataFrame:
    """word, c, domain (the commonest), a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["word", "domain"]).aggregate([("c", "sum")]).rename_columns(["word", "domain", "c"]).combine_chunks()

        for whole in batches:
            for batch in bpe.slices(whole, "text"):
                words, count = split_words(batch.column("text"))
                domain = batch.column("domain").dictionary_encode()
                doc = pa.array(np.repeat(np.arange(batch.num_rows), count))
                t = pa.table({"word": words, "domain": domain.dictionary.take(domain.indices.take(doc)), "c": np.ones(len(words), np.int64)})
                held.append(t.group_by(["word", "domain"]).aggregate([("c", "sum")]).rename_columns(["word", "domain", "c"]))
                if sum(t.num_rows for t in held) > 600_000:
                    held = [merged()]
                    if held[0].num_rows > 400_000:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from merged().to_batches()

    counts = rows.select("text", "domain").mapInArrow(run, "word string, domain string, c long").groupBy("word", "domain").agg(F.sum("c").alias("c"))
    return save(counts.groupBy("word").agg(F.sum("c").alias("c"), F.max(F.struct("c", "domain"))["domain"].alias("domain")), "counts")


def vocabulary(counts: DataFrame, head: int, texts: int, tokens: int, kinds: int, most_bits: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and its words' counts."""
    floor = tokens + 0.5 * (kinds + 1)
    top = counts.orderBy(F.desc("c"), "word").limit(head).toArrow().combine_chunks()  # bounded by head
    c = top.column("c").to_numpy().astype(float)
    mass = top.group_by("domain").aggregate([("c", "sum")]).sort_by([("c_sum", "descending"), ("domain", "ascending")])
    number = {d: i for i, d in enumerate(mass.column("domain").to_pylist()[: DOMAINS - 1])}
    domain = np.array([number.get(d, DOMAINS - 1) for d in top.column("domain").to_pylist()], np.int64)
    p = paths(c, domain)
    cls = 16 + FAN * domain + p["member"][p["start"][:-1] + 1] if len(c) else np.zeros(0, np.int64)  # the second class on each path
    bits = int(min(most_bits, max(12, np.ceil(np.log2(max(1, tokens / 64))))))
    words = top.column("word").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) and words.num_chunks else words
    return Vocabulary(pa.array(words.to_pylist(), pa.string()), np.log10((c + 0.5) / floor), cls=cls, end_base=float(np.log10((texts + 0.5) / floor)), unknown_end=texts == 0, bits=bits, **p), c


def score_texts(docs: DataFrame, domain: str | None = None, head: int = 200_000, rounds: int = 2, rate: float = 0.5, most_bits: int = 18, per_task: int = 4_000_000) -> DataFrame:
    """``docs``: doc_id, text, train (boolean) and maybe a domain column -> doc_id, train, n_tokens, n_known,
    train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"), (F.coalesce(F.col(domain), F.lit("")) if domain else F.lit("")).alias("domain"))
    training = rows.where("train")
    counts = count_words(training)
    texts = training.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, kinds = sums[0] + texts, sums[1] + (texts > 0)
    floor = n + 0.5 * (kinds + 1)
    v, c = vocabulary(counts, head, texts, n, kinds, most_bits)
    shared, weights = spark.sparkContext.broadcast(v), np.zeros((1 << v.bits, FAN), np.float32)
    if texts:
        train(training, shared, weights, rounds, rate, max(spark.sparkContext.defaultParallelism, n // rounds // per_task))
    learnt = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, serial = shared.value, TaskContext.get().partitionId() << 36
        for whole in batches:
            for part in bpe.slices(whole, "text", 1 << 20):
                b, k = Batch(m, part.column("text")), part.num_rows
                score, base = b.log_words(learnt.value, m) / np.log(10), np.zeros(len(b.ids))
                known = b.ids >= 0
                if known.any():
                    base[known] = m.base[b.ids[known]]
                base[b.stop - 1], known[b.stop - 1] = m.end_base, not m.unknown_end
                sums = [np.bincount(b.doc, x, k) for x in (known, base, score)]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(b.rare_doc, minlength=k))]).astype(np.int32)
                tails = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([b.rare, pa.array(b.rare_shape.astype(np.int32))], ["word", "shape"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("train"), pa.array(serial + np.arange(k)), pa.array(np.diff(b.stop, prepend=0)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), tails],
                    ["doc_id", "train", "row", "n_tokens", "n_known", "base_score", "score", "tails"],
                )
                serial += k

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = save(rows.select("doc_id", "train", "text").mapInArrow(run, f"doc_id {kind}, train boolean, row long, n_tokens long, n_known long, base_score double, score double, tails array<struct<word: string, shape: int>>"), "scored")
    # words outside the vocabulary: shares of their shape, from the exact counts
    tail = scored.select("row", F.explode("tails").alias("t")).select("row", "t.word", "t.shape")
    rest = counts if not len(c) else counts.where((F.col("c") < float(c[-1])) | ((F.col("c") == float(c[-1])) & (F.col("word") > v.words[-1].as_py())))
    found = rest.mapInArrow(_shape_sums, "shape int, c long, v long").groupBy("shape").agg(F.sum("c"), F.sum("v")).collect()  # SHAPES rows
    bottom = F.lit(0.5 * 1)
    for s, mass_s, kinds_s in found:
        bottom = F.when(F.col("shape") == s, float(mass_s) + 0.5 * (kinds_s + 1)).otherwise(bottom)
    count = F.coalesce(F.col("c"), F.lit(0))
    per_row = tail.join(counts.select("word", "c"), "word", "left").groupBy("row").agg(
        F.sum(F.log10((count + 0.5) / floor)).alias("tail_base"), F.sum(F.log10((count + 0.5) / bottom)).alias("tail_score"), F.count_if(count > 0).alias("tail_known")
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return scored.drop("tails").join(per_row, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + zero("tail_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("tail_base")).alias("base_score"), (F.col("score") + zero("tail_score")).alias("score"),
    )


def _shape_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mass, kinds = Counter(), Counter()
    for batch in batches:
        for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
            s = shape(w.encode())
            mass[s] += c
            kinds[s] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(mass), pa.int32()), pa.array(list(mass.values()), pa.int64()), pa.array([kinds[s] for s in mass], pa.int64())], ["shape", "c", "v"])

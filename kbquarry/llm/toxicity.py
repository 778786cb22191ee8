"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Folding: A-Z and other letters are lower-cased, look-alike letters of other alphabets and digits or signs inside words
are replaced by the letters they stand for.  The lexicon is learned from labelled documents: whole words and word
beginnings (stems) whose log odds between toxic and other documents are high; its size and the number of labelled rows
used are bounded parameters.  A match must begin a word (and end one, for whole words) and must not lie in an exception
phrase.  The weights of the matches, in total and by length, go through a logistic link fitted on the same rows.

Defined cases: null and empty texts have no match and get the link's base score; texts are scanned whole; repeated rows
get equal scores; rows without an id are scored like all others; labels of one id count once, with its smallest text; with no
labels, or none toxic, the lexicon is empty and every score is the base rate; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices

#: Look-alikes and the letters they stand for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Digits and signs used for letters, inside words only.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon word is harmless; a parameter.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum line", "pond scum")

_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)})
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<![^\W_])[013457@$]+(?=[^\W\d_]{2})")
_WORDS = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    low = (text or "").lower().translate(_FOLD)
    return _INSIDE.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), low)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # stems end in "*"
    exceptions: tuple[str, ...] = EXCEPTIONS
    link: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        terms: dict[str, tuple[float, float, bool]] = {}
        for term, w in self.weights.items():
            stem, (whole, prefix, _) = term.rstrip("*"), terms.get(term.rstrip("*"), (0.0, 0.0, False))
            terms[stem] = (whole, w, False) if term.endswith("*") else (w, prefix, False)
        for phrase in self.exceptions:
            terms[fold(phrase)] = (*terms.get(fold(phrase), (0.0, 0.0))[:2], True)
        a = ahocorasick.Automaton()
        for term, value in terms.items():
            a.add_word(term, (len(term), *value))
        if terms:
            a.make_automaton()
        return a if terms else None

    def features(self, automaton: ahocorasick.Automaton | None, text: str | None) -> tuple[float, float, int]:
        """Logs of the matches' total weight and of the same per hundred words, and the number of matches."""
        low = fold(text)
        hits, spans = [], []
        for end, (n, whole, prefix, exception) in automaton.iter(low) if automaton else ():
            start = end - n + 1
            if start and low[start - 1].isalpha():
                continue
            closed = end + 1 == len(low) or not low[end + 1].isalpha()
            if exception and closed:
                spans.append((start, end))
            if w := max(prefix, whole if closed else 0.0):
                hits.append((start, w))
        if spans:
            hits = [h for h in hits if not any(a <= h[0] <= b for a, b in spans)]
        total = sum(dict(sorted(hits)).values())  # the strongest or last match of a word counts once
        words = low.count(" ") + low.count("\n") + 1
        return math.log1p(total), math.log1p(100 * total / (words + 10)), len(hits)

    def score(self, x: tuple[float, float, int]) -> float:
        a, b, c = self.link
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * x[0] + c * x[1]))))


def terms_of(text: str | None, longest: int = 7) -> set[str]:
    words = set(_WORDS.findall(fold(text)))
    stems = {w[:k] + "*" for w in words for k in range(4, min(longest, len(w)) + 1)}
    return {w for w in words if 3 <= len(w) <= 40} | stems


def sample_labels(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, y of at most about ``most`` labelled rows, the same on every run."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6] + [0.05] * (len(w) - 1))
        w -= np.linalg.solve(h, z.T @ (p - y) + np.r_[0, 0.05 * w[1:]])
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 30_000, most_terms: int = 2_000, least_docs: int = 4, purity: float = 0.8) -> Lexicon:
    """``labels``: doc_id, toxic (0/1).  What reaches the driver: ``most_terms`` terms and two figures of ``most_rows`` rows."""
    chosen = F.broadcast(sample_labels(labels, most_rows))  # its size is bounded by most_rows
    known = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # an id counts once

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, y in zip(b["text"], b["y"], strict=True):
                seen[int(y)].update(terms_of(text))
            for y, c in seen.items():
                if c:
                    yield pd.DataFrame({"term": list(c), "n0": np.array(list(c.values())) * (1 - y), "n1": np.array(list(c.values())) * y})

    totals = chosen.groupBy("y").count().collect()
    t = {r["y"]: r["count"] for r in totals}
    t0, t1 = t.get(0, 0), t.get(1, 0)
    lexicon = Lexicon()
    if not t1 or not t0:
        rate = (t1 + 0.5) / (t0 + t1 + 1)
        lexicon.link = (math.log(rate / (1 - rate)), 0.0, 0.0)
        return lexicon
    n0, n1 = F.col("n0"), F.col("n1")
    counts = known.mapInPandas(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    weight = F.log((n1 + 0.5) / (t1 + 1)) - F.log((n0 + 0.5) / (t0 + 1))
    best = counts.where((n1 >= least_docs) & (n1 >= purity * (n0 + n1))).select("term", "n1", weight.alias("w")).where(F.col("w") >= math.log(8))
    rows = best.orderBy(F.desc(F.col("n1") * F.col("w")), "term").limit(most_terms).collect()
    words = {r["term"]: (r["w"], r["n1"]) for r in rows}
    for term, (w, n) in words.items():  # a stem that is as telling as a longer term replaces it
        stem = term.rstrip("*")
        shorter = [stem[:k] + "*" for k in range(4, len(stem) + (not term.endswith("*")))]
        if not any(s in words and words[s][0] >= w - 0.7 and (words[s][1] > n or term.endswith("*") or s.rstrip("*") != stem) for s in shorter):
            lexicon.weights[term] = round(w, 6)

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = shared.value.automaton()
        for b in batches:
            x = [shared.value.features(a, text) for text in b["text"]]
            yield pd.DataFrame({"a": [v[0] for v in x], "b": [v[1] for v in x], "y": b["y"].astype("int32")})

    f = known.mapInPandas(figures, "a double, b double, y int").toPandas()
    lexicon.link = _logistic(f[["a", "b"]].to_numpy(), f["y"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, score (0 to 1) and n_matches, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by most_terms
    kept = [f for f in docs.select(*keep).schema.fields if f.name not in ("score", "n_matches")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value.automaton()
        for whole in batches:
            for b in slices(whole, "text"):
                x = [shared.value.features(a, text) for text in b.column("text").to_pylist()]
                found = [pa.array([shared.value.score(v) for v in x], pa.float64()), pa.array([v[2] for v in x], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *found], [*names, "score", "n_matches"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("n_matches", T.LongType())])
    return docs.select(*names, *([] if "text" in names else ["text"])).mapInArrow(run, schema)

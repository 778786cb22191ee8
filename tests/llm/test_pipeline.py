"""Stages of the pipeline against brute force, each on the rows that its predecessor kept."""

import collections
import random

import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers

import corpus_pipeline
from tests.llm.test_llm import components, repeats, words

EXTRA = "n_removed int, kept_text string, score double, r1 long, bad int, doc string"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(8)
    foot, rows = [f"shared footer line {k} of all sites" for k in range(3)], []
    for i in range(150):
        text = " ".join(words(rng.randrange(20, 120), i))
        if i % 3 == 0:
            text += "\n" + "\n".join(foot)
        if i % 5 == 0:
            text = text.replace(text.split()[4], "scumbag") + " scumbag grumph"
        rows.append((i, text, "en", f"s{i % 14}"))
    passage = " ".join(words(70, 900))
    rows += [(200 + i, " ".join(words(60, 300 + i)) + " " + passage + " " + " ".join(words(60, 400 + i)), "en", f"s{i}") for i in range(6)]
    rows += [(300 + i, " ".join([*words(90, 500), f"tail{i}"]), "de", f"s{i}") for i in range(8)]
    rows += [(400, None, "en", "s1"), (401, "", "en", None), (402, "one two", None, "s2"), (402, "other words", None, "s2"), (None, "without an id " + " ".join(words(50, 600)), "en", "s3"), (403, "<|endoftext|> long " * 4000, "en", "s4")]
    rows += [rows[7], rows[-2]]
    at = tmp_path_factory.mktemp("corpus")
    cols = list(zip(*rows, strict=True))
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": cols[1], "lang": cols[2], "source": cols[3], "n_chars": [len(t or "") for t in cols[1]]}), at / "documents.parquet")
    ids = [r[0] for r in rows[:150]]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": [1] * 150, "toxic": [int(i % 5 == 0) for i in ids]}), at / "labels.parquet")
    return str(at)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_equal_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").selectExpr("*", *[f"cast(1 as {c.split()[1]}) as {c.split()[0]}" for c in EXTRA.split(", ")])
    docs = corpus_pipeline.save(docs, "wide")
    stage = dict(corpus_pipeline.STAGES)
    rows = pairs(docs)

    clean = corpus_pipeline.save(stage["toxicity"](spark, docs, corpus), "t")
    assert clean.columns == docs.columns
    toxic = {i for i in range(150) if i % 5 == 0}
    assert pairs(clean) == [(i, t) for i, t in rows if i not in toxic]

    lined = corpus_pipeline.save(stage["line_dedup"](spark, clean, corpus), "l")
    cut = [(i, "\n".join(x for x in t.split("\n") if not x.startswith("shared footer")) if t else t) for i, t in pairs(clean)]
    assert lined.columns == docs.columns and pairs(lined) == sorted(cut, key=str)
    assert lined.where("n_chars <> length(text)").count() == 0

    near = corpus_pipeline.save(stage["near_duplicates"](spark, lined, corpus), "n")
    cls, sets = components([t for _, t in cut])
    least = {}
    for (i, _), c in zip(cut, cls, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    stay = [(i, t) for (i, t), c, s in zip(cut, cls, sets, strict=True) if not s or least.get(c) in (i, None)]
    assert near.columns == docs.columns and pairs(near) == sorted(stay, key=str) and len(stay) < len(cut)

    bare = corpus_pipeline.save(stage["substring_dedup"](spark, near, corpus), "s")
    keys = [(k, t) for k, (_, t) in enumerate(stay)]
    left = repeats(keys)
    want = [(i, left[k] if len((t or "").split()) > len(left[k].split()) else t) for k, (i, t) in enumerate(stay)]
    assert bare.columns == docs.columns and pairs(bare) == sorted(want, key=str)

    check_packing(stage["packing"](spark, bare, corpus), want)


def check_packing(packed, texts):
    """Pieces, ids and places of all texts, by the tokenizer's own library."""
    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in texts:
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [len(ids)] if len(ids) <= 2048 else list(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048))
        at = 0
        for k, stop in enumerate(cuts):
            want[i, k, at, stop - at, zlib_crc(ids[at:stop])] += 1
            at = stop
    rows = packed.collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


def zlib_crc(ids):
    import zlib

    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_ids_added_tokens_and_wide_ids(spark):
    from kbquarry.llm import packing

    rows = [((1 << 53) + 1, "a <|endoftext|> b<|endoftext|>"), (None, "no id"), (None, "no id"), (3, None), (4, ""), (5, "x y　z  \n" * 3000), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pid int")
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN)
    check_packing(got, rows)
    used, bound = packing.certify(got)
    assert bound <= used <= bound + 1
    assert packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_run_and_empty_tables(spark, corpus, tmp_path):
    check = corpus_pipeline.run(spark, corpus)
    assert check.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and check.count() > 100
    for name in ("documents", "labels"):
        t = pq.read_table(f"{corpus}/{name}.parquet")
        pq.write_table(t.slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Which of many given strings occur in which of many texts.

A dictionary whose bytes are checked to be under a limit goes to every task, as one automaton that reads a text once.  A
larger one is routed: each string waits under its rarest gram (by the dictionary itself), a text's distinct grams meet
these by a join, and each text is then searched for its own candidates only, in parts of a bounded number, so that it
travels once a part and not once a hit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .scan import numbered
from .tiled_scores import asked_terms, tiled_top_k
from .windows import top_k

GRAM = 4
FOUND = "doc_id {id}, pattern string"


def _grams(text: str, lengths: list[int]) -> set[str]:
    return {text[i : i + n] for n in lengths for i in range(len(text) - n + 1)}


def find_strings(texts: DataFrame, patterns: DataFrame, limit_bytes: int = 32 << 20, per_part: int = 5_000, per_task: int = 5_000) -> DataFrame:
    """``texts`` (doc_id, text) x ``patterns`` (pattern) -> doc_id, pattern: the strings that occur in a text, each once; as they
    are, case included.  What one automaton finds is dealt by doc_id, ``per_task`` texts a task, before it is made distinct.

    Defined cases: null and empty strings and null texts find nothing; repeated rows count once; rows that share a doc_id are
    one document; an empty side gives an empty table."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "text").where("text <> ''")
    if rows.isEmpty():  # before the strings are read
        return rows.select("doc_id", F.col("text").alias("pattern"))
    known = save(patterns.select("pattern").where("pattern <> ''").distinct(), "patterns")
    size = known.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0]
    if size <= limit_bytes:
        return _by_automaton(rows, sorted(r[0] for r in known.collect()), kind, per_task)  # ``limit_bytes`` at most
    return _by_grams(rows, known, kind, per_part)


def _by_automaton(rows: DataFrame, known: list[str], kind: str, per_task: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            if machine is None and batch.num_rows:  # a task without texts builds none
                machine = ahocorasick.Automaton()
                for p in known:
                    machine.add_word(p, p)
                machine.make_automaton()
            ids, found = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {p for _, p in machine.iter(text)}
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(found, pa.string())], ["doc_id", "pattern"])

    if not known:
        return rows.limit(0).select("doc_id", F.col("text").alias("pattern"))
    return rows.mapInArrow(run, FOUND.format(id=kind)).repartition(max(1, -(-rows.count() // per_task)), "doc_id").distinct()


def _by_grams(rows: DataFrame, known: DataFrame, kind: str, per_part: int) -> DataFrame:
    at = F.when(F.length("pattern") < GRAM, F.array("pattern")).otherwise(F.transform(F.sequence(F.lit(1), F.length("pattern") - GRAM + 1), lambda i: F.substring(F.col("pattern"), i, F.lit(GRAM))))
    grams = known.select("pattern", F.explode(F.array_distinct(at)).alias("gram"))
    often = save(grams.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    routes = grams.join(often, "gram").groupBy("pattern").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    routes = save(routes, "routes")
    lengths = sorted(r[0] for r in routes.select(F.length("gram")).distinct().collect())  # four numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text").to_pylist(), strict=True):
                own = list(_grams(text, lengths))
                yield pa.RecordBatch.from_arrays([pa.repeat(i, len(own)), pa.array(own, pa.string())], ["doc_id", "gram"])

    waiting = rows.mapInArrow(run, f"doc_id {kind}, gram string").join(routes, "gram").select("doc_id", "pattern").distinct()
    waiting = save(waiting, "candidates")
    parts = waiting.groupBy("doc_id").agg(F.ceil(F.count("*") / per_part).alias("parts"))
    dealt = waiting.join(parts, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("pattern"), F.col("parts")).alias("part")).agg(F.collect_list("pattern").alias("maybe"))
    met = dealt.join(rows, "doc_id").select("doc_id", F.filter("maybe", lambda p: F.contains(F.col("text"), p)).alias("found"))
    return met.select("doc_id", F.explode("found").alias("pattern")).distinct()


def _link(body: str, names: list[str]) -> str:
    """The first whole-word place of each name, longest first where they overlap, outside headings and lines with links."""
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n)))) + r")\b")
    done: set[str] = set()

    def link(m: re.Match) -> str:
        if m[1] in done:
            return m[0]
        done.add(m[1])
        return f"[[{m[1]}]]"

    return "\n".join(line if line.startswith("#") or "[[" in line else pattern.sub(link, line) for line in body.split("\n"))


def _linked(body: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([b if n is None or not len(n) else _link(b, list(n)) for b, n in zip(body, names, strict=True)], dtype=object)


def link_all(bodies: DataFrame, names: DataFrame, least: int = 4, **how) -> DataFrame:
    """``bodies`` (doc_id, text) and ``names`` (name) -> doc_id, text with [[name]] at the first whole-word place of each
    name of ``least`` characters or more, longest first, outside headings and lines that have a link.  Links don't nest.  A
    body is searched for the names that occur in it, not for all.

    Defined cases: null bodies stay null, bodies without a name as they are; rows are told apart by doc_id, which must be
    theirs alone; names are taken as they are, case included."""
    found = find_strings(bodies, names.where(F.length("name") >= least).select(F.col("name").alias("pattern")), **how)
    own = found.groupBy("doc_id").agg(F.array_sort(F.collect_list("pattern")).alias("names"))  # what occurs in one body
    linked = F.pandas_udf(_linked, "string")
    return bodies.select("doc_id", "text").join(own, "doc_id", "left").select("doc_id", F.when(F.col("text").isNotNull() & F.col("names").isNotNull(), linked(F.coalesce("text", F.lit("")), F.col("names"))).otherwise(F.col("text")).alias("text"))


def relevant_entities(documents: DataFrame, entities: DataFrame, k: int = 10, **how) -> DataFrame:
    """``documents`` (doc_id, text) and ``entities`` (entity_id, id, name) -> doc_id, entity_id, score, rank: 3 where the
    lower-case name occurs in the lower-case text, 2 where the id does, and 1 for each word of the name of four characters or
    more that does (a word that the name repeats counts as often); the ``k`` best, equal ones by entity_id.  Entities
    without a name take no part; texts without a doc_id are one document.  What a text holds meets the entities in tiles."""
    named = entities.where("name <> ''").select("entity_id", F.lower("name").alias("name"), F.lower("id").alias("id"))
    piece = lambda c, v: F.struct(c.alias("term"), F.lit(v).alias("v"))
    words = F.transform(F.filter(F.split("name", r"\s+"), lambda w: F.length(w) >= 4), lambda w: piece(w, 1))
    rows = named.select("entity_id", F.explode(F.concat(F.array(piece(F.col("name"), 3), piece(F.col("id"), 2)), words)).alias("p")).select("entity_id", "p.*")
    weights = save(rows.where("term <> ''").groupBy("term", "entity_id").agg(F.sum("v").alias("weight")), "weights")
    texts, patterns = documents.select("doc_id", F.lower("text").alias("text")), weights.select(F.col("term").alias("pattern"))
    held = lambda rows: find_strings(rows, patterns, **how).withColumnRenamed("pattern", "term")
    asked = held(texts.where("doc_id is not null")).select(F.col("doc_id").alias("qid"), "term", F.lit(1).alias("factor"))
    best = tiled_top_k(weights, asked, k, terms=asked_terms(weights)).withColumnRenamed("qid", "doc_id")
    unnamed = held(texts.where("doc_id is null")).join(weights, "term").groupBy("doc_id", "entity_id").agg(F.sum("weight").cast("double").alias("score"))
    unnamed = top_k(unnamed, ["doc_id"], [F.desc("score"), F.col("entity_id")], k)
    return best.unionByName(unnamed).select("doc_id", "entity_id", "score", "rank")


def vault(entities: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """Path, text.  A file for each entity (entity_id, entity_type, name, layer, description, body): front matter,
    relationships as [[links]] by name (the id where there is none), in the order of type and target, and the body without
    the heading that repeats the name, other entities' names linked; and the map of content, in the order of layers
    and entries, as one row for every entry under ``index/<layer>/<n>`` pages of a bounded number of lines.

    A hub's links are one line of its page, as the format asks; they are names only."""
    names = entities.select("entity_id", F.coalesce("name", "entity_id").alias("name"))
    to = edges.join(names.select(F.col("entity_id").alias("target_id"), F.col("name").alias("shown")), "target_id", "left")
    link = F.concat(F.lit("[["), F.coalesce("shown", "target_id"), F.lit("]]"))
    sections = to.select("source_id", "rel_type", "target_id", link.alias("link")).repartition("source_id")  # for both groupings and the join
    sections = sections.groupBy("source_id", "rel_type").agg(F.array_sort(F.collect_list(F.struct("target_id", "link"))).alias("links"))
    label = F.concat(F.lit("**"), F.initcap(F.replace(F.col("rel_type"), F.lit("_"), F.lit(" "))), F.lit(":** "), F.array_join(F.transform("links", lambda x: x["link"]), ", "))
    sections = sections.groupBy(F.col("source_id").alias("entity_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel_type", label.alias("line")))), lambda x: x["line"]), "\n").alias("relationships"))
    first = F.split("body", "\n", 2)
    title = F.trim(F.regexp_replace(F.trim(first[0]), r"^[# ]+|[# ]+$", ""))
    bare = F.when(title == F.col("shown"), F.coalesce(F.get(first, F.lit(1)), F.lit(""))).otherwise(F.col("body"))
    shown = entities.withColumns({"shown": F.coalesce("name", "entity_id"), "body": F.ltrim(F.coalesce("body", F.lit("")), F.lit("\n"))}).withColumn("bare", bare)
    bodies = save(shown.where("bare <> ''").select(F.col("entity_id").alias("doc_id"), F.col("bare").alias("text")), "bodies")
    linked = link_all(bodies, names.select("name"), **how).select(F.col("doc_id").alias("entity_id"), F.btrim("text", F.lit(" \t\n\r\x0b\x0c")).alias("linked"))
    pages = shown.drop("bare", "body").join(linked, "entity_id", "left").join(sections, "entity_id", "left")
    front = F.concat(F.lit("---\ntype: "), "entity_type", F.lit("\nid: "), "entity_id", F.lit("\nname: "), "shown", F.lit("\naliases:\n- "), "entity_id", F.lit("\n- "), "shown", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\ndescription: "), "description")).otherwise(""), F.lit("\n---\n\n# "), "shown", F.lit("\n"))
    told = F.when(F.col("relationships").isNotNull(), F.concat(F.lit("\n## Relationships\n\n"), "relationships", F.lit("\n"))).otherwise("")
    body = F.when(F.col("linked") != "", F.concat(F.lit("\n"), "linked", F.lit("\n"))).otherwise("")
    files = pages.select(F.concat("entity_type", F.lit("/"), "entity_id", F.lit(".md")).alias("path"), F.concat(front, told, body).alias("text"))
    entry = F.concat(F.lit("- [["), F.coalesce("name", "entity_id"), F.lit("]] ("), "entity_type", F.lit(")"))
    listed = numbered(entities.select("layer", entry.alias("entry"), "entity_id"), "layer", "entry", "entity_id")
    start = save(listed.groupBy("layer").agg(F.min("place").alias("start")), "layers")
    index = listed.join(F.broadcast(start), "layer").withColumn("page", F.floor((F.col("place") - F.col("start")) / 1000)).groupBy("layer", "page")
    index = index.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), "\n").alias("lines"))
    index = index.select(F.concat(F.lit("index/"), "layer", F.lit("/"), F.col("page").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("## "), F.initcap("layer"), F.lit("\n\n"), "lines", F.lit("\n")).alias("text"))
    return files.unionByName(index)

"""Entity resolution and merge (M rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..components import connected_components
from ..functions import text as X
from ..ontology import NAME_STOPS
from ..scratch import save
from .mention_state import entities_of, fold_facts, mention_facts
from .tiled_sets import overlapping_pairs, similar_pairs

# Fixed value: what a variant of a name ends in.
SUFFIX = r"\s+(deployment|v\d+|process|processing|monitoring|migration)$"


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """(entity_type, entity_id, pos, name, status, description, confidence, source, tags, relationships
    map<string, array<string>>, body, details) -> one row an entity.  The last name, status and tags, the first non-empty
    description, the greatest confidence, sources and targets of each relationship in first-seen order, the first body with
    the details of each later mention below it."""
    return entities_of(fold_facts(mention_facts(mentions)))


def conflicts(mentions: DataFrame) -> DataFrame:
    """M2: later descriptions that share fewer than three words with the kept one"""
    told = mentions.where("description <> ''")
    kept = told.groupBy("entity_type", "entity_id").agg(F.min(F.struct("pos", "description"))["description"].alias("kept"))
    split = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    rows = told.join(kept, ["entity_type", "entity_id"]).where(F.col("description") != F.col("kept"))
    return rows.where(F.size(F.array_intersect(split(F.col("description")), split(F.col("kept")))) < 3)


def set_members(rows: DataFrame, block: list[str]) -> DataFrame:
    """id, rep: of ``rows`` (id, words, block columns) with equal non-empty sets the smallest id stands for all."""
    rows = rows.withColumn("words", F.array_sort("words")).where(F.size("words") > 0)
    reps = rows.groupBy(*block, "words").agg(F.min("id").alias("rep"))
    a, b = rows.alias("a"), reps.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*block, "words")]
    return a.join(b, same).select("id", "rep", *[F.col(f"a.{c}").alias(c) for c in ("words", *block)])


def _ranked(sets: DataFrame, block: list[str]) -> DataFrame:
    """rep, size, w, r: the words of each set, rarest first.  The rank is within one set."""
    words = sets.select("rep", *block, F.size("words").alias("size"), F.explode("words").alias("w"))
    rare = save(words.groupBy("w").agg(F.count("*").alias("df")), "word-counts")  # a table: the join can be split where skewed
    return words.join(rare, "w").withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("df", "w")))


def _verified(found: DataFrame, sets: DataFrame, score, keep) -> DataFrame:
    one, two = (sets.select(F.col("rep").alias(c), F.col("words").alias("w" + c)) for c in "ab")
    return found.join(one, "a").join(two, "b").where(keep(score(F.col("wa"), F.col("wb")))).select("a", "b")


def similar_sets(sets: DataFrame, threshold: float, block: list[str], strict: bool = False) -> DataFrame:
    """Pairs a < b of ``sets`` (rep, words, block columns; each set once) with a Jaccard of ``threshold`` or more (over it if
    ``strict``).  A set is indexed by its rarest words only, as many as the threshold needs (prefix filter), so that no pair
    is lost and frequent words don't meet."""
    keys = _ranked(sets, block).where(F.col("r") <= F.floor((1 - threshold) * F.col("size") + 1e-9) + 1).select("rep", "size", "w", *block)
    a, b = keys.alias("a"), keys.alias("b")
    near = [F.col("a.w") == F.col("b.w"), F.col("a.rep") < F.col("b.rep"), F.col("a.size") >= F.col("b.size") * threshold - 1e-9, F.col("b.size") >= F.col("a.size") * threshold - 1e-9]
    near += [F.col(f"a.{c}") == F.col(f"b.{c}") for c in block]
    found = a.join(b, near).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    return _verified(found, sets, X.jaccard, lambda v: v > threshold if strict else v >= threshold)


def dedup_classes(entities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M3 as classes: entity_id, class_id.  Entities link if names of one type are similar, or names without a variant
    suffix are equal; entities without a name stand alone.  Copies meet their class by join, never each other."""
    rows = entities.select(F.col("entity_id").alias("id"), "entity_type", X.content_words(F.col("name"), NAME_STOPS).alias("words"))
    members = save(set_members(rows, ["entity_type"]), "members")
    sets = members.where("id = rep").select("rep", "words", "entity_type")
    base = F.trim(F.regexp_replace(F.lower("name"), SUFFIX, ""))
    named = entities.select("entity_id", base.alias("base")).where("base <> ''")
    first = named.join(named.groupBy("base").agg(F.min("entity_id").alias("first")), "base").where("first <> entity_id")
    links = similar_sets(sets, threshold, ["entity_type"])
    links = links.unionByName(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    comps = connected_components(links.unionByName(first.select(F.col("first").alias("a"), F.col("entity_id").alias("b"))))
    return entities.select("entity_id").join(comps.withColumnRenamed("node", "entity_id"), "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("class_id"))


def dedup_questions(questions: DataFrame, stops: list[str], jaccard: float = 0.55, overlap: float = 0.7) -> DataFrame:
    """M9: ids of ``questions`` (id, question) that stay when a question goes if a kept earlier one has a content-word Jaccard
    over ``jaccard``, or shares over ``overlap`` of the smaller set of content words of five letters or more."""
    rows = questions.select("id", F.array_sort(X.content_words(F.col("question"), stops)).alias("words"))
    rows = rows.withColumn("long", F.filter("words", lambda w: F.length(w) >= 5))
    key = lambda c: F.sha2(F.concat_ws(" ", c), 256)  # noqa: E731  # of sets in order, whose words hold no space: lists aren't shuffled to be compared
    rows = save(rows.withColumns({"w": F.when(F.size("words") > 0, key("words")), "l": F.when(F.size("long") > 0, key("long"))}), "questions")
    # equal sets of words, which have equal long ones, first: all but the earliest go, with or after it
    firsts = rows.where("w is not null").groupBy("w").agg(F.min("id").alias("id")).select("id").unionByName(rows.where("w is null").select("id"))
    own = save(rows.join(firsts, "id", "left_semi"), "different-questions")
    by_words = own.where("w is not null").select("id", F.col("id").alias("rep"), "words")
    reps = own.where("l is not null").groupBy("l").agg(F.min("id").alias("rep"))
    by_long = save(own.select("id", "l").join(reps, "l").select("id", "rep"), "sets")
    long_sets = own.select("id", F.col("long").alias("words")).join(by_long.where("id = rep"), "id").select("rep", "words")
    named = lambda df, kind, *cols: df.select(*[c for c in df.columns if c not in cols], *[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("rep")).alias(c) for c in cols])
    links = named(similar_pairs(by_words.select("rep", "words"), jaccard), "words", "a", "b").unionByName(named(overlapping_pairs(long_sets, overlap), "long", "a", "b"))
    by_words, by_long, links = named(by_words.select("id", "rep"), "words", "rep"), named(by_long, "long", "rep"), save(links, "links")  # read twice
    return keep_first(own.select("id"), by_words.unionByName(by_long).select("id", F.col("rep").alias("s")), links)


def keep_first(rows: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Ids of ``rows`` that stay when each goes if a kept smaller one is paired with it, where all members (id, s) of one set
    are paired, and all members of two linked sets (a, b).  That is the first maximal independent set, by rounds: what is
    the smallest undecided id of all sets that it meets is kept, and what else these sets hold goes.  Pairs are never
    written out.  Every round settles the smallest undecided id at least, so it ends."""
    members = save(members, "members")
    own = members.select(F.col("s").alias("a"), F.col("s").alias("b")).distinct()
    near = save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own).distinct(), "near-sets")
    undecided, kept, n = save(rows.select("id"), "undecided"), None, 0
    while not undecided.isEmpty():
        live = save(members.join(undecided, "id", "left_semi"), "live")
        least = live.groupBy("s").agg(F.min("id").alias("m"))
        first = near.join(least.withColumnRenamed("s", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
        blocked = live.join(first.withColumnRenamed("a", "s"), "s").where("m < id").select("id").distinct()
        free = save(undecided.join(blocked, "id", "left_anti"), "free")
        kept, n = free if kept is None else kept.unionByName(free), n + 1
        if n % 20 == 0:
            kept = save(kept, "kept")
        hit = live.join(free, "id", "left_semi").select(F.col("s").alias("a")).distinct().join(near, "a").select(F.col("b").alias("s")).distinct()
        gone = live.join(hit, "s", "left_semi").select("id").unionByName(free).distinct()
        undecided = save(undecided.join(gone, "id", "left_anti"), "undecided")
    return rows.select("id").limit(0) if kept is None else kept


def rewrite_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """M7: ``mapping`` (old, new)"""
    out = edges
    for c in ("source_id", "target_id"):
        out = out.join(mapping.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select("source_id", "rel_type", "target_id").distinct()


def dedup_documents(documents: DataFrame) -> DataFrame:
    """M8: (path, text, size) -> path, kept_path; rows without a text share none and keep themselves"""
    rows = documents.select("path", X.content_hash(F.col("text")).alias("hash"), "size")
    best = rows.where("hash is not null").groupBy("hash").agg(F.min(F.struct((-F.col("size")).alias("s"), "path"))["path"].alias("kept_path"))
    return rows.join(best, "hash", "left").select("path", F.coalesce("kept_path", "path").alias("kept_path"))


def greedy_keep_first(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """keep_first() for single pairs (a, b)"""
    return keep_first(rows, rows.select("id", F.col("id").alias("s")), pairs.where("a <> b"))


def dedup_text(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(qid, entity_id, score, description) without the rows whose description has a word Jaccard over ``threshold``
    with a kept row of the question that scores more (ties: the smaller id).  A question's list is a search result, some
    hundred rows at most; pairs come from a shared rare word, never from all rows of a question."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "entity_id"))
    rows = save(scored.withColumn("id", F.struct("qid", place.alias("place"))), "scored")
    words = rows.select("id", "qid", F.array_sort(X.word_set(F.col("description"))).alias("words"))
    sets = words.where(F.size("words") > 0).select(F.col("id").alias("rep"), "qid", "words")
    kept = greedy_keep_first(rows, similar_sets(sets, threshold, ["qid"], strict=True))
    return rows.join(kept, "id", "left_semi").drop("id")


def fold_members(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """M6: entities (entity_id, name, confidence, source_documents, relationships map<string, array<string>>, body) of one
    class (entity_id, keep) as one: the kept one's name; relationship lists united by key; sources as a sorted union; the
    greatest confidence (0.5 where none has one); bodies in order of ids after the kept one's, each unless what stands
    before holds it."""
    rows = entities.join(classes, "entity_id", "left").withColumn("keep", F.coalesce("keep", "entity_id"))
    mine = F.when(F.col("entity_id") == F.col("keep"), 0).otherwise(1)
    lists = rows.select("keep", mine.alias("o"), "entity_id", F.explode("relationships").alias("rel", "targets")).select("keep", "o", "entity_id", "rel", F.posexplode("targets").alias("p", "target"))
    firsts = lists.groupBy("keep", "rel", "target").agg(F.min(F.struct("o", "entity_id", "p")).alias("at"))
    by_rel = firsts.groupBy("keep", "rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "target"))), lambda x: x["target"]).alias("targets"))
    edges = by_rel.groupBy("keep").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "targets")))).alias("relationships"))
    sources = rows.select("keep", F.explode("source_documents").alias("s")).distinct().groupBy("keep").agg(F.sort_array(F.collect_list("s")).alias("source_documents"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct(mine.alias("o"), "entity_id", F.coalesce("body", F.lit("")).alias("body")))), lambda x: x["body"])
    joined = F.aggregate(bodies, F.lit(""), lambda a, x: F.when(F.contains(a, x), a).when(a == "", x).otherwise(F.concat(a, F.lit("\n\n"), x)))
    one = rows.groupBy("keep").agg(F.max(F.when(mine == 0, F.col("name"))).alias("name"), F.coalesce(F.max("confidence"), F.lit(0.5)).alias("confidence"), F.count("*").alias("members"), joined.alias("body"))
    return one.join(sources, "keep", "left").join(edges, "keep", "left").withColumnRenamed("keep", "entity_id")


def judge_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """P3, by rule: (a, b) -> a, b, action, keep_id.  Names that are equal without a variant suffix merge, and the one of
    higher confidence stays (ties: the smaller id)."""
    base = F.trim(F.regexp_replace(F.lower("name"), SUFFIX, ""))
    at = [entities.select(F.col("entity_id").alias(c), base.alias("base_" + c), F.coalesce("confidence", F.lit(0.5)).alias("conf_" + c)) for c in "ab"]
    rows = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(at[0], "a").join(at[1], "b")
    keep = F.when(F.col("conf_b") > F.col("conf_a"), F.col("b")).otherwise(F.col("a"))
    return rows.select("a", "b", F.when(F.col("base_a") == F.col("base_b"), "merge").otherwise("keep").alias("action"), keep.alias("keep_id"))

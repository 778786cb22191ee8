"""Two tables matched one to one: exact ids first, then similar names of one type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..ontology import NAME_STOPS
from ..scratch import save
from .resolve import set_members, similar_sets
from .scan import numbered

#: Places that one array holds while matched stretches are written out.
STRETCH = 4096


def _classes(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (rep, side, id, rank from 0 within class and side) and sets (rep, words, kind) of the rows that have words"""
    sides = [t.select(F.struct(F.lit(i).alias("side"), "id").alias("id"), "kind", F.sort_array(X.content_words(F.col("name"), NAME_STOPS)).alias("words")) for i, t in enumerate((a, b))]
    found = save(set_members(sides[0].unionByName(sides[1]), ["kind"]), "name-members")
    placed = save(numbered(found.select("rep", "id"), "rep", "id").withColumn("side", F.col("id.side")), "name-places")
    first = placed.groupBy("rep", "side").agg(F.min("place").alias("first"))
    members = placed.join(first, ["rep", "side"]).select("rep", "side", F.col("id.id").alias("id"), (F.col("place") - F.col("first")).alias("rank"))
    return save(members, "name-ranks"), found.where("id = rep").select("rep", "words", "kind")


def _assigned(pairs: DataFrame, rooms: DataFrame) -> DataFrame | None:
    """x, y, score, n, from_x, from_y: how many members of class x go to class y, and from which rank on.  As taking the pairs
    one by one in the order (score falling, x, y), but a round takes every pair that is the first one left of both its
    classes, and with it all the members that the smaller side has left."""
    room = lambda side, c: rooms.where(F.col("side") == side).select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.lit(0).cast("long").alias(f"from_{c}"))
    live = pairs.join(room(0, "x"), "x").join(room(1, "y"), "y").withColumn("at", F.struct((-F.col("score")).alias("s"), "x", "y"))
    live, taken = save(live, "open-pairs"), None
    while not live.isEmpty():
        firsts = [live.groupBy(c).agg(F.min("at").alias("at")) for c in "xy"]
        both = firsts[0].select("at").join(firsts[1].select("at"), "at")
        now = save(live.join(both, "at", "left_semi").select("x", "y", "score", F.least("n_x", "n_y").alias("n"), "from_x", "from_y"), "taken-pairs")
        taken = now if taken is None else taken.unionByName(now)
        for c in "xy":
            live = live.join(now.select(c, F.col("n").alias("used")), c, "left").withColumn("used", F.coalesce("used", F.lit(0)))
            live = live.withColumns({f"n_{c}": F.col(f"n_{c}") - F.col("used"), f"from_{c}": F.col(f"from_{c}") + F.col("used")}).drop("used")
        live = save(live.where("n_x > 0 and n_y > 0"), "open-pairs")
    return taken


def match_names(a: DataFrame, b: DataFrame, at: float = 0.5) -> DataFrame:
    """(a, b, score): rows of ``a`` and ``b`` (id, kind, name; ids of one type) matched one to one within a kind, where their
    names' sets of content words have a Jaccard of ``at`` or more; the most similar first, ties by the smallest ids.

    Rows with equal kinds and word sets are a class; candidates are pairs of classes (found by a prefix filter that loses
    none), never of rows, and a class gives its rows in the order of their ids, so that a name that a third of all rows have
    costs no more than its rows.  A chain of classes, each more similar to the next one, takes one round a link.

    Defined cases: names without a content word and null kinds match nothing; an id that is repeated is matched as often; an
    empty table matches nothing."""
    members, sets = _classes(a, b)
    near = save(similar_sets(sets, at, ["kind"]), "near-names")
    pairs = near.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y")))
    words = lambda c: sets.select(F.col("rep").alias(c), F.col("words").alias(f"w_{c}"))
    scored = pairs.join(words("x"), "x").join(words("y"), "y").select("x", "y", F.round(X.jaccard(F.col("w_x"), F.col("w_y")), 9).alias("score"))
    scored = scored.unionByName(sets.where("kind is not null").select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("score")))
    flows = _assigned(scored, members.groupBy("rep", "side").agg(F.count("*").alias("n")))
    if flows is None:
        return members.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    last = F.col("n") - 1
    parts = flows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / STRETCH))))
    steps = parts.withColumn("step", F.explode(F.sequence(F.col("part") * STRETCH, F.least(last, F.col("part") * STRETCH + STRETCH - 1))))
    steps = steps.select("x", "y", "score", (F.col("from_x") + F.col("step")).alias("rank_x"), (F.col("from_y") + F.col("step")).alias("rank_y"))
    one = lambda side, c, name: members.where(F.col("side") == side).select(F.col("rep").alias(c), F.col("rank").alias(f"rank_{c}"), F.col("id").alias(name))
    return steps.join(one(0, "x", "a"), ["x", "rank_x"]).join(one(1, "y", "b"), ["y", "rank_y"]).select("a", "b", "score")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("entity_id").alias("id"), F.col("entity_type").alias("kind"), "name")


def ground_truth_recall(entities: DataFrame, truth: DataFrame, at: float = 0.5) -> DataFrame:
    """Every expected (entity_id, entity_type) of ``truth`` once, with ``what``: 'found'; 'type-mismatch' (its id is there
    under other types, the smallest of which is ``found_type``); 'id-mismatch' (match_names() gives it an entity of its type
    whose id nobody expects, ``found_id``); else 'absent'.  Both tables: entity_id, entity_type, name.

    Defined cases: of repeated rows the smallest name counts; rows without an id are expected by nobody and are left out;
    null types are equal."""
    once = lambda df: df.where("entity_id is not null").groupBy("entity_id", "entity_type").agg(F.min("name").alias("name"))
    there, wanted = save(once(entities), "there"), once(truth)
    types = there.groupBy("entity_id").agg(F.min(F.coalesce("entity_type", F.lit(""))).alias("found_type"))
    same = there.select(F.col("entity_id").alias("i"), F.col("entity_type").alias("k"))
    rows = wanted.join(same, (F.col("entity_id") == F.col("i")) & F.col("entity_type").eqNullSafe(F.col("k")), "left").join(types, "entity_id", "left")
    rows = save(rows.select("entity_id", "entity_type", "name", F.col("i").isNotNull().alias("exact"), "found_type"), "expected")
    spare = there.join(rows.select("entity_id"), "entity_id", "left_anti")
    named = match_names(_named(rows.where("found_type is null")), _named(spare), at)
    # an id expected under several types may be matched under each: the entity's type says which
    named = named.join(spare.select(F.col("entity_id").alias("b"), F.col("entity_type").alias("b_type")), "b").select(F.col("a").alias("entity_id"), F.col("b").alias("found_id"), F.col("b_type").alias("entity_type"), "score")
    rows = rows.join(named.groupBy("entity_id", "entity_type").agg(F.min("found_id").alias("found_id"), F.max("score").alias("score")), ["entity_id", "entity_type"], "left")
    what = F.when(F.col("exact"), "found").when(F.col("found_type").isNotNull(), "type-mismatch").when(F.col("found_id").isNotNull(), "id-mismatch").otherwise("absent")
    return rows.select("entity_id", "entity_type", what.alias("what"), F.when(F.col("exact"), F.col("entity_id")).otherwise(F.col("found_id")).alias("found_id"), F.when(~F.col("exact"), F.col("found_type")).alias("found_type"), "score")


def recall(rows: DataFrame) -> DataFrame:
    """expected, found, id_mismatch, type_mismatch, absent, recall (null without expectations) of ground_truth_recall()"""
    n = lambda what: F.count_if(F.col("what") == what)
    share = F.try_divide(n("found"), F.count("*"))
    return rows.agg(F.count("*").alias("expected"), *[n(w).alias(w.replace("-", "_")) for w in ("found", "id-mismatch", "type-mismatch", "absent")], F.round(share, 4).alias("recall"))


def kb_diff(before: DataFrame, after: DataFrame, at: float = 0.5) -> DataFrame:
    """entity_id, new_id, what of two runs (entity_id, entity_type, name and further columns, the same in both; each id
    once): 'retyped', 'changed' (any other column differs), 'same'; of the rest 'renamed' (match_names() gives it an id of
    the other run, ``new_id``), 'lost' or 'added' (under ``new_id`` alone).

    Defined cases: nulls are equal; rows without an id are left out; empty runs lose or add everything."""
    rest = [c for c in before.columns if c not in ("entity_id", "entity_type")]
    pack = lambda df, c: df.where("entity_id is not null").select("entity_id", F.struct("entity_type", F.struct(*rest).alias("rest"), "name").alias(c))
    rows = save(pack(before, "x").join(pack(after, "y"), "entity_id", "full"), "two-runs")
    side = lambda c, other: rows.where(F.col(other).isNull()).select(F.col("entity_id").alias("id"), F.col(f"{c}.entity_type").alias("kind"), F.col(f"{c}.name").alias("name"))
    lost, added = side("x", "y"), side("y", "x")
    named = save(match_names(lost, added, at), "renamed")
    what = F.when(~F.col("x.entity_type").eqNullSafe(F.col("y.entity_type")), "retyped").when(~F.col("x.rest").eqNullSafe(F.col("y.rest")), "changed").otherwise("same")
    kept = rows.where("x is not null and y is not null").select("entity_id", F.col("entity_id").alias("new_id"), what.alias("what"))
    moved = named.select(F.col("a").alias("entity_id"), F.col("b").alias("new_id"), F.lit("renamed").alias("what"))
    none = F.lit(None).cast(before.schema["entity_id"].dataType)
    gone = lost.join(named.select(F.col("a").alias("id")), "id", "left_anti").select(F.col("id").alias("entity_id"), none.alias("new_id"), F.lit("lost").alias("what"))
    new = added.join(named.select(F.col("b").alias("id")), "id", "left_anti").select(none.alias("entity_id"), F.col("id").alias("new_id"), F.lit("added").alias("what"))
    return kept.unionByName(moved).unionByName(gone).unionByName(new)


def run_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Dim ('source' or 'entity_type'), value, n_before, n_after: entities of two runs (entity_type, source) per document and
    per type; a null value is a value of its own"""
    both = before.select("source", "entity_type", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("source", "entity_type", F.lit(0).alias("b"), F.lit(1).alias("a")))
    dims = both.select("b", "a", F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in ("source", "entity_type")])).alias("d"))
    return dims.groupBy("d.dim", "d.value").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))

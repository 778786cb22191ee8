"""A trie of conversation prefixes, built as burst tries.

A turn's id is the MD5 of its role and text; a prefix's identity is its depth with two sums (xor) of hashes of (depth, id)
over its turns, 128 bits that don't depend on the order of summing.

1. Conversations are cut into segments of ``segment`` turns, so no row holds more ids than that; conversations with equal
   sequences become one class with its weight.
2. A level of the trie is the segments with the same number.  Its shards hold suffix containers under heads (prefixes,
   at first those where the segments begin).  While a container holds more than ``limit`` turns it bursts: its suffixes
   move under heads that are one turn longer.  A suffix that ends stays.
3. Each container is sorted by its ids and swept once with a stack into nodes.  Totals of containers go up to the heads
   that burst, round by round, and from a level to the segments that it continues.

Equal sequences are one suffix, so copies of one conversation can't fill a container; different conversations with a long
common prefix take a round for each turn of it beyond which they are still too many.

Defined cases: turns are ordered by number (null first), equal numbers by role and then by the text's hash; rows that
repeat are turns of their own; null role and text are empty; rows without a conversation take no part; a turnless
conversation ends at the root; an empty table gives no nodes; texts are taken whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .common import groups, save

HEAD = ["depth", "x1", "x2"]
ID = 16
FOUND = "kind int, depth long, x1 long, x2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
BELOW = ["below_children", "below_leaves", "below_saved", "ended", "ends"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv, pos (from 0), id, size (bytes of text) of each turn in its original conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    own = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), own.alias("id"), F.octet_length(text).cast("long").alias("size"))
    placed = numbered(rows, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("id")).select("conv", "id", "size", "place")
    first = save(placed.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("n")), "conversations")
    return placed.join(first, "conv").select("conv", "n", "id", "size", (F.col("place") - F.col("first")).alias("pos"))


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, id, size) of the rebuilt conversations, and the ids of all conversations: the first h turns of conversation
    c - c % ``group``, then c's own turns after its first h, h = crc32(c) % ``heads``."""
    rows = save(turn_rows(turns), "turns")
    convs = save(rows.groupBy("conv").agg(F.max("n").alias("n")), "conversations")
    h = (F.crc32(F.col("conv").cast("string")) % heads).alias("h")
    convs = convs.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), h)
    bases = rows.where((F.col("conv") % group == 0) & (F.col("pos") < heads - 1)).select(F.col("conv").alias("base"), "n", "id", "size", "pos")
    shared = convs.join(bases, "base").where("pos < h").select("conv", "pos", "id", "size")
    has = convs.join(bases.where("pos = 0").select("base", "n"), "base", "left").select("conv", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("k"))
    own = rows.join(has, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "size")
    return shared.unionByName(own), convs.select("conv")


def _mixed(pos: Column, value: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), pos, value) for k in (1, 2)]


def segments(rows: DataFrame, convs: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """Of each class of equal conversations: rows (level, head, conv, weight, ids, sizes, ends_here) a segment, the last one shorter
    than ``segment`` and perhaps empty; and (conv, member), the smallest of the class and each of its conversations."""
    x1, x2 = _mixed(F.col("pos"), F.col("id"))
    parts = rows.withColumns({"x1": x1, "x2": x2}).groupBy("conv", F.floor(F.col("pos") / segment).alias("level"))
    turns = F.array_sort(F.collect_list(F.struct("pos", "id", "size")))
    parts = parts.agg(turns.alias("t"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    ids = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["id"])), ""))
    before = Window.partitionBy("conv").orderBy("level")
    through = before.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("conv", "level", ids.alias("ids"), F.transform("t", lambda t: t["size"]).alias("sizes"), F.bit_xor("x1").over(through).alias("y1"), F.bit_xor("x2").over(through).alias("y2"))
    parts = save(parts.withColumn("n", F.col("level") * segment + F.size("sizes")), "segments")
    whole = parts.groupBy("conv").agg(F.max(F.struct("n", "y1", "y2")).alias("w")).select("conv", "w.*")
    whole = save(convs.join(whole, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "y1", "y2")]), "whole")
    classes = save(whole.groupBy("n", "y1", "y2").agg(F.min("conv").alias("least"), F.count("*").alias("weight")), "classes")
    members = whole.join(classes, ["n", "y1", "y2"]).select(F.col("least").alias("conv"), F.col("conv").alias("member"))
    kept = classes.select(F.col("least").alias("conv"), "weight", F.col("n").alias("total"), "y1", "y2")
    own = parts.drop("y1", "y2", "n").join(kept.select("conv", "weight", "total"), "conv")
    empty = kept.where(F.col("total") % segment == 0).select("conv", F.floor(F.col("total") / segment).alias("level"), F.lit(b"").alias("ids"), F.array().cast("array<long>").alias("sizes"), "weight", "total")
    own = own.unionByName(empty)
    # a segment's head is the end of the one before it
    ends = parts.select("conv", (F.col("level") + 1).alias("level"), F.col("y1").alias("x1"), F.col("y2").alias("x2"))
    own = own.join(ends, ["conv", "level"], "left").withColumn("depth", F.col("level") * segment)
    zero = F.lit(0).cast("long")
    return own.select("level", "depth", F.coalesce("x1", zero).alias("x1"), F.coalesce("x2", zero).alias("x2"), "conv", "weight", "ids", "sizes", (F.col("total") < F.col("depth") + segment).alias("ends_here")), members


def sweep(conv: list, weight: list, ids: list[bytes], sizes: list, below: list, depth: int) -> tuple[list[list], list]:
    """Nodes (depth, conv, parent, n, children, leaves, saved, ends) of one sorted container under a head at ``depth``, the
    head first with its parent open and without its own saving.  ``below``: what a later level knows of a suffix's end
    (children, leaves, saved), and the class that ends there or None."""
    root = [depth, min(conv), None, sum(weight), 0, 0, 0, None]
    found, stack, last = [root], [root], b""
    up, lengths = {id(root): None}, []

    def close() -> None:
        node = stack.pop()
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * lengths.pop()
        stack[-1][5] += node[5]
        stack[-1][6] += node[6]

    for c, w, own, size, more in zip(conv, weight, ids, sizes, below, strict=True):
        common, most = 0, min(len(last), len(own))
        while common < most and last[common : common + ID] == own[common : common + ID]:
            common += ID
        while len(stack) - 1 > common // ID:
            close()
        for node in stack[1:]:
            node[1], node[3] = min(node[1], c), node[3] + w
        for at in range(common, len(own), ID):
            stack[-1][4] += 1
            node = [depth + at // ID + 1, c, None, w, 0, 0, 0, None]
            up[id(node)] = stack[-1]
            found.append(node)
            stack.append(node)
            lengths.append(int(size[at // ID]))
        if more[3] is not None:
            stack[-1][7] = more[3]
        if more[0] and not stack[-1][4]:
            stack[-1][4:7] = more[:3]
        last = own
    while len(stack) > 1:
        close()
    root[5] = root[5] or 1
    for node in found[1:]:
        node[2] = up[id(node)][1]
    return found, root


def swept(container: DataFrame) -> DataFrame:
    """FOUND rows of sorted containers: kind 0 a node, kind 1 a head (its ``ends`` is the class that ends there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        schema = pa.schema([pa.field(n, pa.int32() if n == "kind" else pa.int64()) for n in (p.split()[0] for p in FOUND.split(", "))])
        cut = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for g in groups(batches, *HEAD):
            head = (int(g["depth"][0]), int(g["x1"][0]), int(g["x2"][0]))
            below = [(a, b, s, e if ended else None) for a, b, s, ended, e in zip(*(g[n].tolist() for n in BELOW), strict=True)]
            nodes, root = sweep(g["conv"].tolist(), g["weight"].tolist(), g["ids"].tolist(), g["sizes"].tolist(), below, head[0])
            out.append((1, *head, root[1], None, *root[3:]))
            out += [(0, n[0], 0, 0, *n[1:]) for n in nodes[1:]]
            if len(out) > 20_000:
                yield cut()
                out = []
        if out:
            yield cut()

    names = [*HEAD, "conv", "weight", "ids", "sizes", *BELOW]
    return container.select(*names).repartition(*HEAD).sortWithinPartitions(*HEAD, "ids", "conv").mapInArrow(run, FOUND)


def _level(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (FOUND, kind 0) strictly below the heads of ``rows``, and the heads' totals (kind 1)."""
    done, bursts = [], []
    live = rows.select(*HEAD, "conv", "weight", "ids", "sizes", *BELOW)
    while True:
        held = live.groupBy(*HEAD).agg(F.sum(F.size("sizes") + 1).alias("held"), F.max(F.size("sizes")).alias("deep"))
        large = save(held.where((F.col("held") > limit) & (F.col("deep") > 0)).select(*HEAD), "oversized")
        if large.isEmpty():
            done.append(live)
            break
        done.append(live.join(large, HEAD, "left_anti"))
        inside = live.join(large, HEAD, "left_semi")
        first = F.substring("ids", 1, ID)
        x1, x2 = _mixed(F.col("depth"), first)
        longer = inside.where(F.size("sizes") > 0)
        longer = longer.select((F.col("depth") + 1).alias("depth"), F.col("x1").bitwiseXOR(x1).alias("x1"), F.col("x2").bitwiseXOR(x2).alias("x2"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.element_at("sizes", 1).alias("size"), "conv", "weight", F.expr(f"substring(ids, {ID + 1})").alias("ids"), F.slice("sizes", 2, 1 << 30).alias("sizes"), *BELOW)
        longer = save(longer, "burst")
        heads = save(longer.groupBy(*HEAD).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("size").alias("size")), "heads")
        bursts.append((large, inside.where(F.size("sizes") == 0), heads))
        live = longer.drop("p1", "p2", "size")
    containers = done[0]
    for more in done[1:]:
        containers = containers.unionByName(more)
    found = save(swept(containers), "swept")
    nodes, totals = [found.where("kind = 0")], found.where("kind = 1")
    for large, stays, heads in reversed(bursts):
        child = totals.join(heads, HEAD).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
        stays = stays.groupBy(*HEAD).agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min(F.when(F.col("ended"), F.col("ends"))).alias("ends"), *[F.max(c).alias(c) for c in BELOW[:3]])
        stays = stays.select(*HEAD, "conv_id", "n_convs", F.col("below_children").alias("n_children"), F.col("below_leaves").alias("n_leaves"), F.col("below_saved").alias("saved_tokens"), "ends")
        up = child.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("long").alias("ends"))
        whole = up.unionByName(stays).groupBy(*HEAD).agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min("ends").alias("ends"))
        whole = save(whole.select(F.lit(1).alias("kind"), *HEAD, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "ends"), "totals")
        parent = whole.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("above"))
        nodes.append(child.join(parent, ["depth", "p1", "p2"]).withColumn("parent_conv_id", F.col("above")).select(*found.columns))
        totals = totals.join(heads.select(*HEAD), HEAD, "left_anti").unionByName(whole)
    below = nodes[0]
    for more in nodes[1:]:
        below = below.unionByName(more)
    return below, totals


def ends_digests(members: DataFrame) -> DataFrame:
    """ends (smallest of a class), ends_sha256: its conversations' ids, ascending, joined by commas.  Ids stream through the
    digest, so that a large class takes no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        cut = lambda: pa.RecordBatch.from_pydict({"ends": pa.array([now], pa.int64()), "ends_sha256": [digest.hexdigest()]})
        for batch in batches:
            for c, m in zip(batch.column("conv").to_pylist(), batch.column("member").to_pylist(), strict=True):
                if c != now:
                    if digest is not None:
                        yield cut()
                    now, digest = c, hashlib.sha256(str(m).encode())
                else:
                    digest.update(b",%d" % m)
        if digest is not None:
            yield cut()

    return members.repartition("conv").sortWithinPartitions("conv", "member").mapInArrow(run, "ends long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame, segment: int = 4096, limit: int = 20_000) -> DataFrame:
    """A row a node of the trie of conversations ``rows`` (conv, pos, id, size) of all ``convs`` (conv)."""
    cut, members = segments(rows, convs, segment)
    cut = save(cut, "cut")
    top = cut.agg(F.max("level")).first()[0] or 0
    nodes, totals = None, None
    for level in range(top, -1, -1):
        own = cut.where(F.col("level") == level)
        zero, here = F.lit(0).cast("long"), F.when(F.col("ends_here"), F.col("conv"))
        if totals is None:
            own = own.select("*", *[zero.alias(c) for c in BELOW[:3]], F.col("ends_here").alias("ended"), F.coalesce(here, zero).alias("ends"))
        else:
            # the end of a full segment is the head of what continues it
            follows = cut.where(F.col("level") == level + 1).select("conv", F.struct(*HEAD).alias("next"))
            sums = totals.select(F.struct(*HEAD).alias("next"), F.col("n_children").alias("c"), F.when(F.col("n_children") > 0, F.col("n_leaves")).alias("l"), F.col("saved_tokens").alias("s"), F.col("ends").alias("e"))
            own = own.join(follows, "conv", "left").join(sums, "next", "left")
            ends = F.coalesce(here, F.col("e"))
            own = own.select(*cut.columns, *[F.coalesce(c, zero).alias(b) for c, b in zip("cls", BELOW, strict=False)], ends.isNotNull().alias("ended"), F.coalesce(ends, zero).alias("ends"))
        found, totals = _level(save(own, "level"), limit)
        totals = totals.where(F.col("depth") == level * segment)
        nodes = found if nodes is None else nodes.unionByName(found)
    root = totals.withColumn("parent_conv_id", F.lit(None).cast("long"))
    return nodes.unionByName(root.select(*nodes.columns)).drop("kind", "x1", "x2"), members

"""Queries of packs under a budget and of question deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ontology
from ..functions import text as X
from ..operators import dictionary, packs, resolve
from . import adapters as A
from .registry import query

BUDGET = 20_000
_LAYERS = "[" + ", ".join(f"'{x}'" for x in ontology.LAYERS) + "]"
_TITLE = "array_to_string(list_transform(string_split({}, '-'), lambda w: upper(w[1]) || w[2:]), ' ')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in ontology.QUESTION_STOPS) + "]"


def _cuts(rows: str, left: str, prefix: str = "") -> str:
    """CTE cut (li, room, cut): where each layer of ``rows`` (li, r) stops."""
    return f"""cut(li, room, cut) AS (SELECT 0, ({left})::BIGINT, -1::BIGINT
 UNION ALL SELECT cut.li + 1, cut.room - greatest(coalesce(max(z.r), 0), 0), coalesce(max(z.r), -1)
 FROM cut LEFT JOIN {rows} z ON z.li = cut.li + 1 AND z.r <= cut.room WHERE cut.li < {len(ontology.LAYERS)} GROUP BY cut.li, cut.room)"""


@query(
    "w11_layered_budget",
    f"""WITH RECURSIVE {A.SQL_ENTITIES},
z AS (SELECT entity_id, layer, list_position({_LAYERS}, layer) AS li,
 sum(coalesce(length(description), 0)) OVER (PARTITION BY layer ORDER BY confidence DESC, name NULLS FIRST, entity_id)::BIGINT AS r FROM ent),
{_cuts("z", str(BUDGET))}
SELECT entity_id, layer, r AS running FROM z JOIN cut USING (li) WHERE r <= cut""",
)
def w11(s, d):
    rows = A.entities(s, d).withColumn("n", F.length("description").cast("long"))
    return packs.layered_budget(rows, ontology.LAYERS, [F.desc("confidence"), F.col("name"), F.col("entity_id")], "n", BUDGET).select("entity_id", "layer", "running")


def packed(s, d):
    e = A.entities(s, d)
    label = lambda name, c: F.concat(F.lit(name + ": "), c)
    relations = F.array_compact(F.array(label("related to", F.col("lang")), label("part of", F.col("source"))))
    e = e.withColumns({"entity_id": F.format_string("%012d", F.col("entity_id")), "overview": X.overview(X.section(F.col("body"), "Overview")), "relations": relations})
    return packs.export_pack(e, "Knowledge", ontology.LAYERS, BUDGET)


_PACK = f"""{A.SQL_ENTITIES},
ids AS (SELECT *, printf('%012d', entity_id) AS id FROM ent),
kinds AS (SELECT entity_type, count(*) AS n FROM ids GROUP BY 1),
head AS (SELECT list_concat(['# Knowledge', '', '> ' || sum(n) || ' entities across ' || count(*) || ' types.', '', '## Entity Types', ''],
 list('- **' || {_TITLE.format("entity_type")} || '** (' || n || ')' ORDER BY n DESC, entity_type), ['']) AS lines FROM kinds),
ln AS (SELECT id, layer, list_position({_LAYERS}, layer) AS li, confidence, name, list_concat(['### ' || coalesce(name, id), '*' || entity_type || '* | confidence: ' || confidence],
 CASE WHEN coalesce(description, '') <> '' THEN ['> ' || description] ELSE [] END, [''],
 CASE WHEN lang IS NOT NULL OR source IS NOT NULL THEN list_append(list_filter(['- related to: ' || lang, '- part of: ' || source], lambda v: v IS NOT NULL), '') ELSE [] END) AS lines FROM ids),
z AS (SELECT *, sum(list_sum(list_transform(lines, lambda x: length(x)))) OVER (PARTITION BY layer ORDER BY confidence DESC, name NULLS FIRST, id)::BIGINT AS r FROM ln),
{_cuts("z", f"SELECT {4 * BUDGET} - list_sum(list_transform(lines, lambda x: length(x))) FROM head")},
kept AS (SELECT z.* FROM z JOIN cut USING (li) WHERE r <= cut),
cnt AS (SELECT li, layer, count(*) AS n, count(*) - (SELECT count(*) FROM kept WHERE kept.li = z.li) AS missing FROM z WHERE li > 0 GROUP BY 1, 2),
pack AS (SELECT 0 AS section, 0 AS place, NULL AS layer, NULL AS entity_id, array_to_string(lines, chr(10)) AS text FROM head
 UNION ALL SELECT li, 0, layer, NULL, '## ' || {_TITLE.format("layer")} || ' Layer' || chr(10) FROM cnt
 UNION ALL SELECT li, row_number() OVER (ORDER BY li, confidence DESC, name NULLS FIRST, id), layer, id, array_to_string(lines, chr(10)) FROM kept
 UNION ALL SELECT li, 4611686018427387904, layer, NULL, '*(' || missing || ' more entities truncated due to token budget)*' FROM cnt WHERE missing > 0)"""


@query("s14_export_pack", f"WITH RECURSIVE {_PACK} SELECT section::INT AS section, place::BIGINT AS place, layer, entity_id, text FROM pack")
def s14(s, d):
    return packed(s, d)


@query(
    "a12_pack_stats",
    f"""WITH RECURSIVE {_PACK},
c AS (SELECT layer, entity_id, length(text) + 1 AS chars, CASE WHEN entity_id IS NULL THEN nullif(regexp_extract(text, '^\\*\\((\\d+) more entities', 1), '')::BIGINT END AS missing FROM pack),
a AS (SELECT layer, count(entity_id) AS entities, sum(chars) AS chars, coalesce(sum(missing), 0) AS truncated, 0 AS k FROM c WHERE layer IS NOT NULL GROUP BY layer
 UNION ALL SELECT NULL, count(entity_id), sum(chars), coalesce(sum(missing), 0), 1 FROM c)
SELECT layer, entities, (chars - k)::BIGINT AS chars, ((chars - k) // 4)::BIGINT AS tokens, truncated::BIGINT AS truncated FROM a""",
)
def a12(s, d):
    return packs.pack_stats(packed(s, d))


@query(
    "m9_dedup_questions",
    f"""WITH RECURSIVE w AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS n, list_filter(c, lambda x: length(x) >= 5) AS l FROM (
 SELECT conv_id * 1000 + turn AS id, list_filter(list_distinct({A.SQL_WORDS.format("text")}), lambda x: NOT list_contains({_STOPS}, x)) AS c FROM conversations)),
p AS MATERIALIZED (SELECT b.n, list(a.n) AS near FROM w a JOIN w b ON a.n < b.n WHERE len(a.c) > 0 AND len(b.c) > 0
 AND (len(list_intersect(a.c, b.c)) > 0.55 * (len(a.c) + len(b.c) - len(list_intersect(a.c, b.c)))
 OR (len(a.l) > 0 AND len(b.l) > 0 AND len(list_intersect(a.l, b.l)) > 0.7 * least(len(a.l), len(b.l)))) GROUP BY b.n),
k(n, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
 SELECT k.n + 1, CASE WHEN len(list_intersect(kept, coalesce(near, []))) > 0 THEN kept ELSE list_append(kept, k.n + 1) END FROM k LEFT JOIN p ON p.n = k.n + 1 WHERE k.n < (SELECT count(*) FROM w))
SELECT id FROM w WHERE n IN (SELECT unnest(kept) FROM (SELECT kept FROM k ORDER BY n DESC LIMIT 1))""",
)
def m9(s, d):
    rows = A.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    return resolve.dedup_questions(rows, ontology.QUESTION_STOPS)


def named(s, d):
    """Entities named by the first three words of the benchmark's passages"""
    three = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return A.table(s, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.concat(F.lit("n"), F.col("item_id")).alias("id"), three.alias("name"))


@query(
    "j7_relevant_entities",
    """WITH n AS (SELECT item_id AS entity_id, 'n' || item_id AS id, lower(array_to_string(string_split(text, ' ')[1:3], ' ')) AS name FROM benchmark),
l AS (SELECT doc_id, lower(text) AS low FROM documents),
s AS (SELECT doc_id, entity_id, 3 * contains(low, name)::INT + 2 * contains(low, id)::INT
 + len(list_filter(regexp_split_to_array(name, '\\s+'), lambda w: length(w) >= 4 AND contains(low, w))) AS score FROM l CROSS JOIN n WHERE name <> '')
SELECT doc_id, entity_id, score::BIGINT AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, entity_id) <= 10""",
)
def j7(s, d):
    found = dictionary.relevant_entities(A.table(s, d, "documents"), named(s, d))
    return found.select("doc_id", "entity_id", F.col("score").cast("long").alias("score"))


@query("x16_link_all_names")
def x16_all(s, d):
    """All names in all texts"""
    docs = A.table(s, d, "documents").select("doc_id", "text")
    return dictionary.link_all(docs, named(s, d).select("name")).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "s15_vault",
    f"""WITH {A.SQL_EDGES}, {A.SQL_NODES}, nn AS (SELECT entity_id, entity_type, coalesce(name, entity_id) AS name FROM nod),
k AS (SELECT source_id, rel_type, '**' || array_to_string(list_transform(string_split(rel_type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ':** '
 || string_agg('[[' || coalesce(name, target_id) || ']]', ', ' ORDER BY target_id) AS line FROM edg LEFT JOIN nn ON entity_id = target_id GROUP BY 1, 2),
r AS (SELECT source_id, string_agg(line, chr(10) ORDER BY rel_type) AS lines FROM k GROUP BY 1),
p AS (SELECT entity_type || '/' || entity_id || '.md' AS path, '---' || chr(10) || 'type: ' || entity_type || chr(10) || 'id: ' || entity_id || chr(10) || 'name: ' || name || chr(10)
 || 'aliases:' || chr(10) || '- ' || entity_id || chr(10) || '- ' || name || chr(10) || '---' || chr(10) || chr(10) || '# ' || name || chr(10)
 || coalesce(chr(10) || '## Relationships' || chr(10) || chr(10) || lines || chr(10), '') AS text FROM nn LEFT JOIN r ON source_id = entity_id),
i AS (SELECT entity_type, '- [[' || name || ']] (' || entity_type || ')' AS entry, row_number() OVER (PARTITION BY entity_type ORDER BY '- [[' || name || ']] (' || entity_type || ')', entity_id) - 1 AS n FROM nn)
SELECT path, md5(text) AS text_md5 FROM p UNION ALL
SELECT 'index/' || entity_type || '/' || (n // 1000) || '.md', md5('## ' || upper(entity_type[1]) || entity_type[2:] || chr(10) || chr(10) || string_agg(entry, chr(10) ORDER BY n) || chr(10)) FROM i GROUP BY entity_type, n // 1000""",
)
def s15(s, d):
    none = F.lit(None).cast("string")
    nodes = A.nodes(s, d).select("entity_id", "entity_type", "name", F.col("entity_type").alias("layer"), none.alias("description"), none.alias("body"))
    return dictionary.vault(nodes, A.edges(s, d)).select("path", F.md5("text").alias("text_md5"))

"""Queries of the scalar text functions (X rows) and of filters (F rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ontology
from ..functions import text as X
from ..operators.understanding import understand
from . import adapters as A
from .registry import query

E = A.SQL_ENTITIES
_W = A.SQL_WORDS.format
_sorted = lambda a: F.md5(F.array_join(F.array_sort(a), " "))
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def T():  # noqa: N802
    return F.col("text")


def docs(s, d):
    return A.table(s, d, "documents")


@query("x1_word_set", f"SELECT doc_id, len(list_distinct(w))::INT AS n, md5(array_to_string(list_sort(list_distinct(w)), ' ')) AS h FROM (SELECT doc_id, {_W('text')} AS w FROM documents)")
def x1(s, d):
    return docs(s, d).select("doc_id", X.word_set(T()).alias("w")).select("doc_id", F.size("w").alias("n"), _sorted(F.col("w")).alias("h"))


@query("x2_content_words", f"""SELECT doc_id, md5(array_to_string(list_sort(list_filter(list_distinct(w), lambda x: NOT list_contains({_list(ontology.QUESTION_STOPS)}, x))), ' ')) AS h,
 len(list_filter(w, lambda x: NOT list_contains({_list(ontology.KEYWORD_STOPS)}, x) AND length(x) > 1))::INT AS n_keywords FROM (SELECT doc_id, {_W('text')} AS w FROM documents)""")
def x2(s, d):
    return docs(s, d).select("doc_id", _sorted(X.content_words(T(), ontology.QUESTION_STOPS)).alias("h"), F.size(X.keywords(T())).alias("n_keywords"))


_PAIRS = f"""p AS (SELECT a.item_id AS a, list_distinct({_W('a.text')}) AS x, list_distinct({_W('b.text')}) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"""


def _neighbours(s, d):
    b = A.table(s, d, "benchmark").select("item_id", X.word_set(T()).alias("x"))
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y")), "item_id").select(F.col("item_id").alias("a"), "x", "y")


@query("x3_jaccard", f"WITH {_PAIRS} SELECT a, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS j FROM p")
def x3(s, d):
    return _neighbours(s, d).select("a", F.round(X.jaccard(F.col("x"), F.col("y")), 6).alias("j"))


@query("x4_overlap", f"WITH {_PAIRS}, q AS (SELECT a, list_filter(x, lambda w: length(w) >= 5) AS x, list_filter(y, lambda w: length(w) >= 5) AS y FROM p) SELECT a, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) END::DOUBLE AS o FROM q")
def x4(s, d):
    return _neighbours(s, d).select("a", F.round(X.overlap(F.col("x"), F.col("y")), 6).alias("o"))


@query("x5_est_tokens", "SELECT doc_id, (length(coalesce(text, '')) // 4)::BIGINT AS n FROM documents")
def x5(s, d):
    return docs(s, d).select("doc_id", X.est_tokens(T()).alias("n"))


@query("x6_fit_to_window", "SELECT doc_id, md5(CASE WHEN 1000 + length(text) // 4 + 2000 <= 8000 - 1000 THEN text ELSE substr(text, 1, 4000 * 4) || chr(10) || chr(10) || '[truncated]' END) AS h FROM documents")
def x6(s, d):
    return docs(s, d).select("doc_id", F.md5(X.fit_to_window(T(), 1000, 8000, 1000)).alias("h"))


@query("x7_content_hash", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM documents")
def x7(s, d):
    return docs(s, d).select("doc_id", X.content_hash(T()).alias("h"))


@query("x8_file_hash", "SELECT doc_id, md5(text) AS h FROM documents")
def x8(s, d):
    return docs(s, d).select("doc_id", F.md5("text").alias("h"))


@query("x9_doc_preview", r"WITH l AS (SELECT doc_id, string_split('# Doc ' || doc_id || chr(10) || text, chr(10)) AS ls FROM documents) SELECT doc_id, substr(trim(list_filter(ls, lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '---') AND length(trim(x)) > 20)[1]), 1, 500) AS body, array_to_string(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^#{1,3}\s+\S')), lambda x: regexp_replace(x, '^#{1,3}\s+', ''))[1:10], ' | ') AS heads FROM l")
def x9(s, d):
    heads, body = X.preview(F.concat(F.lit("# Doc "), F.col("doc_id"), F.lit("\n"), T()))
    return docs(s, d).select("doc_id", body.alias("body"), heads.alias("heads"))


@query("x10_open_questions", "SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 5))::INT AS n FROM documents")
def x10(s, d):
    body = F.concat(F.lit("# A\n## Open Questions\n- "), F.regexp_replace(T(), "\n", "\n- "), F.lit("\n## End\n- none of these"))
    return docs(s, d).select("doc_id", F.size(X.open_questions(body)).alias("n"))


@query("x11_overview")
def x11(s, d):
    return docs(s, d).select("doc_id", X.overview(T()).alias("overview"))


@query("x12_embedding_text", f"WITH {E} SELECT entity_id, md5(array_to_string(list_filter([name, entity_type, description, 'owned_by t1', trim(replace(substr(body, 1, 150), '#', ''))], lambda p: coalesce(p, '') <> ''), ' | ')) AS h FROM ent")
def x12(s, d):
    t = X.embedding_text(F.col("name"), F.col("entity_type"), F.col("description"), F.array(F.lit("owned_by t1")), F.col("body"))
    return A.entities(s, d).select("entity_id", F.md5(t).alias("h"))


@query("x13_triple_text", f"WITH {A.SQL_EDGES}, {A.SQL_NODES} SELECT source_id, target_id, a.name || ' ' || rel_type || ' ' || b.name AS t FROM edg JOIN nod a ON source_id = a.entity_id JOIN nod b ON target_id = b.entity_id")
def x13(s, d):
    n = A.nodes(s, d).select("entity_id", "name")
    e = A.edges(s, d).join(n.select(F.col("entity_id").alias("source_id"), F.col("name").alias("a")), "source_id").join(n.select(F.col("entity_id").alias("target_id"), F.col("name").alias("b")), "target_id")
    return e.select("source_id", "target_id", F.concat_ws(" ", "a", "rel_type", "b").alias("t"))


#: English questions over the documents' words: what SURVEY calls a question is invented prose here, so heads are put before it
_HEADS = ["What is", "How does the workflow of", "Who owns", "List all gaps of", "Compare", "When was the change of", ""]
_HEAD = "[" + ", ".join(f"'{h} '" for h in _HEADS) + "][1 + item_id % 7] || lower(substr(text, 1, 60))"


def asked(s, d):
    head = F.get(F.array(*[F.lit(h + " ") for h in _HEADS]), F.pmod("item_id", F.lit(7)).cast("int"))
    return A.table(s, d, "benchmark").select("item_id", F.concat(head, F.lower(F.substring("text", 1, 60))).alias("question"))


def intent_ctes() -> str:
    """CTE ic: item_id, w_<intent>, l_<layer>, dominant, is_listing, is_comparison, keywords"""
    cols = []
    for i, ps in ontology.INTENTS.items():
        n = " + ".join(f"regexp_matches(q, '{p}')::INT" for p in ps)
        cols.append(f"CASE WHEN {n} > 0 THEN least(1.0, 0.6 + 0.15 * ({n} - 1)) END AS w_{i}")
    names = [f"w_{i}" for i in ontology.INTENTS]
    out = ["CASE WHEN coalesce(" + ", ".join(names) + ") IS NULL THEN 0.3 ELSE w_entity END AS w_entity", *names[1:]]
    tops = ", ".join(f"coalesce({n}, 0)" for n in names)
    layers = []
    for layer in ontology.LAYERS:
        b = [f"1 + {x[layer] - 1:.1f} * coalesce(w_{i} / top, 0)" for i, x in ontology.INTENT_LAYERS.items() if layer in x]
        layers.append(f"round(greatest(1.0, {', '.join(b)}), 6)::DOUBLE AS l_{layer}" if b else f"1.0::DOUBLE AS l_{layer}")
    kept = ", ".join(f"round({n}, 6)::DOUBLE AS {n}" for n in names)
    dominant = "CASE " + " ".join(f"WHEN w_{i} = top THEN '{i}'" for i in ontology.INTENTS) + " END AS dominant"
    stops = "[" + ", ".join(f"'{w}'" for w in ontology.KEYWORD_STOPS) + "]"
    keywords = f"array_to_string(list_filter({A.SQL_WORDS.format('q')}, lambda w: NOT list_contains({stops}, w) AND length(w) > 1), ',') AS keywords"
    return f"""iq AS (SELECT item_id, lower({_HEAD}) AS q FROM benchmark),
ia AS (SELECT item_id, q, {', '.join(cols)} FROM iq),
ib AS (SELECT item_id, q, {', '.join(out)} FROM ia),
it AS (SELECT *, greatest({tops}) AS top FROM ib),
ic AS (SELECT item_id, {kept}, {', '.join(layers)}, {dominant}, w_listing IS NOT NULL AS is_listing, w_comparison IS NOT NULL AS is_comparison, {keywords} FROM it)"""


_EDGES = "CASE dominant " + " ".join(f"WHEN '{i}' THEN '{','.join(e)}'" for i, e in ontology.INTENT_EDGES.items()) + " END AS edge_types"


@query("x14_classify_queries", f"WITH {intent_ctes()} SELECT *, {_EDGES} FROM ic")
def x14(s, d):
    rows = understand(asked(s, d))
    numbers = [F.round(c, 6).cast("double").alias(c) for c in rows.columns if c[:2] in ("w_", "l_")]
    return rows.select("item_id", *numbers, "dominant", "is_listing", "is_comparison", F.array_join("keywords", ",").alias("keywords"), F.array_join("edge_types", ",").alias("edge_types"))


@query("x15_citations", r"SELECT doc_id, array_to_string(regexp_extract_all('see [doc ' || doc_id || '] and [' || lang || '] ' || text, '\[([^\]]+)\]', 1), '|') AS c FROM documents")
def x15(s, d):
    answer = F.concat(F.lit("see [doc "), F.col("doc_id"), F.lit("] and ["), F.col("lang"), F.lit("] "), T())
    return docs(s, d).select("doc_id", F.array_join(X.citations(answer), "|").alias("c"))


@query("x16_link_mentions", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: NOT starts_with(x, '#') AND NOT contains(x, '[[') AND regexp_matches(x, '\bthat\b')), true) AS k FROM l)
SELECT doc_id, md5(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = k THEN regexp_replace(x, '\bthat\b', '[[that]]') ELSE x END), chr(10))) AS h FROM p""")
def x16(s, d):
    """One name here; link_mentions() takes any list."""
    from ..functions.vectorized import link_mentions

    return docs(s, d).select("doc_id", F.md5(link_mentions(["that"])(T())).alias("h"))


@query("x17_answer_score", r"""WITH a AS (SELECT doc_id, upper(text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Score: ANSWERABLE' WHEN 1 THEN chr(10) || 'PARTIAL' || chr(10) || '.' WHEN 2 THEN chr(10) || 'Partial' || chr(10) || 'NOT_ANSWERABLE' ELSE '' END) AS a FROM documents),
v AS (SELECT doc_id, coalesce(list_filter(list_transform(list_reverse(string_split(a, chr(10)))[1:5], lambda x: CASE WHEN contains(x, 'NOT_ANSWERABLE') THEN 'not_answerable' WHEN contains(x, 'PARTIAL') THEN 'partial' WHEN contains(x, 'ANSWERABLE') THEN 'answerable' END), lambda x: x IS NOT NULL)[1], 'not_answerable') AS score FROM a)
SELECT doc_id, score, CASE score WHEN 'answerable' THEN 'CLEAN' WHEN 'partial' THEN 'INCOMPLETE' ELSE 'MISSING' END AS cls FROM v""")
def x17(s, d):
    tail = F.get(F.array(*map(F.lit, ("\nScore: ANSWERABLE", "\nPARTIAL\n.", "\nPartial\nNOT_ANSWERABLE", ""))), F.pmod("doc_id", F.lit(4)).cast("int"))
    score = X.answer_score(F.concat(T(), tail))
    return docs(s, d).select("doc_id", score.alias("score"), X.ddc_class(score).alias("cls"))


@query("x18_extract_json", "SELECT event_id, props AS j FROM events")
def x18(s, d):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```\n"))).otherwise(F.concat(F.lit("x "), "props", F.lit(" y")))
    return A.table(s, d, "events").select("event_id", X.extract_json(wrapped).alias("j"))


@query("x20_salvage", f"WITH {E} SELECT entity_id, least(1.0, greatest(0.0, coalesce(confidence * 2 - 0.7, 0.5))) AS confidence, CASE WHEN confidence * 2 - 0.7 BETWEEN 0 AND 1 THEN '' ELSE 'needs-review' END AS tags FROM ent")
def x20(s, d):
    raw = F.col("confidence") * 2 - 0.7
    return A.entities(s, d).select("entity_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(raw, F.lit(0.5)))).alias("confidence"), F.when((raw >= 0) & (raw <= 1), "").otherwise("needs-review").alias("tags"))


@query("x21_layer_icon", f"WITH {E} SELECT entity_id, layer, upper(CASE WHEN len(string_split(entity_type, '-')) = 1 THEN substr(entity_type, 1, 2) ELSE substr(array_to_string(list_transform(string_split(entity_type, '-'), lambda p: substr(p, 1, 1)), ''), 1, 3) END) AS icon FROM ent")
def x21(s, d):
    return A.entities(s, d).select("entity_id", "layer", X.icon(F.col("entity_type")).alias("icon"))


@query("x22_confidence_tier", f"WITH {E} SELECT CASE WHEN confidence >= 0.85 THEN 'solid' WHEN confidence >= 0.55 THEN 'muted' ELSE 'sketched' END AS tier, count(*) AS n FROM ent GROUP BY 1")
def x22(s, d):
    return A.entities(s, d).groupBy(X.confidence_tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query("x23_stamp", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created_at, '2026-01-01' AS updated_at, 'import' AS updated_by FROM orders")
def x23(s, d):
    created = F.coalesce(F.regexp_extract(F.concat(F.lit("created_at: "), F.date_format("o_orderdate", "yyyy-MM-dd")), r"created_at: (\S+)", 1), F.lit("2026-01-01"))
    return A.table(s, d, "orders").select("o_orderkey", created.alias("created_at"), F.lit("2026-01-01").alias("updated_at"), F.lit("import").alias("updated_by"))


@query("x24_slug", "SELECT doc_id, regexp_replace(substr(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g') AS slug FROM documents")
def x24(s, d):
    return docs(s, d).select("doc_id", X.slug(T()).alias("slug"))


@query("x25_is_kebab", "SELECT p_partkey, regexp_matches(replace(lower(p_name), ' ', '-'), '^[a-z0-9]+(-[a-z0-9]+)*$') AS a, regexp_matches(p_name, '^[a-z0-9]+(-[a-z0-9]+)*$') AS b FROM part")
def x25(s, d):
    return A.table(s, d, "part").select("p_partkey", X.is_kebab(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))).alias("a"), X.is_kebab(F.col("p_name")).alias("b"))


@query("x26_parse_args")
def x26(s, d):
    return A.events(s, d).select("id", F.size(F.map_keys(F.coalesce(F.from_json("args", "map<string,string>"), F.create_map().cast("map<string,string>")))).alias("n_args"))


@query("x27_hedged_sentences", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text || ' likely so.', '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(lower(s), '\b(maybe|likely|probably|seems|appears to|could be)\b')))::INT AS n FROM documents")
def x27(s, d):
    return docs(s, d).select("doc_id", F.size(X.hedged(F.concat(T(), F.lit(" likely so.")))).alias("n"))


@query("x29_clean_body", "SELECT doc_id, md5(trim(string_split(text || chr(10) || '## Open Questions', chr(10) || '## Open Questions')[1])) AS h FROM documents")
def x29(s, d):
    body = F.concat(F.lit("# N"), F.col("doc_id"), F.lit("\n"), T(), F.lit("\n## Open Questions\n- why"))
    return docs(s, d).select("doc_id", F.md5(X.clean_body(body, F.concat(F.lit("N"), F.col("doc_id")))).alias("h"))


@query("f1_validate", f"WITH {E} SELECT entity_id, (name = '')::INT + (confidence < 0.4)::INT + (NOT regexp_matches(entity_type, '^[a-z0-9]+(-[a-z0-9]+)*$'))::INT AS n_errors FROM ent")
def f1(s, d):
    from ..operators.coverage import validation_errors

    return A.entities(s, d).select("entity_id", F.size(validation_errors(least_confidence=0.4)).alias("n_errors"))


@query("f2_filter_entities", f"WITH {E} SELECT entity_id FROM ent WHERE layer IN ('structural', 'language') AND confidence >= 0.5 AND contains(lower(name), 'the')")
def f2(s, d):
    return A.entities(s, d).where(F.col("layer").isin("structural", "language") & (F.col("confidence") >= 0.5) & F.lower("name").contains("the")).select("entity_id")


@query("f3_browse", f"WITH {E} SELECT entity_id, confidence FROM ent WHERE entity_type = 'api' AND contains(lower(description), 'a') ORDER BY confidence DESC, entity_id")
def f3(s, d):
    return A.entities(s, d).where((F.col("entity_type") == "api") & F.lower("description").contains("a")).select("entity_id", "confidence").orderBy(F.desc("confidence"), "entity_id")


@query("f4_filter_results", f"WITH {A.SQL_EVAL} SELECT qid FROM evl WHERE ddc_class = 'MISSING' AND source = 'src3'")
def f4(s, d):
    return A.eval_results(s, d).where("ddc_class = 'MISSING' and source = 'src3'").select("qid")


@query("f5_by_persona", f"WITH {A.SQL_EVAL} SELECT qid FROM evl WHERE lower(source) = 'developer' OR lower(persona) = 'developer'")
def f5(s, d):
    return A.eval_results(s, d).where((F.lower("source") == "developer") | (F.lower("persona") == "developer")).select("qid")


@query("f6_review_queue", f"WITH {E} SELECT entity_id FROM ent WHERE confidence < 0.4")
def f6(s, d):
    return A.entities(s, d).withColumn("tags", F.when(F.col("confidence") < 0.4, F.array(F.lit("needs-review"))).otherwise(F.array())).where(F.array_contains("tags", "needs-review")).select("entity_id")


@query("f7_split_tiny", "SELECT doc_id, length(text) // 4 < 20 AS tiny FROM documents")
def f7(s, d):
    return docs(s, d).select("doc_id", (X.est_tokens(T()) < 20).alias("tiny"))


@query("f8_resolve_source", f"WITH {E} SELECT entity_id FROM ent WHERE lang = 'en' AND list_has_any(list_distinct({_W('name')}), ['the', 'of'])")
def f8(s, d):
    return A.entities(s, d).where((F.col("lang") == "en") & F.arrays_overlap(X.word_set(F.col("name")), F.array(F.lit("the"), F.lit("of")))).select("entity_id")


@query("f9_traces", f"WITH {A.SQL_CALLS} SELECT effort_id, seq FROM cal WHERE tool = 'user' ORDER BY effort_id DESC, seq DESC LIMIT 50")
def f9(s, d):
    return A.calls(s, d).where("tool = 'user'").orderBy(F.desc("effort_id"), F.desc("seq")).limit(50).select("effort_id", "seq")


@query("f10_events", f"WITH {A.SQL_EVENTS} SELECT id, action FROM evt ORDER BY id DESC LIMIT 100")
def f10(s, d):
    return A.events(s, d).orderBy(F.desc("id")).limit(100).select("id", "action")

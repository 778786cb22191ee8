"""Extraction JSON and entity files as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..ontology import STATUSES, TYPES

# Fields that an entity file must have, and all standard ones.
REQUIRED = ["type", "id", "name", "description"]
STANDARD = ["type", "id", "name", "description", "status", "confidence", "source_documents", "tags"]

_RELATION = "struct<type: string, relationship_type: string, target: string, target_id: string, target_entity_id: string, target_name: string, target_entity_name: string, reasoning: string, description: string>"
_ENTITY = f"struct<type: string, entity_type: string, id: string, name: string, description: string, overview: string, details: string, confidence: double, relationships: array<{_RELATION}>>"
_DECISION = "struct<subject: string, topic: string, entity_id: string, entity: string, name: string, concept: string, decision: string, entity_type: string, classification: string, action: string, reasoning: string, reason: string, explanation: string, rationale: string>"


def normalize_extraction(json: Column) -> Column:
    """One struct from a JSON object whose fields may have other names; entities and decisions that are no objects fall
    out; descriptions come from the overview's first sentence, else from the name."""
    top = F.from_json(json, "document_summary string, summary string, source_document string, source string, entities array<string>, decision_log array<string>")
    objects = lambda c, kind: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.startswith(F.ltrim(x), F.lit("{"))), lambda x: F.from_json(x, kind))
    relation = lambda r: F.struct(
        F.coalesce(r["relationship_type"], r["type"]).alias("relationship_type"),
        F.coalesce(r["target_entity_id"], r["target"], r["target_id"]).alias("target_entity_id"),
        F.coalesce(r["target_entity_name"], r["target_name"], r["target_entity_id"], r["target"], r["target_id"], F.lit("")).alias("target_entity_name"),
        F.coalesce(r["reasoning"], r["description"], F.lit("")).alias("reasoning"),
    )
    first = lambda e: F.when(F.coalesce(e["overview"], F.lit("")) != "", F.substring(F.trim(F.split_part(e["overview"], F.lit("."), F.lit(1))), 1, 200))
    entity = lambda e: F.struct(
        F.coalesce(e["entity_type"], e["type"]).alias("entity_type"), e["id"].alias("id"), e["name"].alias("name"),
        F.coalesce(e["description"], first(e), e["name"], F.lit("No description")).alias("description"), e["overview"].alias("overview"), e["details"].alias("details"), e["confidence"].alias("confidence"),
        F.transform(F.coalesce(e["relationships"], F.array().cast(f"array<{_RELATION}>")), relation).alias("relationships"),
    )
    decision = lambda x: F.struct(
        F.coalesce(*[x[c] for c in ("subject", "topic", "entity_id", "entity", "name", "concept")], F.lit("unknown")).alias("subject"),
        F.coalesce(*[x[c] for c in ("decision", "entity_type", "classification", "action")], F.lit("")).alias("decision"),
        F.coalesce(*[x[c] for c in ("reasoning", "reason", "explanation", "rationale")], F.lit("")).alias("reasoning"),
    )
    return F.struct(
        F.coalesce(top["document_summary"], top["summary"]).alias("document_summary"), F.coalesce(top["source_document"], top["source"]).alias("source_document"),
        F.transform(objects(top["entities"], _ENTITY), entity).alias("entities"), F.transform(objects(top["decision_log"], _DECISION), decision).alias("decision_log"),
    )


def validate(files: DataFrame, relationship_fields: list[str], types: list[str] = TYPES) -> DataFrame:
    """``files`` (fields map<string, string>, null if there is no front matter; expected_id, may be null) plus valid,
    errors array<struct<field, message>> and warnings array<string> (keys that are neither standard nor relationships)."""
    get = lambda k: F.try_element_at("fields", F.lit(k))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = lambda cond, field, message: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
    has = F.col("fields").isNotNull()
    found = [error(~has, "frontmatter", "missing or invalid")]
    found += [error(has & empty(get(k)), k, "missing or empty") for k in REQUIRED]
    found += [
        error(~empty(get("type")) & ~get("type").isin(*types), "type", "unknown type"),
        error(~empty(get("id")) & ~X.is_kebab(get("id")), "id", "not kebab-case"),
        error(~empty(get("id")) & (get("id") != F.col("expected_id")), "id", "not the expected id"),
        error(~empty(get("status")) & ~get("status").isin(*STATUSES), "status", "unknown status"),
    ]
    errors = F.filter(F.array(*found), lambda x: x.isNotNull())
    known = F.array(*map(F.lit, [*STANDARD, *relationship_fields]))
    rows = files.withColumn("errors", errors).withColumn("warnings", F.array_sort(F.array_except(F.coalesce(F.map_keys("fields"), F.array().cast("array<string>")), known)))
    return rows.withColumn("valid", F.size("errors") == 0)

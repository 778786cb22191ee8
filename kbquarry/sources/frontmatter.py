"""Entity pages: front matter as a mapping (S3) and its relationships."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ontology import RELATION_KEYS

PARSED = "front string, texts map<string, array<string>>, confidence double"


def _parsed(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text: str | None) -> tuple:
        try:
            found = yaml.load(text, loader) if text else None
            if not isinstance(found, dict) or not found:
                return None, None, None
            texts = {}
            for key, value in found.items():
                values = value if isinstance(value, list) else [value]
                texts[str(key)] = [v for v in values if isinstance(v, str) and v]
            number = found.get("confidence")
            number = float(number) if isinstance(number, (int, float)) else None
            return json.dumps({str(k): v for k, v in found.items()}, default=str, ensure_ascii=False), texts, number
        except (yaml.YAMLError, ValueError, TypeError, RecursionError):
            return None, None, None

    for texts in pages:
        yield pd.DataFrame([one(t) for t in texts], columns=["front", "texts", "confidence"])


def parse_pages(pages: DataFrame, text: str = "value") -> DataFrame:
    """S3: ``pages`` without ``text``, plus front (JSON of the mapping), texts (map<string, array<string>>: of each key its non-empty
    strings, a scalar as a list of one), confidence (0.5 where it is no number) and body.  Front matter stands between the
    first two ``---``; quoted, nested, block and flow values are read as YAML, in Arrow batches.

    Defined cases: pages without two ``---`` and pages whose front matter is empty, no mapping or can't be read are dropped;
    null pages too; of a repeated key the last counts; numbers and dates aren't strings, so they name no relationship."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    parts = F.split(F.col(text), "---", 3)
    rows = pages.withColumn("_parts", parts).where(F.size("_parts") == 3)
    # not in the select below: an Arrow function that stands twice in a plan would run twice
    parse = F.pandas_udf(_parsed, PARSED)
    rows = rows.withColumn("_p", parse(F.btrim(F.col("_parts")[1], blanks))).where("_p.front is not null")
    kept = [c for c in pages.columns if c != text]
    return rows.select(*kept, "_p.front", "_p.texts", F.coalesce("_p.confidence", F.lit(0.5)).alias("confidence"), F.btrim(F.col("_parts")[2], blanks).alias("body"))


def field(name: str, default: Column) -> Column:
    """A top-level value of ``front`` as text"""
    return F.coalesce(F.get_json_object("front", f"$.{name}"), default)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """S3 from files: path, entity_id and name (the file's stem where the page has none), entity_type (else its folder),
    description, source_documents, and parse_pages()' columns"""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    stem, folder = F.regexp_extract("path", r"([^/]+)\.md$", 1), F.element_at(F.split("path", "/"), -2)
    rows = parse_pages(raw)
    listed = F.when(F.get_json_object("front", "$.source_documents").startswith("["), F.col("texts")["source_documents"])
    columns = {"entity_id": field("id", stem), "name": field("name", stem), "entity_type": field("type", folder), "description": field("description", F.lit("")), "source_documents": F.coalesce(listed, F.array().cast("array<string>"))}
    return rows.withColumns(columns)


def frontmatter_edges(entities: DataFrame, keys: list[str] = RELATION_KEYS) -> DataFrame:
    """``entities`` (entity_id, texts) -> source_id, rel_type, pos, target_id: an edge for each non-empty string, alone or in a
    list, under a key that the ontology declares"""
    declared = F.map_filter("texts", lambda k, v: k.isin(*keys))
    rows = entities.select(F.col("entity_id").alias("source_id"), F.explode(declared).alias("rel_type", "targets"))
    return rows.select("source_id", "rel_type", F.posexplode("targets").alias("pos", "target_id"))

"""Files in and out (S rows): document trees, work items, questions, results, logs, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectorized import html_to_text

#: White space of all kinds, for btrim(), which else takes blanks only.
SPACES = " \t\n\x0b\x0c\r"
RESULT = (
    "question string, source string, source_file string, layer_hint string, topic string, persona string, score string, ddc_class string, answer string, citations array<string>, "
    "entities_retrieved int, total_ms long, trace_summary string, hops array<struct<entity_id: string, entity_name: string, hop_number: int, fused_score: double>>, gaps array<struct<gap_type: string, entity_id: string, description: string>>"
)


def trimmed(text: Column, end: int = 10_000) -> Column:
    """``text`` without SPACES at both ends.  A trim of several characters at the right makes two whole numbers for every byte,
    so only the last ``end`` characters are trimmed, unless all of these are spaces."""
    left = F.ltrim(text, F.lit(SPACES))
    last = F.right(left, F.lit(end))
    kept = F.rtrim(last, F.lit(SPACES))
    cut = F.length(left) - F.length(last) + F.length(kept)
    return F.when(F.length(last) == F.length(kept), left).when(kept == "", F.rtrim(left, F.lit(SPACES))).otherwise(F.substring(left, F.lit(1), cut))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Markdown, text and HTML files below ``path``; dot-files and empty ones are left out.  Only HTML goes through Python."""

    def read(kinds: str) -> DataFrame:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{kinds}}}").load(path)
        text = F.col("content").cast("string")
        text = F.when(F.is_valid_utf8(text), text).otherwise(F.decode("content", "ISO-8859-1"))
        name = F.element_at(F.split("path", "/"), -1)
        rows = raw.select(name.alias("filename"), F.col("path").alias("filepath"), text.alias("raw"), F.regexp_extract(name, r"\.(\w+)$", 1).alias("file_type"), F.col("length").alias("size_bytes"))
        return rows.where(~F.col("filename").startswith("."))

    plain, html = read("md,txt").withColumnRenamed("raw", "content"), read("html,htm").withColumn("content", html_to_text("raw")).drop("raw")
    rows = plain.unionByName(html)
    return rows.withColumn("content", trimmed(F.col("content"))).where("content <> ''").select("filename", "filepath", "file_type", "size_bytes", "content")


def read_extractions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, bad files left out"""
    return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def write_entities(entities: DataFrame, path: str) -> None:
    """S6"""
    entities.repartition("entity_type").write.mode("overwrite").partitionBy("entity_type").parquet(path)


def render_markdown() -> Column:
    """Over entity_type, name and body"""
    return F.concat(F.lit("---\ntype: "), F.col("entity_type"), F.lit("\n---\n# "), F.col("name"), F.lit("\n"), F.col("body"))


def read_work_items(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """S9"""
    raw = spark.read.option("pathGlobFilter", "*.{md,txt}").option("recursiveFileLookup", True).text(path, wholetext=True).select(F.btrim("value", F.lit(SPACES)).alias("t"), F.col("_metadata.file_name").alias("f")).where("t <> ''")
    topic = F.substring(F.trim(F.regexp_replace(F.split("t", "\n")[0], "#", "")), 1, 50)
    text = F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("\n[truncated]"))).otherwise(F.col("t"))
    return raw.select(text.alias("question"), F.lit("work-item").alias("source"), F.regexp_replace("f", r"\.\w+$", "").alias("source_file"), topic.alias("topic"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """S10"""
    rows = spark.read.schema("question string, source string, source_file string, layer_hint string, topic string, persona string").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.where("question is not null").withColumn("source", F.coalesce("source", F.lit("curated")))


def read_eval_runs(spark: SparkSession, path: str) -> DataFrame:
    """Every eval-results*.json below ``path``, labelled by its name"""
    rows = spark.read.schema(RESULT).option("multiLine", True).json(f"{path}/eval-results*.json").withColumn("run_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    label = F.initcap(F.trim(F.regexp_replace(F.regexp_replace("run_id", "^eval-results", ""), "[-_]+", " ")))
    return rows.where("question is not null").withColumn("label", F.when(label == "", "Latest").otherwise(label))


def write_eval_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Summaries clipped at 500"""
    events.withColumn("summary", F.substring("summary", 1, 500)).withColumn("date", F.to_date("at")).write.mode("append").partitionBy("date").parquet(path)

"""Files in and out, and the gaps of hops."""

from pyspark.sql import functions as F

from kbquarry.operators import gaps
from kbquarry.sources import files, frontmatter
from kbquarry.streaming.tables import KeyedTable
from kbquarry.streaming import jobs


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_documents_are_read_as_text(spark, tmp_path):
    put(tmp_path / "a.md", " one ")
    put(tmp_path / "sub/b.txt", "caf\u00e9", "latin-1")
    put(tmp_path / "c.html", "<html><body><p>three</p><script>x()</script></body></html>")
    put(tmp_path / "empty.md", "  ")
    put(tmp_path / "d.pdf", "four")
    got = {r["filename"]: r["content"] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "one", "b.txt": "caf\u00e9", "c.html": "three"}


def test_entity_pages_need_front_matter(spark, tmp_path):
    put(tmp_path / "x.md", "---\ntype: system\nname: Ledger\n---\nBody of it\n")
    put(tmp_path / "y.md", "no front matter")
    (row,) = frontmatter.read_entities(spark, str(tmp_path)).collect()
    assert row["texts"] == {"type": ["system"], "name": ["Ledger"]} and row["body"] == "Body of it"


def test_bad_extractions_are_left_out(spark, tmp_path):
    put(tmp_path / "a.json", '{"source_document": "a", "n": 1}')
    put(tmp_path / "b.json", '{"source_document": ')
    assert [r[0] for r in files.read_extractions(spark, str(tmp_path), "source_document string, n long").collect()] == ["a"]


def test_work_items_questions_and_runs(spark, tmp_path):
    put(tmp_path / "w/i-1.md", "# Gateway slow\n" + "y" * 3000)
    (item,) = files.read_work_items(spark, str(tmp_path / "w")).collect()
    assert (item["topic"], item["source_file"]) == ("Gateway slow", "i-1") and item["question"].endswith("[truncated]")
    put(tmp_path / "q.json", '[{"question": "why"}, {"source": "seed"}]')
    assert [(r["question"], r["source"]) for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()] == [("why", "curated")]
    put(tmp_path / "r/eval-results.json", '[{"question": "a", "ddc_class": "CLEAN"}]')
    put(tmp_path / "r/eval-results-june-run.json", '[{"question": "b"}]')
    assert {(r["question"], r["label"]) for r in files.read_eval_runs(spark, str(tmp_path / "r")).collect()} == {("a", "Latest"), ("b", "June Run")}


def test_ambiguous_and_broken(spark):
    rows = [(1, 10, "Claims Gateway Service", 0.9), (1, 11, "claims gateway service two", 0.8), (1, 12, "Other", 0.9), (2, 13, "Claims Gateway Service", 0.9), (1, 14, "claims gateway service", 0.6)]
    hops = spark.createDataFrame(rows, "qid long, entity_id long, name string, score double")
    assert [tuple(r) for r in gaps.ambiguous_gaps(hops).collect()] == [(1, 10, 11)]
    reached = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "qid long, entity_id long, hop int")
    known = spark.createDataFrame([(10, None), (11, " "), (12, "text")], "entity_id long, description string")
    assert [r["entity_id"] for r in gaps.broken_relationship_gaps(reached, known).collect()] == [11]


def test_batches_fold_to_the_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k % 3, 1, k) for k in range(20)], "k long, n long, last long")
    for i in range(3):
        rows.where(F.col("last") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    table = jobs.keyed_available(stream, KeyedTable(spark, ["k"], rows.schema, fold, f"file://{tmp_path}/table"), mode="append")
    assert sorted(map(tuple, table.read().collect())) == [(0, 7, 18), (1, 7, 19), (2, 6, 17)]


def test_trimmed_equals_a_trim_of_both_ends(spark):
    texts = ["", " \n", "a", " a b \t\n", "\r\x0b\x0cé  ü" + " " * 9, "x" + "\n" * 7, "\n" * 7 + "x", " ab", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for end in (1, 3, 100):
        got = df.select(F.btrim("t", F.lit(files.SPACES)).alias("a"), files.trimmed(F.col("t"), end).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]


def test_plain_files_stay_out_of_python(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" plain <b>text</b>\n")
    (tmp_path / "b.html").write_text("<p>marked</p>")
    found = files.read_documents(spark, str(tmp_path))
    assert sorted((r["filename"], r["content"], r["file_type"]) for r in found.collect()) == [("a.txt", "plain <b>text</b>", "txt"), ("b.html", "marked", "html")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Relation") < plan.index("ArrowEvalPython")

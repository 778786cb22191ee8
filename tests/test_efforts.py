"""Roll-up of efforts from facts (N3): against the stream with timers, against all rows at once, and without Python an effort."""

import random

from pyspark.sql import functions as F

from kbquarry.streaming import efforts, jobs, tables

from .test_depth import EVENT, minutes, stream_of


def batches(n, efforts_, rng):
    """Times climb by 90 minutes a batch, and some rows are late; no two rows of an effort have one time"""
    kinds, at, out = ["open", "call", "call", "call", "end"], list(range(600)), []
    rng.shuffle(at)
    for b in range(n):
        rows = []
        for i in range(40):
            when = 90 * b + (at.pop() % 90) - (rng.choice([0, 0, 0, 150, 240]))
            rows.append((b * 100 + i, minutes(when + i / 100 + b / 1000), f"e{rng.randrange(efforts_)}", rng.choice(kinds), rng.random() < 0.4, rng.choice(["resolved", None, "early"]), "x", "y"))
        out.append(rows)
    return out


def test_table_of_efforts_equals_the_stream_with_timers(spark, tmp_path):
    parts = batches(4, 60, random.Random(7))
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    table = jobs.effort_table(stream_of(spark, tmp_path / "a", parts), f"file://{tmp_path}/a/state", idle_minutes=30)
    live = efforts.effort_rollup(stream_of(spark, tmp_path / "b", parts), idle_minutes=30)
    kept = tables.KeyedTable(spark, ["effort_id"], efforts.ROLLUP, tables.latest(["effort_id"], "n_updates"), f"file://{tmp_path}/b/state")
    want = jobs.keyed_available(live, kept).read()
    got, want = (sorted(map(tuple, df.select(*table.columns).collect()), key=repr) for df in (table, want))
    assert got == want and {"timeout", None} < {r[5] for r in got}
    assert sum(r[3] for r in got) < sum(row[3] == "call" for part in parts for row in part)  # some come too late


def test_facts_of_efforts_fold_in_any_split(spark):
    rows = [r for part in batches(3, 9, random.Random(8)) for r in part]
    rows += [(900, minutes(5), "t", "end", False, "b", "x", "y"), (901, minutes(5), "t", "end", False, "a", "x", "y"), (902, None, "n", "end", None, "lost", "x", "y"), (903, None, "n", "call", None, None, "x", "y")]
    df = spark.createDataFrame(rows, EVENT)
    parts = [efforts.effort_facts(df.where(F.col("id") % 3 == k)) for k in range(3)]
    folded = efforts.merge_facts(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    sort = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert sort(folded) == sort(efforts.effort_facts(df))
    out = {r["effort_id"]: r for r in efforts.rolled_up(folded, F.lit(minutes(10_000)), 30).collect()}
    assert (out["t"]["outcome"], out["t"]["ended_at"]) == ("b", minutes(5))
    assert (out["n"]["outcome"], out["n"]["call_count"], out["n"]["gap_count"]) == (None, 1, 0)


def test_table_of_efforts_needs_no_python_an_effort(spark, tmp_path, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def refuse(*a, **k):
        raise AssertionError("a call of Python an effort")

    monkeypatch.setattr(PandasGroupedOpsMixin, "transformWithStateInPandas", refuse)
    rows = [(i, minutes(i % 50), f"e{i % 5_000}", ["open", "call", "end"][i // 5_000], False, "resolved", "x", "y") for i in range(15_000)]
    path = f"file://{tmp_path}/state"
    table = jobs.effort_table(stream_of(spark, tmp_path, [rows]), path)
    assert table.where("call_count = 1 and outcome = 'resolved'").count() == 5_000 == table.count()
    again = jobs.effort_table(stream_of(spark, tmp_path, [[(20_000, minutes(70), "e1", "call", True, None, "x", "y")]]), path)  # goes on where the last one ended
    assert again.count() == 5_000 and tuple(again.where("effort_id = 'e1'").select("call_count", "gap_count", "last_at").first()) == (2, 1, minutes(70))

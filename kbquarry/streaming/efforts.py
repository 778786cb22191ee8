"""Live roll-up of work efforts (N3): open, calls, end, and timeouts for efforts that nobody ends: as facts that batches fold into
a table, or as a stream of changes with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROLLUP = "effort_id string, started_at timestamp, ended_at timestamp, call_count long, gap_count long, outcome string, last_at timestamp, n_updates long"
_STATE = "opened long, first long, ended long, last long, calls long, gaps long, outcome string, n long"
_BLANK = (None, None, None, None, 0, 0, None, 0)
TIMEOUT = "timeout"

FACTS = "effort_id string, opened timestamp, first timestamp, ended struct<at: timestamp, outcome: string>, last timestamp, calls long, gaps long"


def effort_facts(log: DataFrame) -> DataFrame:
    """(effort_id, kind 'open' | 'call' | 'end', at, is_gap, outcome) -> FACTS, a row an effort.  Of several ends the last one counts, of
    those at one time the one with the greatest outcome; an end without a time ends nothing."""
    is_ = lambda k: F.col("kind") == k
    return log.groupBy(F.col("effort_id").cast("string").alias("effort_id")).agg(
        F.min(F.when(is_("open"), F.col("at"))).alias("opened"), F.min("at").alias("first"),
        F.max(F.when(is_("end") & F.col("at").isNotNull(), F.struct("at", "outcome"))).alias("ended"), F.max("at").alias("last"),
        F.count_if(is_("call")).alias("calls"), F.count_if(is_("call") & F.col("is_gap")).alias("gaps"),
    )


def merge_facts(facts: DataFrame) -> DataFrame:
    """FACTS of several batches, in any order, as those of all their rows"""
    return facts.groupBy("effort_id").agg(F.min("opened").alias("opened"), F.min("first").alias("first"), F.max("ended").alias("ended"), F.max("last").alias("last"), F.sum("calls").alias("calls"), F.sum("gaps").alias("gaps"))


def rolled_up(facts: DataFrame, watermark: Column, idle_minutes: int) -> DataFrame:
    """FACTS -> effort_id, started_at, ended_at, call_count, gap_count, outcome, last_at; an effort without an end is ended by a timeout
    at its last call once the watermark is ``idle_minutes`` beyond it"""
    idle = F.col("ended").isNull() & (F.col("last") + F.make_dt_interval(mins=F.lit(idle_minutes)) <= watermark)
    end = F.when(F.col("ended").isNotNull(), F.col("ended.at")).when(idle, F.col("last"))
    outcome = F.when(F.col("ended").isNotNull(), F.col("ended.outcome")).when(idle, TIMEOUT)
    return facts.select("effort_id", F.coalesce("opened", "first").alias("started_at"), end.alias("ended_at"), F.col("calls").alias("call_count"), F.col("gaps").alias("gap_count"), outcome.alias("outcome"), F.col("last").alias("last_at"))


class Effort(StatefulProcessor):
    """One small state an effort.  Times are milliseconds; every change gives the effort's row anew."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("effort", _STATE)

    def _row(self, key: tuple, s: tuple) -> pd.DataFrame:
        opened, first, ended, last, calls, gaps, outcome, n = s
        at = lambda ms: pd.NaT if ms is None else pd.Timestamp(ms, unit="us")
        return pd.DataFrame({"effort_id": [key[0]], "started_at": [at(first if opened is None else opened)], "ended_at": [at(ended)], "call_count": [calls], "gap_count": [gaps], "outcome": [outcome], "last_at": [at(last)], "n_updates": [n]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, first, ended, last, calls, gaps, outcome, n = self.state.get() or _BLANK
        if outcome == TIMEOUT:  # a late call within the watermark opens it again
            ended, outcome = None, None
        low, high = (lambda a, b: b if a is None else min(a, b)), (lambda a, b: b if a is None else max(a, b))
        for batch in rows:
            for kind, us, gap, said in zip(batch["kind"], batch["us"].tolist(), batch["is_gap"], batch["outcome"], strict=True):
                first, last = low(first, us), high(last, us)
                if kind == "open":
                    opened = low(opened, us)
                elif kind == "call":
                    calls, gaps = calls + 1, gaps + bool(gap)
                elif kind == "end" and (ended is None or us >= ended):
                    ended, outcome = us, said
        state = (opened, first, ended, last, calls, gaps, outcome, n + 1)
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended is None:
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        yield self._row(key, state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, first, ended, last, calls, gaps, outcome, n = self.state.get() or _BLANK
        if ended is None and last is not None:
            state = (opened, first, last, last, calls, gaps, TIMEOUT, n + 1)
            self.state.update(state)
            yield self._row(key, state)


def effort_rollup(log: DataFrame, idle_minutes: int = 120, late: str = "1 hour") -> DataFrame:
    """A stream of (effort_id, kind 'open' | 'call' | 'end', at, is_gap, outcome) -> ROLLUP rows in update mode: the last row of
    an effort by n_updates counts.  Calls count until the watermark passes them, also after the end; of several ends
    the last one's outcome stays; an effort without an end is ended by a timeout at its last call once the watermark is
    ``idle_minutes`` beyond it.  For streams that must hand on every change: an effort costs some 14 ms of a task (80 microseconds in effort_table(),
    which folds whole batches).  Needs the state store with timers, which is set for the session here."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.withWatermark("at", late).select(F.col("effort_id").cast("string").alias("effort_id"), "kind", "at", F.unix_micros("at").alias("us"), F.coalesce("is_gap", F.lit(False)).alias("is_gap"), "outcome")
    return rows.groupBy("effort_id").transformWithStateInPandas(Effort(60_000 * idle_minutes), ROLLUP, "Update", "EventTime")

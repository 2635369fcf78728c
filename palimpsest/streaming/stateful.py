"""Streams with state of their own: running quotas and folds of event streams.

Both give what the batch operators give on all rows, however the rows are
split into micro-batches and however often the query is started again.  Rows
wait in the state until the watermark says that none before them can come, so
late rows (within ``late``) take their right place; repeated rows are known by
their id and count once.  State goes when its day, or its run, is over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: Where state is kept: on local disk, with its changes in the checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000

QUOTA_ROWS = "key long, day date, call_id long, at timestamp, used long, allowed boolean, remaining long"
FOLD_ROWS = "run_id long, answer string, n_steps long, n_completed long, n_failed long, state string"


#: Groups that the keys of a day are dealt to: calls of a group are counted together, as one table of numbers.
BUCKETS = 128
_CALL = ["key", "call_id", "no_key", "at_us", "quota", "no_quota", "released"]


class _Quota(StatefulProcessor):
    """Calls of one bucket of keys and one day, counted by key in order of time and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getValueState("calls", "rows binary")

    def _held(self) -> pd.DataFrame:
        raw = bytes(self.calls.get()[0]) if self.calls.exists() else b""
        return pd.DataFrame(np.frombuffer(raw, np.int64).reshape(-1, len(_CALL)), columns=_CALL)

    def _hold(self, calls: pd.DataFrame) -> None:
        self.calls.update((np.ascontiguousarray(calls.to_numpy(np.int64)).tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        both = pd.concat([held, *(pdf.assign(released=0)[_CALL].astype("int64") for pdf in rows)], ignore_index=True)
        both = both[~both.duplicated(_CALL[:3])]
        if len(both) > len(held):
            self._hold(both)
            self.handle.registerTimer(int(both["at_us"].iloc[len(held) :].min()) // 1000 + 1)
            self.handle.registerTimer(self._end(key))
        return iter(())

    @staticmethod
    def _end(key) -> int:
        return int(pd.Timestamp(key[1]).timestamp() * 1000) + DAY_MS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        waits, passed, who = held["released"] == 0, held["at_us"] // 1000 < now, ["no_key", "key"]
        due = held[waits & passed].sort_values([*who, "at_us", "call_id"])
        rest = held.loc[waits & ~passed, "at_us"]
        before = held[~waits].groupby(who).size().rename("before")
        if not len(rest) and now >= self._end(key):
            self.calls.clear()
        else:
            if len(due):
                self._hold(held.assign(released=(~waits | passed).astype("int64")))
            if len(rest):
                self.handle.registerTimer(int(rest.min()) // 1000 + 1)
        if len(due):
            used = due.groupby(who).cumcount() + 1 + due.join(before, on=who)["before"].fillna(0).astype("int64")
            free = due["no_quota"] == 1
            left = (due["quota"] - used).clip(lower=0).astype("Int64").mask(free)
            own = due["key"].astype("Int64").mask(due["no_key"] == 1)
            made = {"key": own, "day": key[1], "call_id": due["call_id"], "at": pd.to_datetime(due["at_us"], unit="us"), "used": used, "allowed": free | (used <= due["quota"]), "remaining": left}
            yield pd.DataFrame(made)

    def close(self) -> None:
        pass


def fold(events: list[tuple[int, str, str | None]]) -> tuple[str, int, int, int, str]:
    """(answer, steps, completed, failed, state) of one run's events (seq, type, text), as :func:`evaluation.fold_events` folds them."""
    said: list[str] = []
    steps, open_, state, reason = 0, False, "running", ""
    for _, kind, text in sorted(events, key=lambda e: e[0]):
        if kind == "tool_start":
            steps, open_ = steps + 1, True
        elif kind == "delta":
            # Only the beginning of the answer completes a step; a later step is open until the end.
            open_ = open_ and bool(said)
            said.append(text or "")
        elif kind in ("done", "error"):
            state, reason = ("success", "") if kind == "done" else ("failed", text or "")
            break
    failed = 1 if state == "failed" and open_ else 0
    running = 1 if state == "running" and open_ else 0
    answer = f"The request failed: {reason}" if state == "failed" else "(no answer returned)" if state == "success" and not "".join(said) else "".join(said)
    return answer, steps, steps - failed - running, failed, state


class _Fold(StatefulProcessor):
    """Events of one run; folded when none has come for ``idle`` of event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq long", "type string, text string")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for pdf in rows:
            for seq, kind, text, at in zip(pdf["seq"].tolist(), pdf["type"].tolist(), pdf["text"].tolist(), pdf["at_us"].tolist()):
                if not self.events.containsKey((seq,)):
                    self.events.updateValue((seq,), (kind, None if pd.isna(text) else text))
                last = at if last is None else max(last, at)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1 + self.idle_ms)
            self.handle.registerTimer(last // 1000 + 1 + self.idle_ms)
            self.last.update((last,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = fold([(seq, kind, text) for (seq,), (kind, text) in self.events.iterator()])
        self.events.clear()
        self.last.clear()
        yield pd.DataFrame([(key[0], *found)], columns=["run_id", "answer", "n_steps", "n_completed", "n_failed", "state"])

    def close(self) -> None:
        pass


def _mark(at: Column) -> Column:
    """The end of a row's millisecond: watermarks count those, and must not stand within one."""
    return F.timestamp_millis(F.unix_millis(at) + 1)


def daily_quota(calls: DataFrame, quota: Column, late: str = "1 hour") -> DataFrame:
    """The stream of :func:`evaluation.daily_quota`: calls (``call_id``, ``key``, ``at``) with ``used``, ``allowed`` and ``remaining``.

    A call comes out when the watermark has passed it.  The keys of a day are
    dealt to ``BUCKETS`` groups; the state of one is the table of its calls,
    read and written once for each micro-batch that brings some.  It goes when
    the day is over and all are out.
    """
    at = F.col("at").cast("timestamp")
    d = calls.select("call_id", F.coalesce("key", F.lit(0)).cast("long").alias("key"), F.col("key").isNull().cast("long").alias("no_key"), at.alias("at"), quota.cast("long").alias("quota"))
    d = d.withColumns({"quota": F.coalesce("quota", F.lit(0)), "no_quota": F.col("quota").isNull().cast("long"), "bucket": F.pmod(F.xxhash64("no_key", "key"), F.lit(BUCKETS))})
    d = d.withColumns({"day": F.to_date("at"), "at_us": F.unix_micros("at"), "mark": _mark(F.col("at"))}).drop("at").withWatermark("mark", late)
    return d.groupBy("bucket", "day").transformWithStateInPandas(_Quota(), QUOTA_ROWS, "append", "eventTime")


def fold_events(events: DataFrame, late: str = "1 hour", idle_ms: int = DAY_MS) -> DataFrame:
    """The stream of :func:`evaluation.fold_events`: events (``run_id``, ``seq``, ``type``, ``text``, ``at``); a run comes out when it has been idle for ``idle_ms``."""
    d = events.select("run_id", "seq", "type", "text", F.col("at").cast("timestamp").alias("at"))
    d = d.withColumns({"at_us": F.unix_micros("at"), "mark": _mark(F.col("at"))}).drop("at").withWatermark("mark", late)
    return d.groupBy("run_id").transformWithStateInPandas(_Fold(idle_ms), FOLD_ROWS, "append", "eventTime")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work off what has come, and stop; each row is in the files of ``path`` once, whatever fails between.  Start it again for what comes later."""
    spark = stream.sparkSession
    # The other provider has no state of several kinds.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()

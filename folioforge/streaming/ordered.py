"""Ordered folds over late streams: rows wait in state until the watermark has passed them, then are taken in order.

``transformWithState`` keeps the waiting rows of a run in a list, packed by
thousands as Arrow, and its fold in a value; a timer wakes the run when the
watermark reaches its oldest row. Which
rows arrive in which micro-batch, and in which order, does not matter, so the
results are those of the batch operators over the rows that were not too late.
State that follows the rows is bounded by what arrives within the lateness. The
session needs the RocksDB state store (``rocksdb``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioforge.schema import HARD, REFUSED

_WAITING = pa.schema([("at", pa.int64()), ("seq", pa.int64()), ("reason", pa.string()), ("wait", pa.float64())])
#: Rows of an element of the list, and rows that are Python objects at a time.
_PACKED, _HELD = 10_000, 50_000


def rocksdb(spark: SparkSession) -> None:
    """Sets the state store that ``transformWithState`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """``step(state, row)`` gives the next state and a row to emit or None; ``state`` is a tuple of ``schema``."""

    def __init__(self, schema: str, first: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple | None]], columns: list[str]):
        self.schema, self.first, self.step, self.columns = schema, first, step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        oldest = []
        for pdf in rows:
            if len(pdf):
                self._wait(pa.Table.from_pandas(pdf[_WAITING.names], _WAITING, preserve_index=False))
                oldest.append(int(pdf["at"].min()))
        if oldest:
            self._wake(min(oldest))
        return iter(())

    def _wait(self, rows: pa.Table) -> None:
        for lo in range(0, len(rows), _PACKED):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _WAITING) as out:
                out.write_table(rows.slice(lo, _PACKED))
            self.waiting.appendValue((sink.getvalue().to_pybytes(),))

    def _wake(self, at: int) -> None:
        """One timer, not after the oldest waiting row (timers are in milliseconds, rows in microseconds)."""
        timers = list(self.handle.listTimers())
        due = at // 1000 + 1
        if timers and min(timers) <= due:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = pa.concat_tables([_WAITING.empty_table(), *[pa.ipc.open_stream(bytes(x[0])).read_all() for x in self.waiting.get()]])
        soon = pc.less(waiting["at"], passed)
        ready, left = waiting.filter(soon).sort_by([("at", "ascending"), ("seq", "ascending")]), waiting.filter(pc.invert(soon))
        state, made = (tuple(self.state.get()) if self.state.exists() else self.first), []
        for lo in range(0, len(ready), _HELD):
            out = []
            for row in zip(*[c.to_pylist() for c in ready.slice(lo, _HELD).columns], strict=True):
                state, emitted = self.step(state, row)
                if emitted:
                    out.append((key[0], *emitted))
            made.append(pd.DataFrame(out, columns=self.columns))
        self.state.update(state)
        self.waiting.clear()
        if len(left):
            self._wait(left)
            self.handle.registerTimer(pc.min(left["at"]).as_py() // 1000 + 1)
        return iter(made)

    def close(self) -> None:
        pass


def _runs(outcomes: DataFrame, late: str):
    wait = F.col("wait").cast("double") if "wait" in outcomes.columns else F.lit(None).cast("double")
    rows = outcomes.withWatermark("ts", late).select("run", "ts", F.unix_micros("ts").alias("at"), "seq", "reason", wait.alias("wait"))
    return rows.groupBy("run")


def stream_breaker(outcomes: DataFrame, threshold: int = 25, sample: int = 60, late: str = "1 minute") -> DataFrame:
    """Per run the outcome that trips its breaker, once, in the order of ``ts``, then ``seq``."""
    hard = set(HARD)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        seen, found, failed, together, tripped = state
        if tripped:
            return state, None
        _, seq, reason, _ = row
        seen, found = seen + 1, found + (reason == "ok")
        failed, together = (failed + 1, together + 1) if reason in hard else (failed, 0)
        tripped = together >= threshold or (seen >= sample and not found and failed / seen > 0.8)
        return (seen, found, failed, together, tripped), ((seq, seen, failed, together) if tripped else None)

    schema = "seen long, found long, failed long, together long, tripped boolean"
    own = InOrder(schema, (0, 0, 0, 0, False), step, ["run", "seq", "seen", "hard", "consecutive"])
    return _runs(outcomes, late).transformWithStateInPandas(own, "run string, seq long, seen long, hard long, consecutive long", "Append", "EventTime")


def stream_throttle(outcomes: DataFrame, base: float = 0.15, most: float = 8.0, late: str = "1 minute") -> DataFrame:
    """Per run, whatever the worker, the shared delay after each outcome that changes it (as ``outcomes.throttle``)."""
    refused = set(REFUSED)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        (now,) = state
        _, seq, reason, wait = row
        if reason in refused:
            new = min(most, max(now, wait)) if wait is not None else min(most, max(0.25, 2 * now))
        else:
            new = max(base, now * 0.9) if now > base else now
        return (new,), ((seq, new) if new != now else None)

    own = InOrder("delay double", (base,), step, ["run", "seq", "delay"])
    return _runs(outcomes, late).transformWithStateInPandas(own, "run string, seq long, delay double", "Append", "EventTime")

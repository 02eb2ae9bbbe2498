"""Ordered folds over streams: what waits is packed, and the row that ends a played stream is in no result."""

import numpy as np
import pandas as pd
from oracle import same

from folioforge import queries as q
from folioforge.streaming import ordered


class _Held:
    """A list or value state, and a handle with one timer."""

    def __init__(self):
        self.rows, self.timers = [], []

    getListState = getValueState = lambda self, *_: _Held()
    listTimers = lambda self: iter(self.timers)
    registerTimer = lambda self, t: self.timers.append(t)
    deleteTimer = lambda self, t: self.timers.remove(t)
    appendValue = lambda self, x: self.rows.append(x)
    appendList = lambda self, xs: self.rows.extend(xs)
    clear = lambda self: self.rows.clear()
    exists = lambda self: bool(self.rows)
    update = lambda self, x: setattr(self, "rows", list(x))

    def get(self):
        return iter(self.rows)

    def getCurrentWatermarkInMs(self):
        return 20


def test_waiting_rows_are_packed():
    seen = []
    own = ordered.InOrder("n long", (0,), lambda s, row: (s, seen.append(row)), ["run", "n"])
    own.init(handle := _Held())
    at = np.random.default_rng(1).permutation(25_000)
    own.handleInputRows(("r",), iter([pd.DataFrame({"at": at, "seq": at, "reason": "ok", "wait": np.nan})]), None)
    assert len(own.waiting.rows) == 3 and handle.timers == [1]
    list(own.handleExpiredTimer(("r",), handle, None))
    assert seen == [(i, i, "ok", None) for i in range(20_000)]
    assert len(own.waiting.rows) == 1 and 21 in handle.timers


def test_last_row_of_a_played_stream_is_no_run(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 10} 00:{i % 10:02d}:00", i % 3, "error" if i % 4 == 3 else "click") for i in range(40)]
    (tmp_path / "sf").mkdir()
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type"])
    frame.assign(ts=pd.to_datetime(frame["ts"]).astype("datetime64[us]"), value=0.0).to_parquet(f"{tmp_path}/sf/events.parquet")
    same(q.stream_delays(spark, f"{tmp_path}/sf"), q.ORACLES["stream_delays"], f"{tmp_path}/sf")

"""What slow readers of an event stream get, in keyed streaming state: bounded mailboxes and coalesced reloads.

A mailbox holds the newest events of a subscriber. One that fell behind loses the oldest and is told so once, by a
resync before the events that are left. Reloads asked for while one is running become a single one after it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.streaming.deltas import in_buckets, keyed_state

CAPACITY = 16


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    parts = list(rows)
    yield from pd.concat(parts).sort_values(by, kind="stable").itertuples(index=False) if parts else ()


class _Mailbox(StatefulProcessor):
    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._boxes = handle.getMapState("mailbox", "subscriber string", "events string, missed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["subscriber", "at", "event_id"], kind="stable")
        arrived = zip(*(arrived[c].tolist() for c in ("subscriber", "event_id", "poll")), strict=True)
        out = []
        for subscriber, events in groupby(arrived, lambda r: r[0] if isinstance(r[0], str) else None):
            held, missed = self._boxes.getValue((subscriber,)) or ("[]", 0)
            held = json.loads(held)
            for _, event, poll in events:
                if not poll:
                    held.append(event)
                    if len(held) > self.capacity:
                        del held[0]
                        missed += 1
                    continue
                if missed:
                    out.append((subscriber, event, 0, None, missed))
                out += [(subscriber, event, k, e, 0) for k, e in enumerate(held, 1)]
                held, missed = [], 0
            self._boxes.updateValue((subscriber,), (json.dumps(held), missed))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = {"subscriber": object, "poll_id": "int64", "place": "int32", "event_id": "Int64", "missed": "int64"}
        yield pd.DataFrame({c: pd.Series(v, dtype=k) for (c, k), v in zip(kinds.items(), columns, strict=True)})

    def close(self) -> None:
        pass


def bounded_delivery(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What each poll returns: ``subscriber``, ``poll_id``, ``place``, ``event_id``, ``missed``. A stream of ``subscriber``,
    ``at``, ``event_id`` and ``poll``. Place 0 without an event is the resync, with how many were lost since the last poll."""
    keyed_state(events.sparkSession)
    kind = events.schema["subscriber"].dataType
    out = "subscriber string, poll_id long, place int, event_id long, missed long"
    done = in_buckets(events.select("subscriber", "at", "event_id", "poll"), "subscriber").transformWithStateInPandas(_Mailbox(capacity), out, "Update", "None")
    return done.withColumn("subscriber", F.col("subscriber").cast(kind))


class _Reloads(StatefulProcessor):
    def __init__(self, lasts: int):
        self.lasts = lasts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._state = handle, handle.getValueState("reload", "until long, queued boolean")

    def _frame(self, key, starts: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], s, n) for s, n in starts], columns=["subscriber", "start_ms", "queued"]).astype({"subscriber": "int64", "start_ms": "int64", "queued": "bool"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until, queued = self._state.get() if self._state.exists() else (-1, False)
        starts = []
        for r in _in_order(rows, ["ms"]):
            if queued and until <= r.ms:
                starts.append((until, True))
                until, queued = until + self.lasts, False
            if r.ms < until:
                queued = True
            else:
                starts.append((int(r.ms), False))
                until = int(r.ms) + self.lasts
        if queued:
            self._handle.registerTimer(until)
        self._state.update((until, queued))
        yield self._frame(key, starts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, queued = self._state.get() if self._state.exists() else (-1, False)
        starts = [(until, True)] if queued and until <= expiredTimerInfo.getExpiryTimeInMs() else []
        if starts:
            self._state.update((until + self.lasts, False))
        yield self._frame(key, starts)

    def close(self) -> None:
        pass


def coalesced_reloads(requests: DataFrame, lasts_ms: int, late: str = "1 minute") -> DataFrame:
    """When reloads start: ``subscriber``, ``start_ms`` and whether it had to wait. A stream of ``subscriber`` and ``ts``.
    At most one runs and one waits; the waiting one starts when the running one ends, by an event-time timer."""
    keyed_state(requests.sparkSession)
    r = requests.withWatermark("ts", late).selectExpr("subscriber", "ts", "unix_millis(ts) AS ms")
    return r.groupBy("subscriber").transformWithStateInPandas(_Reloads(lasts_ms), "subscriber long, start_ms long, queued boolean", "Append", "EventTime")

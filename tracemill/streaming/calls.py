"""Segments as a stream: exactly-once admission and the ordered fold as keyed state, with the code that the batch runs.

The watermark is one of sequence numbers, not of time: segments that arrive early wait in the state until the gap before them closes,
and none is ever late. A call without an end that stays idle is closed as unknown by a timer; a closed one that stays idle as long again
leaves the state with its receipts, after which a retry of its segments would open it anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.core.fold import CallFold
from tracemill.core.values import dump
from tracemill.sources.segments import CALLS, call_row, fold_segments, waiting_call

REVISED = f"{CALLS}, revision long, conflicts long"
COLUMNS = [c.split()[0] for c in REVISED.split(", ")]


class CallProcessor(StatefulProcessor):
    """One row for each call and micro-batch in which it moved; `revision` counts them, so a sink keeps the highest."""

    def __init__(self, idle_ms: int = 24 * 3600 * 1000) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("call", "state string")
        self.waiting = handle.getMapState("waiting", "first_sequence long", "through_sequence long, observations string")
        self.receipts = handle.getMapState("receipts", "segment_id string", "digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        s = json.loads(self.state.get()[0]) if self.state.exists() else {"call": None, "state": {}, "through": 0, "revision": 0, "conflicts": 0, "timer": None, "failure": None, "destination": None}
        held = {k[0]: v[0] for k, v in self.waiting.iterator()}
        for batch in rows:
            for r in batch.itertuples(index=False):
                s["destination"] = s["destination"] or r.destination
                self._admit(s, r, held)
        ready, through = [], s["through"]
        while self.waiting.containsKey((through + 1,)):
            last, observations = self.waiting.getValue((through + 1,))
            ready.append((through + 1, last, observations))
            self.waiting.removeKey((through + 1,))
            through = last
        fold = CallFold(s["call"], s["state"])
        if ready and not s["failure"]:
            s["failure"] = fold_segments(fold, ready)[1]
        s |= {"call": fold.call, "state": fold.state, "through": through, "revision": s["revision"] + 1}
        self._time(s, timerValues)
        self.state.update((dump(s),))
        yield self._row(key, s)

    def _admit(self, s: dict, r: object, held: dict[int, int]) -> None:
        """A receipt makes a retry a duplicate and changed bytes a conflict; ranges that reach into others are conflicts."""
        if self.receipts.containsKey((r.segment_id,)):
            s["conflicts"] += self.receipts.getValue((r.segment_id,))[0] != r.digest
            return
        first, last = int(r.first_sequence), int(r.through_sequence)
        if first <= s["through"] or any(first <= b and a <= last for a, b in held.items()):
            s["conflicts"] += 1
            return
        self.receipts.updateValue((r.segment_id,), (r.digest,))
        self.waiting.updateValue((first,), (last, r.observations))
        held[first] = last

    def _time(self, s: dict, timers: object) -> None:
        if s["timer"] is not None:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = timers.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(s["timer"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        s = json.loads(self.state.get()[0])
        if s.get("expired") or (s["call"] or {}).get("terminalSequence") is not None:
            for held in (self.state, self.waiting, self.receipts):
                held.clear()
            return
        s |= {"timer": None, "revision": s["revision"] + 1, "expired": True}
        if s["call"]:
            s["call"] |= {"state": "unknown", "incomplete": True, "raw": "partial"}
        self._time(s, timerValues)
        self.state.update((dump(s),))
        yield self._row(key, s)

    @staticmethod
    def _row(key: tuple, s: dict) -> pd.DataFrame:
        row = call_row(CallFold(s["call"] or waiting_call(s["destination"])), key[0], s["through"], s["failure"]) | {"revision": s["revision"], "conflicts": s["conflicts"]}
        return pd.DataFrame([row])[COLUMNS].astype(object)

    def close(self) -> None:
        pass


def call_stream(segments: DataFrame, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A stream of REVISED rows from a stream of validated segments. It needs the RocksDB state store."""
    segments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = segments.where("error IS NULL AND observations IS NOT NULL").select("call_id", "destination", "segment_id", "digest", "first_sequence", "through_sequence", "observations")
    return kept.groupBy("call_id").transformWithStateInPandas(CallProcessor(idle_ms), REVISED, "update", "processingTime")

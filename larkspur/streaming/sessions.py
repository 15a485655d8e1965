"""Calls as keyed state: the sessions of ``larkspur.operators.sessions`` on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from larkspur.functions.call_patterns import CALL_RULES
from larkspur.functions.scoring import LEVELS
from larkspur.operators.calls import ALERT_MINIMUM
from larkspur.operators.sessions import FIRST_STATUS, LEAST_RETAIN_MS, OUT, WINDOW, fired
from larkspur.operators.state import ENDED_STATUSES
from larkspur.streaming.calls import _LEVELS, _verdict

#: A call without an event for so long is forgotten.
IDLE_MS = 6 * 3_600_000
#: Where the state of streams must be kept.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SESSION = "status string, ended_at long, last_at long, newest long, sequence long, mark string, alerted int, caller array<int>, user array<int>"
_USERS = frozenset(i for i, r in enumerate(CALL_RULES) if r[6])
_NAMES = [c.split()[0] for c in OUT.split(", ")]


class CallSessions(StatefulProcessor):
    """Per call: the session, a track for each speaker, and of each final segment in the window the rules it matched.

    Segments that match nothing leave no state.  One timer per call, in event
    time, ends the retention of an ended call or the wait for an idle one.
    """

    def __init__(self, minimum: str, window: int, retain_ms: int, idle_ms: int):
        self.minimum, self.window, self.retain, self.idle = max(LEVELS[minimum], 1), window, max(retain_ms, LEAST_RETAIN_MS), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _SESSION)
        self.tracks = handle.getMapState("tracks", "speaker string", "seen long, finals long, rank long")
        self.matches = handle.getMapState("matches", "rank long", "caller boolean, fired array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        call = _Call(self, key[0])
        for r in pd.concat(list(rows)).sort_values("n", kind="stable").itertuples(index=False):
            call.take(r)
        call.save()
        if call.out:
            yield pd.DataFrame(call.out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.session.clear()
        self.tracks.clear()
        self.matches.clear()
        yield pd.DataFrame([(key[0], None, "evicted", *[None] * 6)], columns=_NAMES).astype({"n": "Int64", "sequence": "Int64"})


class _Call:
    """One call while a batch's events are folded into it."""

    def __init__(self, states: CallSessions, call_id: str):
        self.states, self.call_id, self.out = states, call_id, []
        self.known = states.session.exists()
        found = states.session.get() if self.known else (None, None, 0, 0, 0, None, 0, [0] * len(CALL_RULES), [0] * len(CALL_RULES))
        self.status, self.ended_at, self.last_at, self.newest, self.sequence, self.mark, self.alerted, caller, user = found
        self.caller, self.user, self.due = list(caller), list(user), None
        if self.known:
            self.due = self._due()

    def _due(self) -> int:
        return self.last_at + self.states.idle if self.ended_at is None else self.ended_at + self.states.retain

    def save(self) -> None:
        if not self.known:
            return
        s = self.states
        s.session.update((self.status, self.ended_at, self.last_at, self.newest, self.sequence, self.mark, self.alerted, self.caller, self.user))
        if (due := self._due()) != self.due:
            if self.due is not None:
                s.handle.deleteTimer(self.due)
            s.handle.registerTimer(due)

    def emit(self, n: int, kind: str, id_=None, status=None, score=None, level=None, rules=None, sequence=None) -> None:
        self.out.append((self.call_id, n, kind, id_, status, score, level, rules, sequence))

    def take(self, r) -> None:
        if (r.kind == "created") == self.known:
            return
        at = r.at.value // 1_000_000
        if r.kind == "created":
            self.known, self.status, self.last_at = True, FIRST_STATUS, at
            self.emit(r.n, "created", status=FIRST_STATUS)
            return
        if self.ended_at is None:
            self.last_at = max(self.last_at, at)
        elif r.kind != "verdict" or at > self.ended_at + self.states.retain:
            return
        if r.kind == "verdict" and not pd.isna(r.score):
            self.rate(r.n, float(r.score), None)
        elif r.kind == "status" and r.status is not None:
            self.turn(r.n, r.status, at)
        elif r.kind == "segment" and r.speaker is not None and (r.text or "").strip(" "):
            self.hear(r)

    def turn(self, n: int, status: str, at: int) -> None:
        if status in ENDED_STATUSES:
            self.ended_at = at
            self.emit(n, "ended", status=status)
        elif status != self.status:
            self.emit(n, "status", status=status)
        self.status = status

    def hear(self, r) -> None:
        s, key = self.states, (r.speaker,)
        seen, finals, rank = s.tracks.getValue(key) if s.tracks.containsKey(key) else (-1, 0, -1)
        final = bool(r.final) and not pd.isna(r.final)
        if not pd.isna(r.sequence):
            if not final and r.sequence < seen:
                return
            seen = max(seen, int(r.sequence))
        if rank < 0:
            self.newest += 1
            rank = self.newest
            self.leave(rank - s.window)
        s.tracks.updateValue(key, (seen, finals + final, -1 if final else rank))
        if rank <= self.newest - s.window:
            return
        self.emit(r.n, "segment", id_=f"{r.speaker}-tw-{finals + 1}")
        if not final:
            return
        numbers = [int(i) for i in r.fired]
        if numbers:
            s.matches.updateValue((rank,), (r.speaker == "caller", numbers))
            self.count(r.speaker == "caller", numbers, 1)
        score, level, rules = _verdict({i for i, c in enumerate(self.caller) if c}, {i for i, c in enumerate(self.user) if c})
        mark = f"{_LEVELS[level]}|{score:.2f}|{rules}"
        if mark != self.mark:
            self.mark = mark
            self.rate(r.n, score, rules)

    def leave(self, rank: int) -> None:
        """The segment that leaves the window; its matches no longer count."""
        if rank > 0 and self.states.matches.containsKey((rank,)):
            caller, numbers = self.states.matches.getValue((rank,))
            self.count(caller, numbers, -1)
            self.states.matches.removeKey((rank,))

    def count(self, caller: bool, numbers: list[int], by: int) -> None:
        for i in numbers:
            self.user[i] += by
            if caller or i in _USERS:
                self.caller[i] += by

    def rate(self, n: int, score: float, rules: str | None) -> None:
        level = 3 if score >= 0.75 else 2 if score >= 0.5 else 1 if score >= 0.3 else 0
        self.sequence += 1
        self.emit(n, "verdict", score=score, level=_LEVELS[level], rules=rules, sequence=self.sequence)
        if self.ended_at is None and level >= self.states.minimum and level > self.alerted:
            self.alerted = level
            self.emit(n, "alert", score=score, level=_LEVELS[level], sequence=self.sequence)


def session_stream(events: DataFrame, minimum: str = ALERT_MINIMUM, window: int = WINDOW, retain_ms: int = LEAST_RETAIN_MS, idle_ms: int = IDLE_MS, late: str = "10 seconds") -> DataFrame:
    """The effects of ``session_log`` as they come, and ``evicted`` where a call's state goes.

    Events of a call must come in order from batch to batch; within a batch
    they are sorted.  The session needs the RocksDB state store (``PROVIDER``).
    """
    rows = fired(events.withWatermark("at", late))
    processor = CallSessions(minimum, window, retain_ms, idle_ms)
    return rows.groupBy("call_id").transformWithStateInPandas(processor, OUT, "Append", "EventTime")

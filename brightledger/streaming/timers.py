"""Streams whose state ends by itself: leases that run out, blocks that are lifted, by timers in event time.

State lives in the RocksDB store, which timers need; ``with_timers`` runs a query with it.
An operator takes events with a watermark on ``ts``. What a timer emits depends on the
watermark alone: everything due up to it, when the stream is run to its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import LEASE_SECONDS, MOST_ATTEMPTS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEASE_OUT = "task_id long, at timestamp, what string, attempts int"
#: Failures in a window that block a login, and the seconds of a window and of a block.
FAILURES, WINDOW_SECONDS, BLOCK_SECONDS = 5, 300, 300
LOGIN_OUT = "user_id long, at timestamp, what string, failures int"


def with_timers(spark: SparkSession, run: Callable[[], Any]) -> Any:
    """``run()`` with the state store that timers need; the session's own setting is put back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


class Timed(StatefulProcessor):
    """A processor whose state is one row, and whose only timer stands for the state's ``due``, in milliseconds.

    ``step(key, state, now, row)`` takes an event, ``expire(key, state)`` the moment that
    is due; both return (state, row to emit or None). ``due(state)`` is None where
    nothing can run out. Events are taken in order of (ts, event_id) within a batch; what
    is due before an event is emitted before it. Without a state, the next event of a
    key begins anew.
    """

    schema: str
    out: str
    names: list[str]

    def first(self) -> tuple:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        raise NotImplementedError

    def expire(self, key: int, state: tuple) -> tuple[tuple | None, tuple | None]:
        raise NotImplementedError

    def step(self, key: int, state: tuple, now: int, row: Any) -> tuple[tuple | None, tuple | None]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def told(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.names)
        out["at"] = out["at"].astype("int64").astype("datetime64[ms]").astype("datetime64[us]")
        return out

    def keep(self, state: tuple | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
            return
        self.state.update(state)
        if (due := self.due(state)) is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = tuple(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        for row in events.itertuples(index=False):
            now = row.ts.value // 1_000_000
            state = self.first() if state is None else state
            while state is not None and (due := self.due(state)) is not None and due < now:
                state, told = self.expire(key[0], state)
                out += [told] if told else []
            state, told = self.step(key[0], self.first() if state is None else state, now, row)
            out += [told] if told else []
        self.keep(state)
        if out:
            yield self.told(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = tuple(self.state.get()) if self.state.exists() else None
        if state is None or self.due(state) != expiredTimerInfo.getExpiryTimeInMs():
            return
        state, told = self.expire(key[0], state)
        self.keep(state)
        if told:
            yield self.told([told])

    def close(self) -> None:
        pass


class Leases(Timed):
    """Leases of tasks. A claim takes a task without a lease; a heartbeat renews a lease, complete ends the task, fail and the lease's end free it, until its last attempt."""

    schema = "state string, attempts int, until long"
    out, names = LEASE_OUT, ["task_id", "at", "what", "attempts"]

    def first(self) -> tuple:
        return "queued", 0, 0

    def due(self, state: tuple) -> int | None:
        return state[2] if state[0] == "running" else None

    def expire(self, key: int, state: tuple) -> tuple[tuple, tuple]:
        final = state[1] >= MOST_ATTEMPTS
        return ("failed" if final else "queued", state[1], 0), (key, state[2], "retry_limit_exceeded" if final else "lease_expired", state[1])

    def step(self, key: int, state: tuple, now: int, row: Any) -> tuple[tuple, tuple | None]:
        name, attempts, until = state
        if row.action == "claim" and name == "queued":
            return ("running", attempts + 1, now + LEASE_SECONDS * 1000), (key, now, "claimed", attempts + 1)
        if row.action == "heartbeat" and name == "running":
            return (name, attempts, now + LEASE_SECONDS * 1000), None
        if row.action == "complete" and name == "running":
            return ("completed", attempts, 0), (key, now, "completed", attempts)
        if row.action == "fail" and name == "running":
            final = attempts >= MOST_ATTEMPTS
            return ("failed" if final else "queued", attempts, 0), (key, now, "failed" if final else "requeued", attempts)
        return state, None


class Logins(Timed):
    """Login attempts (``valid``): after FAILURES failures in a window that begins with the first, all attempts are turned away for BLOCK_SECONDS; a success forgets the failures.

    The state of a user is dropped when its window or block is over.
    """

    schema = "failures int, since long, until long"
    out, names = LOGIN_OUT, ["user_id", "at", "what", "failures"]

    def first(self) -> tuple:
        return 0, 0, 0

    def due(self, state: tuple) -> int | None:
        failures, since, until = state
        return None if not failures else until if until else since + WINDOW_SECONDS * 1000

    def expire(self, key: int, state: tuple) -> tuple[None, tuple | None]:
        failures, _, until = state
        return None, (key, until, "unblocked", failures) if until else None

    def step(self, key: int, state: tuple, now: int, row: Any) -> tuple[tuple | None, tuple]:
        failures, since, until = state
        if until >= now and until:
            return state, (key, now, "login_rate_limited", failures)
        if row.valid:
            return None, (key, now, "ok", failures)
        failures, since = failures + 1, since if failures else now
        return (failures, since, now + BLOCK_SECONDS * 1000 if failures >= FAILURES else 0), (key, now, "invalid_credentials", failures)


def timed(events: DataFrame, key: str, processor: Timed, delay: str) -> DataFrame:
    """The stream of what a processor emits for events (``key``, event_id, ts and its own columns) with a watermark of ``delay``."""
    return events.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(processor, processor.out, "Append", "EventTime")

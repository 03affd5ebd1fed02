"""Folds of keyed rows by event time, for tables and for streams.

All times are microseconds since 1970 in long columns, whatever the zone of session or process; timestamps do not enter Python. A stream keeps
for each key the fold's state, the time of its timer and, if rows wait for the watermark, those that it has not passed. Rows that
wait are folded in the order of event time whatever order batches bring them in, so the stream equals the table's fold; what is kept
of a key is then the rows of its last `delay`."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """rows: the schema of what step gets as a tuple, the time in microseconds first, then a tie-breaker. State: a tuple, None where nothing is
    kept. due: when expire is to run next (it runs once a time beyond that is known to be reached); it may give rows and another state."""

    key: str
    rows: str
    state: str
    out: str
    start: Callable[[], tuple | None]
    step: Callable[[object, tuple | None, tuple], tuple[tuple | None, Iterable[tuple]]]
    due: Callable[[tuple], int | None]
    expire: Callable[[object, tuple, int], tuple[tuple | None, Iterable[tuple]]]
    #: Rows at the end of a batch by the states before and after it.
    changed: Callable[[object, tuple | None, tuple | None], Iterable[tuple]] | None = None
    order: Callable[[tuple], object] = lambda r: (r[0], r[1] is not None, r[1] or 0)

    def upto(self, key, state: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        out: list[tuple] = []
        while state is not None and (due := self.due(state)) is not None and due < now:
            state, more = self.expire(key, state, now)
            out += more
        return state, out

    def row(self, key, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        state, out = self.upto(key, state, row[0])
        state, more = self.step(key, self.start() if state is None else state, row)
        return state, [*out, *more]

    def over(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """The fold of a whole group, key first in each row, in order."""
        state = None
        for key, *row in rows:
            state, out = self.row(key, state, tuple(row))
            yield from out


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, wait: bool):
        self.fold, self.wait = fold, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.state)
        self.timer = handle.getValueState("timer", "at long")
        self.waiting = handle.getListState("waiting", self.fold.rows) if self.wait else None

    def handleInitialState(self, key, initialState, timerValues) -> None:
        state = tuple(initialState[n] for n in _names(self.fold.state))
        self.state.update(state)
        self._wake(self.fold.due(state))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = _names(self.fold.rows)
        fresh = [tuple(r[n] for n in names) for r in rows]
        return self._advance(key[0], fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        return self._advance(key[0], [], timerValues)

    def _advance(self, key, fresh: list[tuple], timers) -> Iterator[Row]:
        reached = timers.getCurrentWatermarkInMs() * 1000
        held: list[tuple] = []
        if self.wait:
            rows = [*map(tuple, self.waiting.get()), *fresh]
            fresh, held = [r for r in rows if r[0] < reached], [r for r in rows if r[0] >= reached]
            self.waiting.put(held) if held else self.waiting.clear()
        before = state = tuple(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        for row in sorted(fresh, key=self.fold.order):
            state, more = self.fold.row(key, state, row)
            out += more
        state, more = self.fold.upto(key, state, reached)
        out += more
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            if self.fold.changed:
                out += self.fold.changed(key, before, state)
        due = [] if state is None or (at := self.fold.due(state)) is None else [at]
        self._wake(min([*due, *(r[0] for r in held)], default=None))
        names = _names(self.fold.out)
        return (Row(**dict(zip(names, o, strict=True))) for o in out)

    def _wake(self, at: int | None) -> None:
        """One timer: when the watermark is beyond that time."""
        ms = None if at is None else at // 1000 + 1
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def close(self) -> None:
        pass


def streamed(rows: DataFrame, fold: Fold, mode: str = "append", wait: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """rows (the key, a column with a watermark, the fold's columns) → the fold's rows. As such state needs it, the session's state store
    becomes RocksDB for streams that start from now on. initial(key, columns of the state): states of keys at the start of the first run."""
    rows.sparkSession.conf.set(_PROVIDER, _ROCKS)
    given = initial.groupBy(fold.key) if initial is not None else None
    return rows.groupBy(fold.key).transformWithState(_Processor(fold, wait), fold.out, mode, "EventTime", given)

"""Stateful steps over streams whose rows are taken in the order of their event time, whatever the order they come in."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocks(spark: SparkSession) -> None:
    """State variables and timers need this store; a session that names a store of its own keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name):
        spark.conf.set(name, ROCKS)


#: Keys are dealt into so many groups, each with the state of its keys: what Python and Spark tell each other about state
#: and timers is then told once for a group and not for each key. A stream keeps the number for its life.
GROUPS = 96
#: Rows or states that stand in one text.
TOGETHER = 5_000


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then hands them on by (at, id).

    Rows come with key, at (microseconds), id and further columns. A subclass says in step() what a row does to the
    state of its key and what it puts out, and in due() what falls due by itself before a moment. What a key puts out
    depends on its rows alone, not on batches nor on the keys of its group; rows behind the watermark are dropped by
    Spark. The states of a group are read and written as one list whenever something of it is due: each message between
    Python and Spark takes milliseconds, so their number must not grow with the keys; rows and states stand in it by
    thousands in one text. Of a group only the timer that goes off first does work: each further one would read and
    write all its states again.
    """

    fields = "at long, id long"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.held = handle.getListState("held", "states string")
        self.armed = handle.getListState("armed", "at long")

    def handleInputRows(self, key, rows, timerValues):
        names = ["key", *[f.split()[0] for f in self.fields.split(", ")]]
        for frame in rows:
            held = list(zip(*[_values(frame[n]) for n in names], strict=True))
            if held:
                self.waiting.appendList(_texts(held))
                self._arm(min(r[1] for r in held))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        first = self._first()
        if first is None or first > until:
            return
        ready, left = {}, []
        for r in _rows(self.waiting):
            if r[1] <= until:
                ready.setdefault(r[0], []).append(r[1:])
            else:
                left.append(r)
        states = {k: (state, at) for k, state, at in _rows(self.held)}
        out = []
        for k in sorted({*ready, *(k for k, (_, at) in states.items() if at is not None and at <= until)}):
            (state, _), made = states.pop(k, (None, None)), []
            for row in sorted(ready.get(k, ()), key=lambda r: r[:2]):
                state, early = self.due(state, row[0])
                state, now = self.step(state, row)
                made += early + now
            state, late = self.due(state, until)
            out += [(k, *r) for r in made + late]
            if state is not None:
                states[k] = (state, self.next_due(state))
        if ready:
            _replace(self.waiting, _texts(left))
        _replace(self.held, _texts([(k, state, at) for k, (state, at) in states.items()]))
        _replace(self.armed, [])
        if next_ := [r[1] for r in left] + [at for _, at in states.values() if at is not None]:
            self._arm(min(next_), None)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _first(self) -> int | None:
        return next((r[0] for r in list(self.armed.get())), None)

    def _arm(self, at: int, *known) -> None:
        """Has a timer go off at a moment, unless one goes off before."""
        first = known[0] if known else self._first()
        if first is None or at < first:
            _replace(self.armed, [(at,)])
            self.handle.registerTimer(_millis(at))

    def step(self, state, row):
        raise NotImplementedError

    def due(self, state, until):
        return state, []

    def next_due(self, state):
        return None

    def close(self) -> None:
        pass


def _values(column) -> list:
    """The values of a column of pandas, with None for those that are missing."""
    values = column.tolist()
    return [None if v is None or v != v else v for v in values] if column.isna().any() else values


def _texts(rows: list) -> list[tuple[str]]:
    return [(json.dumps(rows[i : i + TOGETHER]),) for i in range(0, len(rows), TOGETHER)]


def _rows(kept) -> Iterator[list]:
    for text in list(kept.get()):
        yield from json.loads(text[0])


def _replace(kept, rows: list) -> None:
    kept.clear()
    if rows:
        kept.put(rows)


def _millis(at: int) -> int:
    """The first millisecond that is not before a moment in microseconds."""
    return -(-at // 1000)


def apply(rows: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    """rows: key, the processor's fields, and a timestamp with a watermark."""
    keep_state_in_rocks(rows.sparkSession)
    processor.columns = [c.split()[0] for c in schema.split(", ")]
    grouped = rows.withColumn("_group", F.pmod(F.hash("key"), F.lit(GROUPS))).groupBy("_group")
    return grouped.transformWithStateInPandas(processor, schema, "append", "EventTime")

"""Keyed state in streams: a state machine with legal moves, work that is retried, and a barrier over a document's parts.

State lives in Spark's state store (``transformWithState`` over RocksDB) and is committed with each batch, so a stream that is started again
from its checkpoint goes on where it was. Sinks write a folder for each batch's number, which a repeated batch overwrites: each row
stands in a table once. A key's rows of one batch meet in one task; what a batch may hold is the source's option (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What may follow a state of a parsing job; "" is that of a job not seen before.
LEGAL: dict[str, tuple[str, ...]] = {"": ("pending",), "pending": ("running", "failed"), "running": ("running", "done", "failed"), "failed": ("pending",), "done": ()}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after(state: tuple[str, int, object], to: str, progress: int | None, at: object, legal: Mapping[str, Sequence[str]]) -> tuple[tuple[str, int, object], str | None]:
    """The state (name, progress, time) after an event, and why the event is refused, if it is. Progress never falls within a run."""
    now, held, since = state
    if since is not None and at < since:
        return state, "late"
    if to not in legal.get(now, ()):
        return state, f"{now or 'new'} to {to}"
    if to == "done":
        return (to, 100, at), None
    return (to, max(held, min(100, max(0, int(progress or 0)))) if to == now else min(100, max(0, int(progress or 0))), at), None


class Machine(StatefulProcessor):
    """Applies a key's events in order of time (and ``seq``), whatever the order they come in within a batch."""

    def __init__(self, legal: Mapping[str, Sequence[str]]):
        self.legal = dict(legal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state string, progress int, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        state = tuple(self.held.get()) if self.held.exists() else ("", 0, None)
        out = []
        for e in events.itertuples():
            before = state[0]
            state, refused = after(state, e.to, None if pd.isna(e.progress) else e.progress, e.at.to_pydatetime(), self.legal)
            out.append((key[0], int(e.seq), before, e.to, state[0], state[1], e.at, refused))
        if state[2] is not None:
            self.held.update(state)
        yield pd.DataFrame(out, columns=["key", "seq", "from", "to", "state", "progress", "at", "refused"])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, key: str, to: str, at: str, seq: str, progress: Column | None = None, legal: Mapping[str, Sequence[str]] = LEGAL) -> DataFrame:
    """A row for each event: key, seq, from, to, state and progress after it, at, refused (null if the move was made)."""
    own = events.select(F.col(key).cast("string").alias("key"), F.col(to).alias("to"), F.col(at).alias("at"), F.col(seq).cast("long").alias("seq"), (F.lit(None) if progress is None else progress).cast("int").alias("progress"))
    own = own.where("key is not null and to is not null and at is not null")
    schema = "key string, seq long, `from` string, to string, state string, progress int, at timestamp, refused string"
    return own.groupBy("key").transformWithStateInPandas(Machine(legal), schema, "Append", "None")


class Worker(StatefulProcessor):
    """Does each key's work; what fails is done again by a timer, later each time, until it succeeds, has failed too often or is too old."""

    def __init__(self, work: Callable[[str], str | None], retries: int, first_ms: int, most_ms: int, live_ms: int, remember_ms: int):
        self.work, self.retries, self.first_ms, self.most_ms, self.live_ms, self.remember_ms = work, retries, first_ms, most_ms, live_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "payload string, attempts int, since long")
        self.settled = handle.getValueState("settled", "outcome string", self.remember_ms)

    def _tried(self, key: str, payload: str, attempts: int, since: int, now: int) -> Iterator[pd.DataFrame]:
        result, error = None, None
        if now - since > self.live_ms:
            outcome, error = "dead", "expired"
        else:
            attempts += 1
            try:
                result, outcome = self.work(payload), "done"
            except Exception as e:  # any failure of the work counts as an attempt
                outcome, error = "dead" if attempts > self.retries else "again", f"{type(e).__name__}: {e}"
        if outcome == "again":
            self.open.update((payload, attempts, since))
            self.handle.registerTimer(now + min(self.most_ms, self.first_ms << (attempts - 1)))
            return
        self.open.clear()
        self.settled.update((outcome,))
        yield pd.DataFrame([(key, payload, outcome, attempts, result, error)], columns=["key", "payload", "outcome", "attempts", "result", "error"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = next(x for x in rows if len(x))
        for _ in rows:  # whatever is delivered again changes nothing
            pass
        if not self.open.exists() and not self.settled.exists():
            now = timerValues.getCurrentProcessingTimeInMs()
            yield from self._tried(key[0], first["payload"].iloc[0], 0, now, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            payload, attempts, since = self.open.get()
            yield from self._tried(key[0], payload, attempts, since, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def worked(
    tasks: DataFrame, key: str, payload: str, work: Callable[[str], str | None], retries: int = 3, first_ms: int = 1000, most_ms: int = 600_000, live_ms: int = 3_600_000, remember_ms: int = 7 * 86_400_000
) -> DataFrame:
    """A row for each key once its work is settled: outcome done or dead, attempts, result, error.

    Retries wait ``first_ms``, twice as long each time, ``most_ms`` at most; a task older than ``live_ms`` is dead. A key that comes again within ``remember_ms`` is skipped."""
    own = tasks.select(F.col(key).cast("string").alias("key"), F.col(payload).cast("string").alias("payload")).where("key is not null")
    schema = "key string, payload string, outcome string, attempts int, result string, error string"
    return own.groupBy("key").transformWithStateInPandas(Worker(work, retries, first_ms, most_ms, live_ms, remember_ms), schema, "Append", "ProcessingTime")


class Gate(StatefulProcessor):
    """Opens once, when as many different parts of a key have come as it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part long", "seen boolean")
        self.sums = handle.getValueState("sums", "came long, total long, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came, total, opened = self.sums.get() if self.sums.exists() else (0, None, False)
        if opened:
            for _ in rows:
                pass
            return
        for frame in rows:
            totals = frame["total"].dropna()
            total = max([*([] if total is None else [total]), *(int(t) for t in totals)], default=None)
            for part in frame["part"].drop_duplicates().tolist():
                if not self.parts.containsKey((int(part),)):
                    self.parts.updateValue((int(part),), (True,))
                    came += 1
        opened = total is not None and came >= total
        self.sums.update((came, total, opened))
        if opened:
            self.parts.clear()
            yield pd.DataFrame({"key": [key[0]], "total": [total]})

    def close(self) -> None:
        pass


def complete(parts: DataFrame, key: str, part: str, total: str) -> DataFrame:
    """key and total of each key, once all its parts have come; parts that come twice count once, and a total may come with any part."""
    own = parts.select(F.col(key).cast("string").alias("key"), F.col(part).cast("long").alias("part"), F.col(total).cast("long").alias("total")).where("key is not null and part is not null")
    return own.groupBy("key").transformWithStateInPandas(Gate(), "key string, total long", "Append", "None")


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, which keyed processors need; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def start(rows: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rows appended to ``out``, a folder a batch; all that is available, or for good in batches ``every`` so often."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with rocks(rows.sparkSession):
        writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

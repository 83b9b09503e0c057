"""Live frames: keyed state for motion and the adaptive controller, event-time windows, static joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.config import DEFAULTS, Settings
from tidemark.schemas import EVENT


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where the session names none and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base}/{uuid.uuid4().hex}"


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet event files as a stream, in their schema; ts as a timestamp, which watermarks need."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


#: Keyed state of any kind needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """While it lasts, queries that start keep their state in the store that keyed state needs."""
    key, value = STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def finish(stream: DataFrame, mode: str = "append", processed: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over what there is and return its result as a table.

    Append results go to Parquet files, exactly once; complete and update results to one
    folder for each batch, of which the last of each key counts for the caller. A folder
    that is given again goes on from its checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    with keyed_store(spark):
        if mode == "append" and processed is None:
            query = writer.format("parquet").option("path", out).start()
        else:
            write = processed or (lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            query = writer.foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def replay(events: DataFrame, build: Callable[[DataFrame], DataFrame], parts: int = 5, again: str | None = None) -> DataFrame:
    """The result of a stream that gets a table of events in `parts` stretches of time, one after the other.

    Each stretch lands as files and is read by a new start on the same checkpoint, so
    keyed state, watermarks and files seen go from one trigger to the next. `again` lets
    each stretch bring the last of the one before once more, of that length. A table
    without a single ts is one stretch.
    """
    spark = events.sparkSession
    folder = shared_folder(spark)
    at = F.col("ts").cast("timestamp")
    marks = events.agg(F.percentile_approx(at.cast("double"), F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(10_000))).first()[0] if parts > 1 else None
    edges = [None, *sorted(set(marks or [])), None]
    out = None
    for low, high in zip(edges, edges[1:], strict=False):
        seconds = at.cast("double")
        mine = F.lit(True) if low is None else (seconds >= low if again is None else at + F.expr(f"interval {again}") >= F.timestamp_seconds(F.lit(low)))
        rows = events.where(mine if high is None else mine & (seconds < high))
        rows.write.mode("append").parquet(f"{folder}/in")
        out = finish(build(stream_events(spark, f"{folder}/in", 1_000_000)), folder=folder)
    return out


# ---- keyed state


_MOTION = "clip_id long, event_id long, frame_idx int, value double, motion double, downscale_hundredths int, skip_stride int"
_STATE = "value double, frames int, late int, ms long, wakes long"
_HELD = "ts long, event_id long, value double"


class MotionProcessor(StatefulProcessor):
    """Motion and the controller's state after each frame of a clip.

    A clip's value state is its last value, how many frames it has had, how many were
    late, and when: downscale and stride follow from the late ones. A frame that comes
    over `idle` after the one before begins its clip anew, and a timer on the watermark
    takes the state away by then, so what is kept follows the clips that are alive. A
    timer stays where it is when frames come: if it wakes too early it is set again. So
    a batch reads and writes a clip's state once, each a call to the store. With
    `hold`, frames wait in a list state until the watermark has passed them, and so are
    taken in the order of time however files and triggers deal them. State may be given
    to start with.
    """

    def __init__(self, settings: Settings, idle: timedelta, hold: bool):
        self.settings, self.idle_ms, self.hold = settings, int(idle.total_seconds() * 1000), hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)
        self.held = handle.getListState("held", _HELD)

    def _wake(self, at: int, wakes: int | None) -> int:
        """When the clip's one timer wakes, which is at `at` or earlier."""
        if wakes is None or wakes > at:
            if wakes is not None:
                self.handle.deleteTimer(wakes)
            self.handle.registerTimer(at)
            return at
        return wakes

    def _taken(self, key: tuple, state: tuple, rows: list[tuple[int, int, float]]) -> tuple[tuple, list[Row]]:
        """The state after some frames, and what is known of each."""
        value, frames, late, seen, wakes = state
        s, out = self.settings, []
        first, down, least = (round(x * 100) for x in (s.initial_downscale, s.downscale_step, s.min_downscale))
        for ts, event, now in sorted(rows, key=lambda r: r[:2]):
            ms = ts // 1000
            # a clip begins at first or after it was idle, whenever its frames and timers come
            if (value is None and not frames) or (seen is not None and ms - seen > self.idle_ms):
                value, frames, late = now, 0, 0
            late += now is not None and now > s.latency_target_ms
            motion = None if now is None or value is None else abs(now - value) * 0.2
            out.append(Row(clip_id=key[0], event_id=event, frame_idx=frames, value=now, motion=motion, downscale_hundredths=max(min(first, least), first - late * down), skip_stride=min(s.max_stride, late + 1)))
            value, frames, seen = now, frames + 1, ms
        return (value, frames, late, seen, wakes), out

    def _released(self, key: tuple, state: tuple, watermark: int) -> Iterator[Row]:
        """The held frames that the watermark has passed; the others wait on, with a timer for the first of them."""
        held = list(self.held.get())
        ready, wait = [r for r in held if r[0] // 1000 < watermark], [r for r in held if r[0] // 1000 >= watermark]
        out: list[Row] = []
        if ready:
            state, out = self._taken(key, state, ready)
        if wait:
            self.held.put(wait)
        else:
            self.held.clear()
        at = min(r[0] for r in wait) // 1000 if wait else max(r[0] for r in held) // 1000 + self.idle_ms
        self.last.update((*state[:4], self._wake(at, state[4])))
        yield from out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802 - Spark's name
        new = [(r.micros, r.event_id, r.value) for r in rows]
        state = self.last.get() or (None, 0, 0, None, None)
        if self.hold:
            self.held.appendList(new)
            yield from self._released(key, state, timerValues.getCurrentWatermarkInMs())
        else:
            state, out = self._taken(key, state, new)
            self.last.update((*state[:4], self._wake(state[3] + self.idle_ms, state[4])))
            yield from out

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        state, watermark = self.last.get(), timerValues.getCurrentWatermarkInMs()
        if state is None:
            return
        state = (*state[:4], None)
        if self.hold and self.held.exists():
            yield from self._released(key, state, watermark)
        elif state[3] is not None and state[3] + self.idle_ms > watermark:
            self.last.update((*state[:4], self._wake(state[3] + self.idle_ms, None)))
        else:
            self.last.clear()

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:  # noqa: N802
        wakes = self._wake(timerValues.getCurrentWatermarkInMs() + self.idle_ms, None)
        self.last.update((initialState.value, initialState.frames, initialState.late, None, wakes))

    def close(self) -> None:
        pass


def motion_state(frames: DataFrame, settings: Settings = DEFAULTS, idle: timedelta = timedelta(days=365), delay: str = "0 seconds", hold: bool = False, start: DataFrame | None = None) -> DataFrame:
    """Motion and the controller's state after each frame of a stream with clip_id, event_id, ts and value; see MotionProcessor.

    `delay` is the watermark's; `start` has clip_id, value, frames and late of clips that
    go on from elsewhere. Without `hold`, frames of a batch are put in order and batches
    are taken as they come.
    """
    rows = frames.select("clip_id", "event_id", "ts", "value").withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    start = start.groupBy("clip_id") if start is not None else None
    return rows.groupBy("clip_id").transformWithState(MotionProcessor(settings, idle, hold), _MOTION, "Append", "EventTime", start)


# ---- metering


def metered(frames: DataFrame, ms: str = "latency_ms", settings: Settings = DEFAULTS, name: str = "meter") -> DataFrame:
    """frames, whose number, 95th percentile and violations of the latency target are measured as each batch passes."""
    late = F.count_if(F.col(ms) > settings.latency_target_ms)
    return frames.observe(name, F.count("*").alias("frames"), F.percentile_approx(ms, 0.95, 10_000).alias("p95_ms"), F.max(ms).alias("max_ms"), late.alias("violations"))


class Meter(StreamingQueryListener):
    """Writes a row for each batch of metered streams below a path: query_id, batch_id, frames, p95_ms, max_ms, violations, batch_ms.

    A batch that runs again replaces its row; batches without input write none.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "meter"):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        m = p.observedMetrics.get(self.name)
        if m is None or not m.frames:
            return
        row = [(str(p.id), int(p.batchId), int(m.frames), float(m.p95_ms), float(m.max_ms), int(m.violations), int(p.batchDuration))]
        kinds = "query_id string, batch_id long, frames long, p95_ms double, max_ms double, violations long, batch_ms long"
        self.spark.createDataFrame(row, kinds).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{p.id}/{p.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


@contextmanager
def metering(spark: SparkSession, path: str) -> Iterator[None]:
    """While it lasts, metered streams write a row for each batch below a path; at its end all rows are there."""
    meter = Meter(spark, path)
    spark.streams.addListener(meter)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        spark.streams.removeListener(meter)


def read_meter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


# ---- event time


def tumbling(events: DataFrame, size: str, *keys: str) -> DataFrame:
    return _counted(events, F.window("ts", size), *keys)


def sliding(events: DataFrame, size: str, step: str, *keys: str) -> DataFrame:
    return _counted(events, F.window("ts", size, step), *keys)


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    return _counted(events, F.session_window("ts", gap), *keys)


def _counted(events: DataFrame, window: Column, *keys: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_hundredths"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "value_hundredths")


def late_dropped(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay)


def once_each(events: DataFrame, key: str, delay: str) -> DataFrame:
    """Repeats of a key inside the watermark are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def with_labels(events: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """A stream joined with a static table."""
    return events.join(labels, key, "left")

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark import config
from tidemark.plans import online
from tidemark.plans import queries as Q
from tidemark.streaming import live

SF = "/root/testdata/sf0.001"
begin = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, rows):
    return spark.createDataFrame([(k, begin + timedelta(minutes=m), clip, "click", float(v)) for k, (clip, m, v) in enumerate(rows)], SCHEMA)


def by_hand(rows, target=100.0, start=None):
    """clip -> (event, frame, motion, downscale, stride) in the order of time."""
    out, state = {}, dict(start or {})
    for event, (clip, _, v) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        value, frames, late = state.get(clip, (None, 0, 0))
        late += v > target
        out.setdefault(clip, []).append((event, frames, round(0.0 if value is None else abs(v - value) * 0.2, 6), max(25, 50 - 10 * late), min(4, late + 1)))
        state[clip] = (v, frames + 1, late)
    return out


def states(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.frame_idx, r.event_id)):
        out.setdefault(r.clip_id, []).append((r.event_id, r.frame_idx, round(r.motion, 6), r.downscale_hundredths, r.skip_stride))
    return out


def clips(rows):
    return rows.withColumnRenamed("user_id", "clip_id")


ROWS = [(k % 3, 7 * k, (37 * k) % 160) for k in range(60)]


def test_state_goes_over_five_triggers(spark):
    starts = []
    real = live.finish
    try:
        live.finish = lambda stream, **kw: starts.append(1) or real(stream, **kw)
        got = states(live.replay(events(spark, ROWS), lambda r: live.motion_state(clips(r))))
    finally:
        live.finish = real
    assert len(starts) == 5 and got == by_hand(ROWS)


def in_steps(spark, folder, steps, build):
    """The result of a stream over files that land one step after the other."""
    for rows in steps:
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = live.finish(build(live.stream_events(spark, f"{folder}/in", 100)), folder=folder)
    return out


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state").count()


def test_idle_clips_lose_their_state(spark, tmp_path):
    rows = events(spark, [(1, 0, 5), (2, 1, 5), (1, 300, 9), (1, 310, 4), (2, 320, 7), (1, 900, 3)])
    steps = [rows.where(F.col("event_id").isin(*ids)) for ids in ([0, 1], [2, 3], [4], [5])]
    folder = str(tmp_path)
    build = lambda r: live.motion_state(clips(r), idle=timedelta(minutes=200))
    in_steps(spark, folder, steps[:1], build)
    assert state_rows(spark, folder, "last") == 2
    out = in_steps(spark, folder, steps[1:], build)
    # both were idle for over 200 minutes before they came again, and clip 2 is idle at the end
    assert states(out) == {1: [(0, 0, 0.0, 50, 1), (2, 0, 0.0, 50, 1), (5, 0, 0.0, 50, 1), (3, 1, 1.0, 50, 1)], 2: [(1, 0, 0.0, 50, 1), (4, 0, 0.0, 50, 1)]}
    assert state_rows(spark, folder, "last") == 1


def test_held_frames_are_taken_in_order_however_they_land(spark, tmp_path):
    rows = events(spark, [*ROWS, (9, 10_000, 0)])
    deal = [rows.where(f"event_id % 5 in ({k}) and event_id < 30 or event_id % 5 = {4 - k} and event_id between 30 and 59") for k in range(5)]
    got = states(in_steps(spark, str(tmp_path), [*deal, rows.where("event_id = 60")], lambda r: live.motion_state(clips(r), delay="10 hours", hold=True)))
    got.pop(9, None)  # the frame that moves the watermark waits on
    assert got == by_hand(ROWS)


def test_initial_state(spark, tmp_path):
    start = spark.createDataFrame([(1, 50.0, 7, 1), (5, 1.0, 2, 0)], "clip_id long, value double, frames int, late int")
    rows = [(1, 0, 40), (1, 5, 120), (2, 6, 10)]
    out = in_steps(spark, str(tmp_path), [events(spark, rows)], lambda r: live.motion_state(clips(r), start=start))
    assert states(out) == by_hand(rows, start={1: (50.0, 7, 1)})


def test_repeats_are_dropped_over_triggers(spark):
    table = spark.read.parquet(f"{SF}/events.parquet")
    out = Q.stream_once_each(spark, SF)
    assert out.count() == table.count() == out.distinct().count()


def test_meter_writes_a_row_for_each_batch(spark, tmp_path):
    rows = events(spark, [(k % 3, k, (37 * k) % 160) for k in range(90)])
    with live.metering(spark, str(tmp_path / "meter")):
        build = lambda r: live.metered(r, "value").select("event_id", "user_id")
        in_steps(spark, str(tmp_path), [rows.where(f"event_id % 3 = {k}") for k in range(3)], build)
    got = live.read_meter(spark, str(tmp_path / "meter")).orderBy("batch_id").collect()
    target = config.DEFAULTS.latency_target_ms
    want = rows.groupBy(F.expr("event_id % 3").alias("k")).agg(F.count("*").alias("n"), F.percentile_approx("value", 0.95).alias("p"), F.max("value").alias("m"), F.count_if(F.col("value") > target).alias("v")).orderBy("k").collect()
    assert [(r.frames, r.p95_ms, r.max_ms, r.violations) for r in got] == [(r.n, r.p, r.m, r.v) for r in want] and len({r.query_id for r in got}) == 1


@pytest.mark.parametrize("query", [Q.avi_frame_scan])
def test_clips_of_whole_tables(spark, query):
    assert query(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_a_batch_of_many_uploads_takes_few_tasks(spark, tmp_path, monkeypatch):
    rows = events(spark, [(k % 700, k, k % 160) for k in range(1000)]).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("props", F.lit('{"k": 1}'))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    started, real = [], online.run_live
    monkeypatch.setattr(online, "run_live", lambda *args, **kw: started.append(real(*args, **kw)) or started[0])
    before = spark.conf.getAll
    out = Q.live_uploads(spark, str(tmp_path))
    want = {(k, {3: "unsupported type", 4: "unreadable"}.get(k % 10, "report")) for k in range(700)}
    got = out.collect()
    assert len(got) == 700 and {tuple(r) for r in got} == want and spark.conf.getAll == before
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(str(started[0].runId)) for s in tracker.getJobInfo(job).stageIds]
    tasks = [s.numTasks for s in stages if s]
    assert len(tasks) > 20 and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


class Store:
    """A value state, a list state and timers that count the calls they get."""

    def __init__(self):
        self.calls, self.value, self.at = 0, None, set()

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def _call(self):
        self.calls += 1

    def exists(self):
        self._call()
        return self.value is not None

    def get(self):
        self._call()
        return self.value

    def update(self, value):
        self._call()
        self.value = value

    def registerTimer(self, at):
        self._call()
        self.at.add(at)

    def deleteTimer(self, at):
        self._call()
        self.at.remove(at)


def test_a_batch_reads_and_writes_a_clip_state_once():
    store, made = Store(), live.MotionProcessor(config.DEFAULTS, timedelta(days=1), False)
    made.init(store)
    frame = lambda e, v: Row(micros=e * 1_000_000, event_id=e, value=v)
    got = list(made.handleInputRows((7,), iter([frame(2, 30.0), frame(1, 10.0)]), None))
    assert store.calls == 3 and store.at == {2_000 + 86_400_000}
    got += list(made.handleInputRows((7,), iter([frame(3, None), frame(4, 130.0)]), None))
    assert store.calls == 5 and len(store.at) == 1
    assert [(r.event_id, r.frame_idx, r.motion, r.skip_stride) for r in got] == [(1, 0, 0.0, 1), (2, 1, 4.0, 1), (3, 2, None, 1), (4, 3, None, 2)]

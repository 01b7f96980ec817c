"""The stream by event time against the batch guard, with files in any order and with late frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cliplane.operators import boxes as bx
from cliplane.sources import views
from cliplane.streaming import ordered

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(seed, n=300):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return [(i, start + dt.timedelta(seconds=rng.randint(0, 400) * 10), rng.randint(0, 4), rng.choice(["signup", "view", "click", "error"]), float(rng.randint(0, 490))) for i in range(n)]


def close(rows):
    """An event of nobody, long after all others, that lets the watermark pass them."""
    return [(10**6, max(r[1] for r in rows) + dt.timedelta(days=40), -1, "view", 0.0)]


def batch_switches(spark, tmp_path, rows):
    d = str(tmp_path / "batch")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/events.parquet")
    frame = F.row_number().over(bx.Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("clip"), frame.alias("frame"), "event_id")
    found = bx.iou_with_previous(views.boxes(spark, d)).where("box_iou_prev < 0.3").join(ids, ["clip", "frame"])
    return {r.event_id for r in found.collect()}


@pytest.mark.parametrize("seed", [1])
def test_files_in_any_order(spark, tmp_path, seed):
    rows = events(seed)
    shuffled = random.Random(seed).sample(rows, len(rows))
    folder = str(tmp_path / "stream")
    for k, part in enumerate([shuffled[:70], shuffled[70:200], shuffled[200:], close(rows)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    found, late = ordered.judged(spark, folder, spark.createDataFrame([], SCHEMA).schema, "2 hours")
    got = found.collect()
    assert late == 0 and sorted(r.event_id for r in got) == sorted(r[0] for r in rows)
    assert {r.event_id for r in got if r.switched} == batch_switches(spark, tmp_path, rows)


def test_frames_behind_the_watermark_are_told(spark, tmp_path):
    rows = events(2, 100)
    last = max(r[1] for r in rows)
    too_late = [(500 + i, last - dt.timedelta(hours=3 + i), 1, "view", 1.0) for i in range(3)]
    folder = str(tmp_path / "stream")
    for part in (rows, [(400, last + dt.timedelta(hours=1), 2, "view", 1.0)], too_late, close(rows)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    found, late = ordered.judged(spark, folder, spark.createDataFrame([], SCHEMA).schema, "10 minutes")
    assert late == 3 and {r.event_id for r in found.collect()} == {r[0] for r in rows} | {400}


def test_a_micro_batch_waits_as_one_value():
    """Frames of a clip are packed as one value of the state, and no table is sent back for a clip that only waits."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.values, self.timers = [], []

        def getListState(self, *_):  # noqa: N802
            return self

        def getValueState(self, *_):  # noqa: N802
            return self

        def appendValue(self, value):  # noqa: N802
            self.values.append(value)

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

    handle, one = Handle(), ordered.Ordered()
    one.init(handle)
    rows = pd.DataFrame({"ms": [30, 10, 20], "event_id": [3, 1, 2], **{c: [0.5, 1.5, 2.5] for c in ordered.BOX}})
    assert list(one.handleInputRows((1,), iter([rows]), None)) == []
    assert len(handle.values) == 1 and handle.timers == [30]
    assert ordered.np.frombuffer(handle.values[0][0], ordered.FRAME)["event_id"].tolist() == [3, 1, 2]

"""The subject-switch guard over a stream by event time: frames wait until the watermark has passed them and are judged in order.

State of a clip: the frames that wait, packed as one value for each micro-batch, and the last one that was judged. A frame is judged when no earlier one can come any more,
whatever the order in which files or micro-batches bring them. Frames behind the watermark are dropped, and the stream's progress
tells how many. Overlaps are computed by column over all frames that a clip gives free at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cliplane.session import shared_dir

BOX = ["x1", "y1", "x2", "y2", "score"]
ROW = "ms long, event_id long, x1 double, y1 double, x2 double, y2 double, score double"
#: A frame as it waits.
FRAME = np.dtype([("ms", "<i8"), ("event_id", "<i8"), *((c, "<f8") for c in BOX)])
OUT = "clip long, event_id long, switched boolean"
LIMIT = 0.3
STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def switched(boxes: np.ndarray) -> np.ndarray:
    """Whether each box (x1, y1, x2, y2, score) after the first overlaps the one before too little; both must be detected."""
    old, new = boxes[:-1], boxes[1:]
    side = lambda a, b: np.maximum(0.0, np.minimum(old[:, b], new[:, b]) - np.maximum(old[:, a], new[:, a]))
    area = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    inter = side(0, 2) * side(1, 3)
    union = area(old) + area(new) - inter
    iou = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
    return (old[:, 4] > 0) & (new[:, 4] > 0) & (iou < LIMIT)


class Ordered(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frames binary")
        self.last = handle.getValueState("last", ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            fresh = np.empty(len(pdf), FRAME)
            for c in FRAME.names:
                fresh[c] = pdf[c].to_numpy()
            self.waiting.appendValue((fresh.tobytes(),))
            self.handle.registerTimer(int(fresh["ms"].max()))  # when this one is free, all before it are
        yield from ()  # a table without rows for each clip would cost more than the frames

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        free = timerValues.getCurrentWatermarkInMs()
        held = np.frombuffer(b"".join(bytes(r[0]) for r in self.waiting.get()), FRAME)
        held = held[np.lexsort([held[c] for c in reversed(FRAME.names)])]
        ready, rest = held[held["ms"] <= free], held[held["ms"] > free]
        if not len(ready):
            return
        self.waiting.clear()
        if len(rest):
            self.waiting.appendValue((rest.tobytes(),))
            self.handle.registerTimer(int(rest["ms"][-1]))
        before = self.last.get() if self.last.exists() else (0, 0, 0.0, 0.0, 0.0, 0.0, -1.0)
        self.last.update(ready[-1].item())
        boxes = np.concatenate([[tuple(before)[2:]], np.stack([ready[c] for c in BOX], axis=1)])
        yield pd.DataFrame({"clip": key[0], "event_id": ready["event_id"], "switched": switched(boxes)})

    def close(self) -> None:
        pass


def boxes(events: DataFrame) -> DataFrame:
    """clip, ts, ms, event_id and the box of each event; errors are undetected frames."""
    none = F.col("event_type") == "error"
    x1 = 100.0 + (F.col("event_id") * 37 % 10) * 8 + F.when(F.col("event_type") == "signup", 500).otherwise(0)
    y1 = 60.0 + (F.col("event_id") * 53 % 10) * 5
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").alias("clip"), ts.alias("ts"), F.unix_millis(ts).alias("ms"), "event_id", F.when(none, 0.0).otherwise(x1).alias("x1"), F.when(none, 0.0).otherwise(y1).alias("y1"),
        F.when(none, 1280.0).otherwise(x1 + 200 + F.col("value")).alias("x2"), F.when(none, 720.0).otherwise(y1 + 400).alias("y2"), F.when(none, -1.0).otherwise(0.5 + F.col("value") / 1000).alias("score"),
    )


def switches(events: DataFrame, delay: str) -> DataFrame:
    """Stream of (clip, event_id, switched) from a stream of events that come at most so late."""
    own = boxes(events).withWatermark("ts", delay)
    return own.groupBy("clip").transformWithStateInPandas(Ordered(), OUT, "append", "EventTime")


def judged(spark: SparkSession, folder: str, schema, delay: str, files: int = 1) -> tuple[DataFrame, int]:
    """(what the stream says about the files that lie in a folder, frames that were too late). files: how many make a micro-batch."""
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    stream = switches(events, delay).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, PROVIDER)  # the only one that keeps lists and timers
    try:
        job = stream.trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    job.awaitTermination()
    late = sum(int(s["numRowsDroppedByWatermark"]) for p in job.recentProgress for s in p["stateOperators"])
    return spark.read.schema(OUT).parquet(f"{run}/out"), late

"""The subject-switch guard over a stream: the last box of each clip is the state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "clip long, frame long, switched boolean"
STATE = "frame long, x1 double, y1 double, x2 double, y2 double, score double"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Frames of one clip in the order of time within a batch; batches follow one another."""
    held = state.get if state.exists else (-1, 0.0, 0.0, 0.0, 0.0, -1.0)
    frame, before = held[0], held[1:]
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for r in rows.itertuples():
        frame += 1
        now = (r.x1, r.y1, r.x2, r.y2, r.score)
        inter = max(0.0, min(now[2], before[2]) - max(now[0], before[0])) * max(0.0, min(now[3], before[3]) - max(now[1], before[1]))
        union = (now[2] - now[0]) * (now[3] - now[1]) + (before[2] - before[0]) * (before[3] - before[1]) - inter
        out.append((key[0], frame, bool(now[4] > 0 and before[4] > 0 and (inter / union if union > 0 else 0.0) < 0.3)))
        before = now
    state.update((frame, *before))
    yield pd.DataFrame(out, columns=["clip", "frame", "switched"])


def switches(events: DataFrame) -> DataFrame:
    """Stream of (clip, frame, switched) from a stream of events."""
    none = F.col("event_type") == "error"
    x1 = 100.0 + (F.col("event_id") * 37 % 10) * 8 + F.when(F.col("event_type") == "signup", 500).otherwise(0)
    y1 = 60.0 + (F.col("event_id") * 53 % 10) * 5
    boxes = events.select(
        F.col("user_id").alias("clip"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(none, 0.0).otherwise(x1).alias("x1"), F.when(none, 0.0).otherwise(y1).alias("y1"),
        F.when(none, 1280.0).otherwise(x1 + 200 + F.col("value")).alias("x2"), F.when(none, 720.0).otherwise(y1 + 400).alias("y2"), F.when(none, -1.0).otherwise(0.5 + F.col("value") / 1000).alias("score"),
    )
    return boxes.groupBy("clip").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def subject_switch(spark: SparkSession, path: str) -> DataFrame:
    """Run the stream over what is there and count the switches of each clip."""
    schema = spark.read.parquet(path).schema
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="cliplane-stream-")
    run = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    job = switches(events).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{run}/out").where("switched").groupBy("clip").agg(F.count("*").alias("flagged"))

"""Queries of samples met with frames and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cliplane.operators import sound
from cliplane.plans.catalog import query
from cliplane.sources import views as v

RATE, FPS = 1000, (24000, 1001)
#: Every event of a user is a block of 20 to 79 samples, in the order of time; the first begins a little before or after the video.
_BLOCKS = """nb AS (SELECT user_id AS clip, event_id, row_number() OVER w AS number, 20 + event_id % 60 AS n, user_id % 7 - 3 AS shift FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
bl AS (SELECT *, shift + coalesce(sum(n) OVER (PARTITION BY clip ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM nb), sm AS (SELECT clip, pos + i AS pos, (event_id * 13 + i * i * 7) % 101 AS s FROM bl, range(80) t(i) WHERE i < n)"""


def _blocks(spark, d):
    e = v.table(spark, d, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    values = F.transform(F.sequence(F.lit(0).cast("long"), 19 + F.col("event_id") % 60), lambda i: ((F.col("event_id") * 13 + i * i * 7) % 101).cast("double"))
    shift = (F.col("user_id") % 7 - 3) / float(RATE)
    df = e.select(F.col("user_id").alias("clip"), number.alias("number"), shift.alias("time"), values.alias("samples"))
    return sound.placed(df, RATE)


@query(f"""WITH {_BLOCKS}, fr AS (SELECT clip, number - 1 AS frame, round_even((number - 1) * {RATE * FPS[1]} / {FPS[0]}e0, 0)::BIGINT AS b0, round_even(number * {RATE * FPS[1]} / {FPS[0]}e0, 0)::BIGINT AS b1 FROM nb)
SELECT fr.clip, frame, min(pos) AS "at", count(*) AS samples, sum(s * (pos - b0 + 1))::BIGINT AS level FROM fr JOIN sm ON sm.clip = fr.clip AND pos >= b0 AND pos < b1 GROUP BY 1, 2""")
def sound_by_frame(spark, d):
    """A frame for each event, at 24000/1001 frames a second and 1000 samples a second."""
    blocks = _blocks(spark, d)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    frames = v.table(spark, d, "events").select(F.col("user_id").alias("clip"), (number - 1).alias("frame"))
    found = sound.by_frame(blocks, frames, RATE, FPS, 512)
    edges = sound.frame_edges(frames, RATE, FPS).select("clip", "frame", "b0")
    level = F.aggregate(F.transform("samples", lambda s, i: s * (F.col("at") + i - F.col("b0") + 1)), F.lit(0.0), lambda a, x: a + x).cast("long")
    return found.join(edges, ["clip", "frame"]).select("clip", "frame", "at", F.size("samples").cast("long").alias("samples"), level.alias("level"))


@query(f"""WITH {_BLOCKS}, aw AS (SELECT clip, -2::BIGINT AS b0, 1500 + clip * 31 - 2 AS b1 FROM nb GROUP BY 1), e AS (SELECT sm.clip, min(sm.pos) AS low, max(sm.pos) + 1 AS high, sum(s * (sm.pos - b0 + 1))::BIGINT AS level, any_value(b0) AS b0 FROM sm JOIN aw ON aw.clip = sm.clip AND sm.pos >= b0 AND sm.pos < b1 GROUP BY 1)
SELECT clip, b0 AS "at", high - b0 AS samples, level FROM e""")
def sound_window(spark, d):
    """One part of every clip's sound, from a little before the video on."""
    blocks = _blocks(spark, d)
    asks = blocks.select("clip").distinct().select("clip", F.lit(-0.002).alias("start"), ((1500 + F.col("clip") * 31) / float(RATE)).alias("duration"))
    found = sound.window(blocks, asks, RATE, 512)
    level = F.aggregate(F.transform("samples", lambda s, i: s * (i + 1)), F.lit(0.0), lambda a, x: a + x).cast("long")
    return found.select("clip", "at", F.size("samples").cast("long").alias("samples"), level.alias("level"))

"""Blocks of samples met with frames and windows of time: an interval join by bins, with blocks split at exact edges.

Samples are rows of blocks (clip, at, samples): the number of a block's first sample and its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a bin, by which blocks and frames meet.
BIN = 4096


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int = BIN) -> DataFrame:
    """Rows of both whose intervals [a0, a1) and [b0, b1) overlap, for equal keys. Both are sent to the bins that they touch, so a
    key with very many rows spreads over its bins; a pair is kept in the first bin that it shares."""
    div = lambda c: F.floor(c / bin_size)
    bins = lambda a, b: F.explode(F.sequence(div(F.col(a)), div(F.col(b) - 1))).alias("__bin")
    one, two = left.where("a1 > a0").select("*", bins("a0", "a1")), right.where("b1 > b0").select("*", bins("b0", "b1"))
    # blocks and bins are exploded, which the planner takes for small: never broadcast
    met = one.hint("merge").join(two.hint("merge"), [*keys, "__bin"]).where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    return met.where(F.col("__bin") == F.greatest(div(F.col("a0")), div(F.col("b0")))).drop("__bin")


def rounded_ratio(n: Column, num: int, den: int) -> Column:
    """n * num / den at the nearest whole number, halves to even, in whole numbers."""
    twice = 2 * n * num + den
    rest = F.pmod(twice, F.lit(2 * den))
    up = ((twice - rest) / (2 * den)).cast("long")
    tie = rest == 0
    return F.when(tie & (F.pmod(up, F.lit(2)) == 1), up - 1).otherwise(up)


def frame_edges(frames: DataFrame, sample_rate: int, fps: tuple[int, int]) -> DataFrame:
    """clip, frame, b0, b1: the samples that belong to each frame of a video at an exact rate: those that cover the frames up to it
    less those that cover the frames before."""
    edge = lambda k: rounded_ratio(k, sample_rate * fps[1], fps[0])
    return frames.select("clip", "frame", edge(F.col("frame")).alias("b0"), edge(F.col("frame") + 1).alias("b1"))


def by_frame(blocks: DataFrame, frames: DataFrame, sample_rate: int, fps: tuple[int, int], bin_size: int = BIN) -> DataFrame:
    """clip, frame, at, samples: the samples of each frame; the sound ends where the video or the sound itself does."""
    left = blocks.select("clip", F.col("at").alias("a0"), (F.col("at") + F.size("samples")).alias("a1"), "samples")
    met = interval_join(left, frame_edges(frames, sample_rate, fps), ["clip"], bin_size)
    return _cut(met, ["clip", "frame"])


def _cut(met: DataFrame, keys: list[str]) -> DataFrame:
    low, high = F.greatest("a0", "b0"), F.least("a1", "b1")
    piece = F.slice("samples", (low - F.col("a0") + 1).cast("int"), (high - low).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(low.alias("at"), piece.alias("samples"))))
    return met.groupBy(*keys).agg(parts.alias("p")).select(*keys, F.col("p")[0]["at"].alias("at"), F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"))


def placed(blocks: DataFrame, sample_rate: int, origin: float = 0.0) -> DataFrame:
    """Blocks (clip, number, time, samples; time null: where the one before ended) with at: the first block's time from the origin as
    a sample, the others right behind one another."""
    by = Window.partitionBy("clip").orderBy("number")
    before = F.coalesce(F.sum(F.size("samples")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("time").over(by)
    start = F.coalesce(F.bround((first - origin) * sample_rate, 0).cast("long"), F.lit(0))
    return blocks.select("clip", (start + before).alias("at"), "samples")


def window(blocks: DataFrame, asks: DataFrame, sample_rate: int, bin_size: int = BIN) -> DataFrame:
    """clip, at, samples of the part of each clip's sound from start for duration seconds (asks: clip, start, duration), counted from
    the window's first sample; it is shorter where the sound ends first and silent before the sound begins."""
    edge = lambda c: F.bround(F.col(c) * sample_rate, 0).cast("long")
    asked = asks.select("clip", edge("start").alias("b0"), (edge("start") + edge("duration")).alias("b1"))
    left = blocks.select("clip", F.col("at").alias("a0"), (F.col("at") + F.size("samples")).alias("a1"), "samples")
    # bins are made only where there is sound: a window may ask for far more than its clip has
    heard = left.groupBy("clip").agg(F.min("a0").alias("__low"), F.max("a1").alias("__high"))
    asked = asked.join(heard, "clip").select("clip", F.col("b0").alias("start"), F.greatest("b0", "__low").alias("b0"), F.least("b1", "__high").alias("b1"))
    met = interval_join(left, asked.hint("merge"), ["clip"], bin_size)
    found = _cut(met, ["clip", "start"]).withColumnRenamed("start", "b0")
    silence = F.array_repeat(F.lit(0.0), (F.col("at") - F.col("b0")).cast("int"))
    return found.select("clip", F.col("b0").alias("at"), F.concat(silence, "samples").alias("samples"))

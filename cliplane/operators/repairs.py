"""Rules that read a track's masks alone: pieces gained after the birth, parts lost for good, points in lost regions, and the memory a repair reads.

Masks are pixel tables (clip, frame, x, y); births is clip, birth (-1: none). All is set-based; only the largest connected piece of
a frame's pixels, and the points well inside a region, are found by a task that holds that one frame or region.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.operators.masks import FRAME, by_frame, gathered, merged, regions
from cliplane.operators.sequence import closest_conditioning
from cliplane.operators.tracking import MEMORY_SCORE

#: A gained piece's share of the mask, the frames it must come within and last, and how much of it must last.
GAIN_SHARE, GAIN_WINDOW, KEPT_FRAMES, KEPT_TENTHS = 0.15, 16, 5, 8
#: A lost piece's share of the mask before, and the share of its area under which the mask stays.
LOST_SHARE, BACK_AREA = 0.08, 0.92


def largest_piece(px: DataFrame, width: int, height: int) -> DataFrame:
    """clip, frame, piece: the pixel numbers of each frame's largest piece (sides connect; ties: the first in scan order)."""

    def pick(clips: pa.Array, frames: pa.Array, stack: np.ndarray) -> pa.RecordBatch:
        out = []
        for mask in stack:
            label, n = regions(mask, False)
            out.append(np.flatnonzero(label == 1 + np.bincount(label.ravel(), minlength=n + 1)[1:].argmax()).astype(np.int32))
        return pa.RecordBatch.from_arrays([clips.cast(pa.int64()), frames.cast(pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["clip", "frame", "piece"])

    return by_frame(gathered(px, width).where(F.size("on") > 0), pick, width, height, "clip long, frame long, piece array<int>")


def _with_before(masks: DataFrame) -> DataFrame:
    """masks with before: what the frame right before holds (null without one)."""
    w = Window.partitionBy("clip").orderBy("frame")
    return masks.withColumn("before", F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.lag("on").over(w)))


def gained(px: DataFrame, births: DataFrame, frames: DataFrame, width: int, height: int) -> DataFrame:
    """clip, frame, share: the last frame within GAIN_WINDOW of the birth on which the track gained a large piece that it keeps.

    frames: clip, n (frames from 0). A frame counts if KEPT_FRAMES frames follow it, the largest piece that the frame before lacks is
    GAIN_SHARE of the mask or more, and each of the following frames holds KEPT_TENTHS tenths of it."""
    px = gathered(px, width)
    ask = births.where("birth >= 0").join(frames, "clip")
    last = F.least(F.col("birth") + GAIN_WINDOW, F.col("n") - 1 - KEPT_FRAMES)
    ask = ask.where(last > F.col("birth")).select("clip", F.explode(F.sequence(F.col("birth") + 1, last)).alias("frame"))
    now = merged(_with_before(px)).join(ask, FRAME)
    fresh = F.when(F.col("before").isNull(), F.col("on")).otherwise(F.array_except("on", "before"))
    area = F.size("on")
    new = now.select(*FRAME, fresh.alias("on"), area.alias("area")).where((F.size("on") > 0) & (F.size("on") >= GAIN_SHARE * F.col("area")))
    size = largest_piece(new, width, height).join(merged(new.select(*FRAME, "area")), FRAME).where(F.size("piece") >= GAIN_SHARE * F.col("area"))
    ahead = size.withColumn("later", F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + KEPT_FRAMES)))
    met = merged(ahead).join(px.select("clip", F.col("frame").alias("later"), "on"), ["clip", "later"])
    held = met.where(10 * F.size(F.array_intersect("piece", "on")) >= KEPT_TENTHS * F.size("piece"))
    held = held.groupBy(*FRAME).agg(F.count("*").alias("frames"), F.first(F.size("piece") / F.col("area")).alias("share"))
    good = held.where(F.col("frames") == KEPT_FRAMES)
    return good.groupBy("clip").agg(F.max(F.struct("frame", "share")).alias("found")).select("clip", "found.frame", "found.share")


def lost_for_good(px: DataFrame, births: DataFrame, width: int, height: int) -> DataFrame:
    """clip, frame, last, share: the first frame of each stretch of frames with a mask on which a part is lost for the rest of it.

    From the birth on: the mask stays at or under BACK_AREA of the frame before's area up to the stretch's last frame, and the largest
    piece that is gone is LOST_SHARE of that area or more."""
    px = gathered(px, width)
    area = px.where(F.size("on") > 0).select(*FRAME, F.size("on").cast("long").alias("area")).join(births.where("birth >= 0"), "clip").where(F.col("frame") >= F.col("birth")).select(*FRAME, "area")
    by_frame = Window.partitionBy("clip").orderBy("frame")
    area = area.withColumn("stretch", F.col("frame") - F.row_number().over(by_frame))
    in_stretch = Window.partitionBy("clip", "stretch")
    backwards = in_stretch.orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    area = area.select("*", F.max("area").over(backwards).alias("highest"), F.max("frame").over(in_stretch).alias("last"), F.lag("area").over(in_stretch.orderBy("frame")).alias("before"))
    ask = area.where(F.col("highest") <= BACK_AREA * F.col("before"))
    both = merged(_with_before(px)).join(ask.select(*FRAME), FRAME)
    size = largest_piece(both.select(*FRAME, F.array_except("before", "on").alias("on")), width, height).select(*FRAME, F.size("piece").alias("size"))
    found = ask.join(size, FRAME).withColumn("share", F.col("size") / F.col("before")).where(F.col("share") >= LOST_SHARE)
    first = found.groupBy("clip", "stretch").agg(F.min(F.struct("frame", "last", "share")).alias("f"))
    return first.select("clip", "f.frame", "f.last", "f.share")


def region_frames(found: DataFrame, births: DataFrame, masked: DataFrame) -> DataFrame:
    """clip, frame, points, holding: the frames to repair. found: clip, number, start, length, anchors, points of each lost region.

    Points of all regions that a frame lacks, in their order, and the frames that hold them around it; frames before the birth and
    frames without a mask (masked: clip, frame with one) are left out."""
    each = found.join(births.where("birth >= 0"), "clip").select("clip", "birth", "number", "points", "anchors", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("frame"))
    each = each.where(F.col("frame") >= F.col("birth")).join(masked.select(*FRAME).distinct(), FRAME, "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("number", "points")))
    holding = F.array_sort(F.array_distinct(F.flatten(F.collect_list("anchors"))))
    return each.groupBy(*FRAME).agg(F.flatten(F.transform(parts, lambda p: p["points"])).alias("points"), holding.alias("holding"))


def held_words(holding: Column) -> Column:
    """The words for points in a region that these frames hold around a frame that drops it."""
    first = F.array_join(F.transform(F.slice(holding, 1, F.size(holding) - 1), lambda f: f.cast("string")), ", ")
    return F.concat(F.lit("in a region the mask dropped (held on frames "), first, F.lit(" and "), F.element_at(holding, -1).cast("string"), F.lit(")"))


def kept_memory(frames: DataFrame, stored: DataFrame, lookback: int, count: int) -> DataFrame:
    """clip, frame, t: what of the stored outputs (clip, frame, score) is kept once a frame is done: those at most lookback frames
    back, and of older ones those among the count newest up to it that pass the memory score (frame 0 excluded)."""
    w = Window.partitionBy("clip").orderBy("frame")
    passing = (F.col("score") > MEMORY_SCORE) & (F.col("frame") > 0)
    ranked = stored.withColumn("passes", passing).withColumn("number", F.sum(passing.cast("int")).over(w))
    upto = frames.select(*FRAME).join(ranked.select(*FRAME, "number"), FRAME, "left")
    upto = upto.withColumn("upto", F.coalesce(F.last("number", True).over(w), F.lit(0)))
    newest = upto.where("upto > 0").select(*FRAME, F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("upto") - count + 1), F.col("upto"))).alias("number"))
    newest = newest.join(ranked.where("passes").select("clip", "number", F.col("frame").alias("t")), ["clip", "number"]).select(*FRAME, "t")
    near = frames.select(*FRAME, F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("frame") - lookback), F.col("frame"))).alias("t"))
    near = near.join(stored.select("clip", F.col("frame").alias("t")), ["clip", "t"]).select(*FRAME, "t")
    return near.unionByName(newest).distinct()


def memory_places(chosen: DataFrame) -> DataFrame:
    """clip, frame, t, place, pointer: chosen (clip, frame, t) as the tracker reads it: the k-th newest stands k frames before the frame;
    the oldest carries no pointer to the object."""
    newest = Window.partitionBy(*FRAME).orderBy(F.desc("t"))
    n = F.count("*").over(Window.partitionBy(*FRAME))
    rank = F.row_number().over(newest)
    return chosen.select(*FRAME, "t", rank.alias("rank"), n.alias("n")).select(*FRAME, "t", (F.col("frame") - F.col("rank")).alias("place"), (F.col("rank") < F.col("n")).alias("pointer"))


def second_view(frames: DataFrame, conditioning: DataFrame, keep: int, selection: bool) -> DataFrame:
    """clip, frame, conditions, memory: sorted conditioning frames that a second pass reads at a frame, and (without selection) the
    unselected ones before it, which are ordinary memory."""
    chosen = closest_conditioning(frames, conditioning, keep).groupBy(*FRAME).agg(F.array_sort(F.collect_list("t")).alias("conditions"))
    none = F.expr("CAST(array() AS array<bigint>)")
    df = frames.select(*FRAME).join(chosen, FRAME, "left").withColumn("conditions", F.coalesce("conditions", none))
    if selection:
        return df.withColumn("memory", none)
    # the conditioning frames up to a frame, as a running list; a clip has few of them
    marks = df.join(conditioning.select(*FRAME).distinct().withColumn("mark", F.col("frame")), FRAME, "left")
    before = F.collect_list("mark").over(Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1))
    return marks.select(*FRAME, "conditions", F.array_except(before, F.col("conditions")).alias("memory"))


def first_influenced(frames: DataFrame, conditioning: DataFrame, baseline: DataFrame, refined: DataFrame, keep: int, selection: bool = False) -> DataFrame:
    """clip, frame: the first frame whose view in the second pass holds a refined frame, or other frames than with the first pass's
    conditioning frames (baseline). Clips without such a frame have no row."""
    a, b = second_view(frames, conditioning, keep, selection), second_view(frames, baseline, keep, selection)
    own = refined.groupBy("clip").agg(F.collect_set("frame").alias("refined"))
    df = a.join(b.select(*FRAME, F.col("conditions").alias("c2"), F.col("memory").alias("m2")), FRAME).join(own, "clip", "left")
    touched = F.coalesce(F.arrays_overlap(F.concat("conditions", "memory"), "refined"), F.lit(False))
    return df.where(touched | (F.col("conditions") != F.col("c2")) | (F.col("memory") != F.col("m2"))).groupBy("clip").agg(F.min("frame").alias("frame"))

"""State and choices of a mask tracker: prompt points, anchors, memory, frames that condition, and background taken in by mistake."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.operators.masks import FRAME, PIXEL, areas, regions
from cliplane.operators.pose import DRAW, at, drawn

#: Points between joints (limbs as pairs, shares of the way), the tracker's square, windows and thresholds.
BETWEEN = [(8, 9), (11, 12), (9, 10), (12, 13), (2, 3), (5, 6), (10, 19), (13, 18)]
PROMPTS, TORSO_SHARES, LIMB_SHARES = [0, 1, 2, 5, 8, 11, 10, 13, 18, 19], (0.35, 0.65), (0.5,)
SQUARE, DEMOTION, MEMORY_SCORE, CLEARANCE = 1008, 16, 0.01, 0.04


# ---------------------------------------------------------------- prompts


def body_points(width: int, height: int, threshold: float = DRAW) -> Column:
    """Points of a body (in pixels) between its joints: down the torso, then amid each limb with both ends drawn. Without a drawn hip
    the torso is followed from the shoulders by one and two of their distances (0.15 frame widths if they coincide)."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    way = lambda a, b, t: point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))
    mean = lambda a, b: point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    top, right, left = mean(at(2), at(5)), drawn(8, threshold), drawn(11, threshold)
    hip = F.when(right & left, mean(at(8), at(11))).when(right, point(at(8)["x"], at(8)["y"])).when(left, point(at(11)["x"], at(11)["y"]))
    across = F.abs(at(2)["x"] - at(5)["x"])
    span = F.when(across > 0, across).otherwise(0.15 * width)
    below = F.array(*[point(top["x"], F.least(top["y"] + t * span, F.lit(0.99 * height))) for t in (1.0, 2.0)])
    torso = F.when(hip.isNotNull(), F.array(*[way(top, hip, t) for t in TORSO_SHARES])).otherwise(below)
    limbs = [F.when(drawn(a, threshold) & drawn(b, threshold), way(at(a), at(b), t)) for a, b in BETWEEN for t in LIMB_SHARES]
    none = F.expr("CAST(array() AS array<struct<x:double,y:double>>)")
    return F.concat(F.when(drawn(2, threshold) & drawn(5, threshold), torso).otherwise(none), F.array_compact(F.array(*limbs)))


def positive_points(width: int, height: int, threshold: float = DRAW) -> Column:
    """The drawn prompt keypoints of a body, then its points between the joints."""
    own = F.array_compact(F.array(*[F.when(drawn(j, threshold), F.struct(at(j)["x"].alias("x"), at(j)["y"].alias("y"))) for j in PROMPTS]))
    return F.concat(own, body_points(width, height, threshold))


def to_square(points: Column, width: int, height: int) -> Column:
    """Points in pixels, in the tracker's square."""
    return F.transform(points, lambda p: F.struct((p["x"] / width * SQUARE).alias("x"), (p["y"] / height * SQUARE).alias("y")))


def bounds(width: int, height: int) -> Column:
    """A box (x1, y1, x2, y2) as whole pixels in the frame; null under 8 pixels a side."""
    cut = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(c), F.lit(float(n)))).cast("long")
    x1, y1, x2, y2 = cut("x1", width), cut("y1", height), cut("x2", width), cut("y2", height)
    return F.when((x2 - x1 >= 8) & (y2 - y1 >= 8), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def spread(free: DataFrame, count: int) -> DataFrame:
    """clip, frame, place, x, y: up to count points of the free pixels (clip, frame, x, y, box as of bounds), the middle one in scan
    order of each cell of a square grid over the box."""
    side = int(np.ceil(np.sqrt(count)))
    cell = lambda c: F.floor(((F.col(c) - F.col(f"box.{c}1") + 1) * side - 1) / (F.col(f"box.{c}2") - F.col(f"box.{c}1")))
    inside = (F.col("x") >= F.col("box.x1")) & (F.col("x") < F.col("box.x2")) & (F.col("y") >= F.col("box.y1")) & (F.col("y") < F.col("box.y2"))
    df = free.where(inside).withColumn("cell", cell("y") * side + cell("x"))
    w = Window.partitionBy(*FRAME, "cell")
    df = df.withColumn("k", F.row_number().over(w.orderBy("y", "x")) - 1).withColumn("n", F.count("*").over(w)).where(F.col("k") == F.floor(F.col("n") / 2))
    place = F.row_number().over(Window.partitionBy(*FRAME).orderBy("cell")).cast("long") - 1
    return df.select(*FRAME, place.alias("place"), "x", "y").where(F.col("place") < count)


def background_points(boxes: DataFrame, px: DataFrame, width: int, height: int, count: int = 8, margin: float = 0.04) -> DataFrame:
    """clip, frame, place, x, y: points in each detected box that are farther than margin box diagonals (whole pixels) from the mask of
    the frame before. None without mask in the box. Distances are exact; one frame is one Arrow row, bounded by its size."""
    before = px.groupBy("clip", (F.col("frame") + 1).alias("frame")).agg(F.collect_list((F.col("y") * width + F.col("x")).cast("long")).alias("on"))
    df = boxes.where("score > 0").withColumn("box", bounds(width, height)).where("box IS NOT NULL").select(*FRAME, "box").join(before, FRAME)
    df = df.select(*FRAME, "box.*", "on")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                mask = np.zeros((height, width), bool)
                mask.ravel()[r.on] = True
                mask = mask[r.y1 : r.y2, r.x1 : r.x2]
                if mask.any():
                    y, x = np.nonzero(~near(mask, int(margin * np.hypot(r.x2 - r.x1, r.y2 - r.y1))))
                    yield pd.DataFrame({"clip": r.clip, "frame": r.frame, "x": x + r.x1, "y": y + r.y1, "x1": r.x1, "y1": r.y1, "x2": r.x2, "y2": r.y2})

    free = df.mapInPandas(run, "clip long, frame long, x long, y long, x1 long, y1 long, x2 long, y2 long")
    return spread(free.select(*PIXEL, F.struct("x1", "y1", "x2", "y2").alias("box")), count)


def near(mask: np.ndarray, reach: float) -> np.ndarray:
    """Pixels within reach of a mask, or of each one of a stack, by a disc: for each row offset the rows are widened by running sums."""
    h, w = mask.shape[-2:]
    out, total = np.zeros_like(mask), np.zeros((*mask.shape[:-1], w + 1), np.int32)
    np.cumsum(mask, axis=-1, out=total[..., 1:])
    x = np.arange(w)
    for dy in range(-int(reach), int(reach) + 1):
        half = int(np.sqrt(reach * reach - dy * dy))
        wide = total[..., np.minimum(x + half + 1, w)] > total[..., np.maximum(x - half, 0)]
        a, b = max(0, dy), min(h, h + dy)
        if a < b:
            out[..., a:b, :] |= wide[..., a - dy : b - dy, :]
    return out


def clear_of_hand(points: DataFrame, hand: DataFrame, boxes: DataFrame) -> DataFrame:
    """Derived points (clip, frame, place, label, x, y) without those within CLEARANCE box diagonals of a hand-placed point of the
    other label; hand: clip, frame, label, x, y, a few a frame. Frames without a box are an error of the caller."""
    reach = boxes.select(*FRAME, (CLEARANCE * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("reach"))
    held = hand.groupBy(*FRAME).agg(F.collect_list(F.struct("label", "x", "y")).alias("hand")).join(reach, FRAME)
    df = points.join(held, FRAME, "left")
    close = F.exists("hand", lambda h: (h["label"] != F.col("label")) & (F.hypot(h["x"] - F.col("x"), h["y"] - F.col("y")) <= F.col("reach")))
    return df.where(~F.coalesce(close, F.lit(False))).select(points.columns)


def parse_points(text: Column, width: int, height: int) -> Column:
    """Hand-placed points from JSON text: [{"x", "y"}] in pixels or {"points": [[x, y]]} as shares of the frame; none from null or
    blank text. Text of another form and points off the frame are errors."""
    plain = F.from_json(text, "array<struct<x:double,y:double>>")
    shares = F.get(F.array(F.from_json(text, "struct<points:array<array<double>>>")), F.lit(0))["points"]
    moved = F.transform(shares, lambda p: F.struct((F.get(p, 0) * width).alias("x"), (F.get(p, 1) * height).alias("y")))
    none = F.expr("CAST(array() AS array<struct<x:double,y:double>>)")
    keyed = F.trim(text).startswith("{")
    found = F.when(text.isNull() | (F.trim(text) == ""), none).when(keyed, moved).otherwise(plain)
    out = lambda p: F.coalesce(~((p["x"] >= 0) & (p["x"] < width) & (p["y"] >= 0) & (p["y"] < height)), F.lit(True))
    bad = found.isNull() | F.exists(found, out) | F.coalesce(keyed & F.exists(shares, lambda p: F.size(p) != 2), F.lit(False))
    return F.when(bad, F.raise_error(F.concat(F.lit("not points in the frame: "), text)).cast("array<struct<x:double,y:double>>")).otherwise(found)


def anchors(boxes: DataFrame, pose: DataFrame, threshold: float = DRAW, least: int = 8, sure: float = 0.5, complete: float = 0.9, reference: Column | int = 0) -> DataFrame:
    """clip, frame, sure_points, is_anchor: whether a frame's box and pose may seed the tracker anew. reference: how many sure points
    the running segment was seeded with."""
    on = F.filter("body", lambda p: p["c"] >= threshold)
    n = F.size(on)
    mean = F.try_divide(F.aggregate(on, F.lit(0.0), lambda a, p: a + p["c"]), n)
    needed = F.greatest(F.lit(float(least)), complete * (reference if isinstance(reference, Column) else F.lit(reference)))
    df = boxes.join(pose.select(*FRAME, "body"), FRAME)
    return df.select(*FRAME, n.cast("long").alias("sure_points"), F.coalesce((F.col("score") > 0) & (n >= needed) & (mean >= sure), F.lit(False)).alias("is_anchor"))


# ---------------------------------------------------------------- detections and tracks


def match_anchors(overlaps: DataFrame, shared: bool, score: float = 0.8, overlap: float = 0.8) -> DataFrame:
    """clip, frame, track, detection that anchors it. overlaps: clip, frame, detection (by falling score), track, score, overlap.

    shared: each track takes the first detection that agrees with it, which two tracks may share. Else a detection goes to the track
    it overlaps most (ties: the first), and the last one wins a track."""
    fits = (F.col("score") >= score) & (F.col("overlap") >= overlap)
    if shared:
        return overlaps.where(fits).groupBy(*FRAME, "track").agg(F.min("detection").alias("detection"))
    best = overlaps.groupBy(*FRAME, "detection").agg(F.min_by(F.struct("track", "score", "overlap"), F.struct(-F.col("overlap"), "track")).alias("b")).select(*FRAME, "detection", "b.*")
    return best.where(fits).groupBy(*FRAME, "track").agg(F.max("detection").alias("detection"))


def object_iou(px: DataFrame) -> DataFrame:
    """frame, a, b, iou of objects (clip) that share pixels on a frame, a before b."""
    held = px.groupBy("frame", "x", "y").agg(F.array_sort(F.collect_set("clip")).alias("on")).where(F.size("on") > 1)
    pairs = held.select("frame", F.posexplode("on").alias("i", "a"), "on").select("frame", "a", F.explode(F.slice("on", F.col("i") + 2, F.size("on"))).alias("b"))
    size = areas(px).select("frame", "clip", "area")
    df = pairs.groupBy("frame", "a", "b").agg(F.count("*").alias("common"))
    df = df.join(size.select("frame", F.col("clip").alias("a"), F.col("area").alias("na")), ["frame", "a"]).join(size.select("frame", F.col("clip").alias("b"), F.col("area").alias("nb")), ["frame", "b"])
    return df.select("frame", "a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("iou"))


def give_way(px: DataFrame, last: DataFrame, overlap: float) -> DataFrame:
    """clip, frame of objects to blank: of two that overlap by so much, that whose mask was empty more recently; last: clip, frame, last
    (the last frame it was empty or blanked, -1 for never; both must have been once)."""
    a, b = (last.select("frame", F.col("clip").alias(k), F.col("last").alias(f"l{k}")) for k in "ab")
    df = object_iou(px).where(F.col("iou") >= overlap).join(a, ["frame", "a"]).join(b, ["frame", "b"]).where("la > -1 AND lb > -1 AND la <> lb")
    return df.select(F.when(F.col("la") > F.col("lb"), F.col("a")).otherwise(F.col("b")).alias("clip"), "frame").distinct()


# ---------------------------------------------------------------- memory


def memory_score(objects: DataFrame) -> DataFrame:
    """clip, frame, score: mean over a frame's objects (logit, iou) of the overlap times 2 / (1 + exp(-logit)) - 1, 0 for logits under 0."""
    sure = F.when(F.col("logit") > 0, 2 / (1 + F.exp(-F.col("logit"))) - 1).otherwise(0.0)
    return objects.groupBy(*FRAME).agg(F.avg(sure * F.col("iou")).alias("score"))


def memory_frames(frames: DataFrame, stored: DataFrame, count: int) -> DataFrame:
    """clip, frame, t: the frames each frame (from 1 on) reads: the one before, and the newest count stored ones before it, frame 0
    excluded, whose score passes MEMORY_SCORE. Passing frames are numbered, so each frame joins at most count rows by equality."""
    w = Window.partitionBy("clip").orderBy("frame")
    passed = stored.where((F.col("score") > MEMORY_SCORE) & (F.col("frame") > 0)).select(*FRAME)
    numbered = passed.select("clip", F.col("frame").alias("t"), F.row_number().over(w).alias("number"))
    marks = frames.select(*FRAME).where("frame > 0").unionByName(passed).distinct().join(passed.withColumn("mark", F.lit(1)), FRAME, "left")
    n = F.coalesce(F.sum("mark").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    df = marks.select(*FRAME, n.alias("n")).join(frames.select(*FRAME), FRAME, "left_semi")
    newest = df.where("n > 0").select(*FRAME, F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - count + 1), F.col("n"))).alias("number")).join(numbered, ["clip", "number"]).select(*FRAME, "t")
    return newest.unionByName(df.select(*FRAME, (F.col("frame") - 1).alias("t"))).distinct()


def demote(conditioning: DataFrame, refined: DataFrame) -> DataFrame:
    """clip, frame, state of each conditioning frame: refined, demoted within DEMOTION frames of a refined one, else kept."""
    both = conditioning.select(*FRAME, F.lit(0).alias("is")).unionByName(refined.select(*FRAME, F.lit(1).alias("is")))
    at_ = F.when(F.col("is") == 1, F.col("frame"))
    w = Window.partitionBy("clip").orderBy("frame", "is")
    before, after = F.last(at_, True).over(w), F.first(at_, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    far = F.least(F.col("frame") - before, after - F.col("frame"))
    df = both.withColumn("far", far).where(F.col("is") == 0)
    return df.select(*FRAME, F.when(F.col("far") == 0, "refined").when(F.col("far") <= DEMOTION, "demoted").otherwise("kept").alias("state"))


def keep_conditioning(conditioning: DataFrame, keep: int, birth: bool) -> DataFrame:
    """The newest conditioning frames (clip, frame) of each clip, so many in all; with birth the oldest stays among them."""
    w = Window.partitionBy("clip").orderBy("frame")
    df = conditioning.select(*FRAME).distinct().withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("clip")))
    newest = F.col("k") > F.col("n") - keep
    if birth:
        newest = (F.col("n") <= keep) | (F.col("k") == 1) | (F.col("k") > F.col("n") - keep + 1)
    return df.where(newest).select(*FRAME)


def annexed(px: DataFrame, points: DataFrame, width: int, height: int, least: float) -> DataFrame:
    """clip, frame, x, y: the background a tracker has taken in so far. A region (corners connect) that the mask gained since the frame
    before joins if it is least of the mask or more and holds no sure point (clip, frame, x, y: whole pixels); a region of the map goes
    as soon as it holds one. The first frame gains nothing.

    A clip is one ordered pass that holds a frame and the map; frames come as Arrow rows of pixel numbers."""
    number = lambda df, name: df.groupBy(*FRAME).agg(F.collect_list((F.col("y") * width + F.col("x")).cast("long")).alias(name))
    df = number(px.select(*PIXEL).distinct(), "on").join(number(points, "sure"), FRAME, "full")
    df = df.repartition("clip").sortWithinPartitions("clip", "frame")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip = last = before = seen = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                mask = np.zeros(height * width, bool)
                if r.on is not None:
                    mask[r.on] = True
                sure = r.sure if r.sure is not None else np.array([], int)
                if r.clip != clip:
                    clip, before, seen = r.clip, None, np.zeros(height * width, bool)
                elif r.frame != last + 1:
                    before = np.zeros(height * width, bool)  # frames between have neither mask nor points
                if before is not None:
                    label, n = regions((mask & ~before).reshape(height, width), True)
                    label = label.ravel()
                    size = np.bincount(label, minlength=n + 1)
                    size[np.append(label[sure], 0)] = -1
                    seen |= (size >= max(1.0, least * mask.sum()))[label]
                    label, n = regions(seen.reshape(height, width), True)
                    label = label.ravel()
                    seen &= ~np.isin(label, label[sure])
                    at = np.nonzero(seen)[0]
                    yield pd.DataFrame({"clip": r.clip, "frame": r.frame, "x": at % width, "y": at // width})
                before, last = mask, r.frame

    return df.mapInPandas(run, "clip long, frame long, x long, y long")

"""Exact Euclidean distances inside masks, points well inside regions, and what an anchor's detection misses of a track."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplane.operators.masks import FRAME, PIXEL, bitmaps, by_frame, gathered, regions

#: Most points sent into a region.
POINTS = 16
#: Distances up to which a stack's depths are found by shifts; frames with deeper pixels go through the envelope.
SHIFTS = 48
#: Pixels of the frames whose points are found together (one frame at least).
STACK_PIXELS = 1 << 21


def _beside(on: np.ndarray, edge: bool, kind: type = np.int64) -> np.ndarray:
    """Rows to the nearest off pixel of the same column; without one, more than any distance in the frame."""
    h = len(on)
    far = 2 * (on.shape[0] + on.shape[-1])
    row = np.arange(h, dtype=kind).reshape(-1, *[1] * (on.ndim - 1))
    above = np.maximum.accumulate(np.where(on, -far, row), axis=0)
    below = np.minimum.accumulate(np.where(on, h + far, row)[::-1], axis=0)[::-1]
    if edge:
        above, below = np.maximum(above, -1), np.minimum(below, h)
    return np.minimum(np.minimum(row - above, below - row), far)


def _envelope(g: np.ndarray) -> np.ndarray:
    """min over k of (x - k)^2 + g[:, k] for every row and x: the lower envelope of parabolas, all rows side by side.

    Each parabola enters once and leaves at most once, so the work is linear in the pixels."""
    rows, n = g.shape
    every = np.arange(rows)
    lift = g + np.arange(n) ** 2
    owner = np.zeros((rows, n), np.int64)  # parabolas of the envelope so far, and where each begins
    begin = np.full((rows, n + 1), np.inf)
    begin[:, 0] = -np.inf
    top = np.zeros(rows, np.int64)
    for q in range(1, n):
        live = every
        meet = np.empty(rows)
        while len(live):
            k = owner[live, top[live]]
            at = (lift[live, q] - lift[live, k]) / (2 * (q - k))
            meet[live] = at
            live = live[at <= begin[live, top[live]]]
            top[live] -= 1
        top += 1
        owner[every, top] = q
        begin[every, top] = meet
        begin[every, top + 1] = np.inf
    out = np.empty_like(g)
    now = np.zeros(rows, np.int64)
    for x in range(n):
        live = every
        while len(live := live[begin[live, now[live] + 1] < x]):
            now[live] += 1
        k = owner[every, now]
        out[:, x] = (x - k) ** 2 + g[every, k]
    return out


def squared_depths(mask: np.ndarray, edge: bool = True) -> np.ndarray:
    """Squared distance of every pixel to the nearest one that is off (0 for those). edge: what lies off the frame is off."""
    if not mask.any() or not edge and mask.all():
        return np.zeros(mask.shape, np.int64)
    g = _beside(mask, edge) ** 2
    if edge:
        side = np.zeros((len(mask), 1), np.int64)
        return _envelope(np.hstack([side, g, side]))[:, 1:-1]
    return _envelope(g)


def stack_depths(masks: np.ndarray) -> np.ndarray:
    """squared_depths of every frame of a stack. A column so far away counts only where nothing nearer was found, so a few shifts of the
    whole stack do for shallow masks; deep ones go through the envelope, the rows of all side by side."""
    n, height, width = masks.shape
    if not masks.size:
        return np.zeros(masks.shape, np.int32)
    kind = np.int16 if max(height, width) < 128 else np.int32  # the squares of the sides and their sum fit
    g = np.zeros((n, height, width + 2), kind)  # what lies beside the frame is off
    g[:, :, 1:-1] = np.moveaxis(_beside(np.moveaxis(masks, 0, 1), True, kind) ** 2, 0, 1)
    deep = g.copy()
    for d in range(1, width + 2):
        if d * d >= int(deep.max()):
            break
        if d > SHIFTS:
            far = np.flatnonzero(deep.max((1, 2)) > SHIFTS * SHIFTS)
            deep[far] = _envelope(g[far].reshape(-1, width + 2).astype(np.int64)).reshape(len(far), height, -1)
            break
        np.minimum(deep[:, :, d:], g[:, :, :-d] + d * d, out=deep[:, :, d:])
        np.minimum(deep[:, :, :-d], g[:, :, d:] + d * d, out=deep[:, :, :-d])
    return deep[:, :, 1:-1]


def inner_points(mask: np.ndarray, count: int = POINTS, deep: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Up to so many pixels (x, y) well inside a region and spread over it.

    Candidates are at least half as far from the outline as the deepest pixel. They are asked from the deepest on (ties in scan
    order), and one is taken unless a taken one lies within that half; a grid of cells that wide keeps the taken ones, so only
    the cells around are looked at. All in squared whole numbers."""
    deep = squared_depths(mask) if deep is None else deep
    most = int(deep.max(initial=0))
    if not most:
        return []
    ys, xs = np.nonzero(4 * deep >= most)
    order = np.argsort(-deep[ys, xs], kind="stable")
    side = max(1, int(np.ceil(np.sqrt(most) / 2)))
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    taken: list[tuple[int, int]] = []
    for x, y in zip(xs[order].tolist(), ys[order].tolist(), strict=True):
        cx, cy = x // side, y // side
        beside = (p for i in (-1, 0, 1) for k in (-1, 0, 1) for p in cells.get((cx + i, cy + k), ()))
        if all(4 * ((x - a) ** 2 + (y - b) ** 2) > most for a, b in beside):
            cells.setdefault((cx, cy), []).append((x, y))
            taken.append((x, y))
            if len(taken) == count:
                break
    return taken


def stack_points(deep: np.ndarray, count: int = POINTS) -> np.ndarray:
    """inner_points of every frame of a stack of depths as pixel numbers, -1 for none: [frames, count].

    The frames take a point each at a step: the deepest pixel that is left, whose surroundings are then left no more."""
    n, height, width = deep.shape
    left = deep.reshape(n, height * width).copy()
    most = left.max(1, initial=0)
    left[4 * left < most[:, None]] = 0
    out = np.full((n, count), -1, np.int64)
    rows = np.flatnonzero(most)
    if not len(rows):
        return out
    left, near = left[rows], most[rows] // 4
    x, y = np.arange(width, dtype=deep.dtype), np.arange(height, dtype=deep.dtype)
    for k in range(count):
        at = left.argmax(1)
        live = left[np.arange(len(rows)), at] > 0
        if not live.all():
            left, near, rows, at = left[live], near[live], rows[live], at[live]
        if not len(rows):
            break
        out[rows, k] = at
        py, px = (v.astype(deep.dtype)[:, None] for v in np.divmod(at, width))
        apart = ((y - py) ** 2)[:, :, None] + ((x - px) ** 2)[:, None, :]
        left[apart.reshape(len(rows), -1) <= near[:, None]] = 0
    return out


def _points_in(stack: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The frame, the place, x and y (pixel centres) of the points of every frame of a stack."""
    # all beyond the box around all regions is off, as what lies off the frame is
    ys, xs = (np.flatnonzero(stack.any(axes)) for axes in ((0, 2), (0, 1)))
    top, left = (v[0] if len(v) else 0 for v in (ys, xs))
    inside = stack[:, top : ys[-1] + 1, left : xs[-1] + 1] if len(ys) else stack[:, :0, :0]
    found = stack_points(stack_depths(inside), count)
    frame, place = np.nonzero(found >= 0)
    y, x = np.divmod(found[frame, place], max(1, inside.shape[2]))
    return frame, place, left + x + 0.5, top + y + 0.5


def _few(width: int, height: int) -> int:
    return max(1, min(256, STACK_PIXELS // (width * height)))


def region_points(regions_px: DataFrame, width: int, height: int, count: int = POINTS) -> DataFrame:
    """clip, frame, place, x, y: points (pixel centres) well inside the region that each frame's pixels (rows or gathered) make."""

    def pick(clips: pa.Array, frames: pa.Array, stack: np.ndarray) -> pa.RecordBatch:
        frame, place, x, y = _points_in(stack, count)
        of = pa.array(frame)
        return pa.RecordBatch.from_arrays([clips.take(of).cast(pa.int64()), frames.take(of).cast(pa.int64()), pa.array(place), pa.array(x), pa.array(y)], names=["clip", "frame", "place", "x", "y"])

    return by_frame(gathered(regions_px, width), pick, width, height, "clip long, frame long, place long, x double, y double", _few(width, height))


def regions_points(regions_found: DataFrame, width: int, height: int, count: int = POINTS) -> DataFrame:
    """clip, number, start, length, anchors, points of lost regions (clip, start, length, region as pixel numbers), numbered in each clip in
    the order of their runs: what repairs.region_frames takes. Regions are found once: what there is to say of them stays beside them."""
    number = F.row_number().over(Window.partitionBy("clip").orderBy("start", "length", F.col("region")[0])).cast("long").alias("number")
    region = F.transform("region", lambda p: p.cast("int")).alias("on")
    parts = regions_found.select("clip", number, F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), region)
    few = _few(width, height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), few):
                batch = whole.slice(k, few)
                frame, _, x, y = _points_in(bitmaps(batch.column(4), width, height), count)
                ends = np.append(0, np.cumsum(np.bincount(frame, minlength=len(batch)))).astype(np.int32)
                points = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(4)], points], names=["clip", "number", "start", "length", "points"])

    at = parts.mapInArrow(run, f"clip {parts.schema['clip'].dataType.simpleString()}, number long, start long, length long, points array<struct<x:double,y:double>>")
    anchors = F.array(F.col("start") - 1, F.col("start") + F.col("length")).alias("anchors")
    return at.where(F.size("points") > 0).select("clip", "number", "start", "length", anchors, "points")


def largest_inside(px: DataFrame, width: int, height: int) -> DataFrame:
    """clip, frame, pixels, size, radius: how many pixels (rows or gathered) each frame has, the largest piece of these (sides connect;
    ties: the first in scan order) and the distance of its deepest pixel from the nearest one off it; the frame's edge is no outline."""

    def measure(clips: pa.Array, frames: pa.Array, stack: np.ndarray) -> pa.RecordBatch:
        size, radius = [], []
        for mask in stack:
            label, n = regions(mask, False)
            count = np.bincount(label.ravel(), minlength=n + 1)
            count[0] = 0
            size.append(int(count.max()))
            radius.append(float(np.sqrt(squared_depths(label == count.argmax(), False).max())) if n else 0.0)
        pixels = pa.array(stack.sum((1, 2), dtype=np.int64))
        return pa.RecordBatch.from_arrays([clips.cast(pa.int64()), frames.cast(pa.int64()), pixels, pa.array(size, pa.int64()), pa.array(radius, pa.float64())], names=["clip", "frame", "pixels", "size", "radius"])

    return by_frame(gathered(px, width), measure, width, height, "clip long, frame long, pixels long, size long, radius double")


def anchor_log(
    slots: DataFrame,
    overlaps: DataFrame,
    track_px: DataFrame,
    found_px: DataFrame | Callable[[DataFrame], DataFrame],
    width: int,
    height: int,
    score: float = 0.8,
    overlap: float = 0.8,
    sure: float = 0.8,
    first: bool = True,
) -> DataFrame:
    """One row for each slot at which a track may be anchored anew: clip, frame, fired, why, det_score, iou, track_logit, missed_px,
    missed_largest_px, missed_radius.

    slots: clip, frame, logit (of the track); overlaps: clip, frame, detection (by falling score), score, overlap with the
    track; track_px and found_px: pixels of the track and of the detections (with detection), the latter also as a function of
    the one detection (clip, frame, detection) that is logged for a frame, so that no others are made. Of the detections with enough
    score and overlap the first (or, with first off, the last) is the anchor. why is null where it fired, "no det" without a
    detection, "gate" without an anchor, and "track score" where the track isn't sure enough (sure 0: not asked). What is
    logged is the anchor, or else the detection that overlaps the track most (ties: the first); missed are the track's pixels
    that it lacks."""
    fits = (F.col("score") >= score) & (F.col("overlap") >= overlap)
    one = F.struct("detection", "score", "overlap")
    pick = (F.min if first else F.max)(F.when(fits, one)).alias("anchor")
    best = F.min_by(one, F.struct(-F.col("overlap"), "detection")).alias("best")
    found = overlaps.groupBy(*FRAME).agg(pick, best)
    df = slots.select(*FRAME, "logit").join(found, FRAME, "left")
    blocked = F.lit(sure > 0) & F.col("anchor").isNotNull() & (F.col("logit") <= sure)
    df = df.withColumn("fired", F.col("anchor").isNotNull() & ~blocked).withColumn("shown", F.coalesce("anchor", "best"))
    why = F.when(F.col("fired"), None).when(F.col("best").isNull(), "no det").when(F.col("anchor").isNull(), "gate").otherwise("track score")
    df = df.select(*FRAME, "fired", why.alias("why"), F.col("shown.detection").alias("detection"), "shown.score", "shown.overlap", "logit")
    asked = df.where("detection IS NOT NULL").select(*FRAME, "detection")
    own = found_px(asked) if callable(found_px) else found_px.join(asked, [*FRAME, "detection"], "left_semi")
    missed = track_px.select(*PIXEL).join(asked.select(*FRAME), FRAME, "left_semi").join(own.select(*PIXEL), PIXEL, "left_anti")
    df = df.join(largest_inside(missed, width, height), FRAME, "left")
    lost = F.when(F.col("detection").isNotNull(), F.coalesce("pixels", F.lit(0))).alias("missed_px")
    digits = lambda c, n, to: F.round(c, n).alias(to)
    return df.select(
        *FRAME, "fired", "why", digits("score", 4, "det_score"), digits("overlap", 4, "iou"), digits("logit", 4, "track_logit"), lost,
        F.col("size").alias("missed_largest_px"), digits("radius", 1, "missed_radius"),
    )

"""The person's part of a mask: pieces that keypoints call theirs, fragments, and background that joins the mask for a few frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplane.operators.boxes import in_frame
from cliplane.operators.masks import FRAME, PIXEL, regions
from cliplane.operators.pose import DRAW, LIMB_WIDTH, LIMBS, at, body_scale, drawn

#: Frames either side, body scales around the skeleton, and the shares at which a piece is reported and is a second body.
BESIDE, ZONE, SPECK, SECOND = 2, 0.25, 0.01, 0.05
#: Rows that are objects of Python at a time.
FEW = 64


def seen_points(width: int, height: int, threshold: float = DRAW) -> Column:
    """The drawn points of body, hands and face that lie in the frame, as pixel numbers."""
    on = F.filter(F.concat("body", "left_hand", "right_hand", "face"), lambda p: (p["c"] >= threshold) & in_frame(p["x"], p["y"], width, height))
    return F.transform(on, lambda p: p["y"].cast("long") * width + p["x"].cast("long"))


def skeleton(width: int, height: int, threshold: float = DRAW) -> Column:
    """What a drawn skeleton covers as lines [ax, ay, bx, by] in whole pixels: limbs with both ends drawn, limbs that run out of the shot
    from a drawn end, and the drawn points of body and hands; null if no point of the body is drawn."""
    line = lambda a, b: F.array(*[p[c].cast("long") for p in (a, b) for c in "xy"])
    gone = lambda p: F.least(p["x"], width - 1 - p["x"], p["y"], height - 1 - p["y"]) < LIMB_WIDTH * body_scale(threshold)
    limbs = []
    for a, b in LIMBS:
        on, other = drawn(a, threshold), drawn(b, threshold)
        limbs.append(F.when((on & other) | (on & ~other & gone(at(b))) | (other & ~on & gone(at(a))), line(at(a), at(b))))
    points = F.transform(F.filter(F.concat("body", "left_hand", "right_hand"), lambda p: p["c"] >= threshold), lambda p: line(p, p))
    return F.when(F.exists("body", lambda p: p["c"] >= threshold), F.concat(F.array_compact(F.array(*limbs)), points))


def square(mask: np.ndarray, k: int) -> np.ndarray:
    """Dilation by a k x k square, k odd."""
    for axis in (0, 1):
        total = np.cumsum(np.insert(mask, 0, False, axis=axis), axis=axis, dtype=np.int64)
        i, n = np.arange(mask.shape[axis]), mask.shape[axis]
        mask = np.take(total, np.minimum(i + k // 2 + 1, n), axis=axis) > np.take(total, np.maximum(i - k // 2, 0), axis=axis)
    return mask


class Pieces:
    """The connected pieces of a mask as a table: size, share of the largest, whether a seen point lies in it, sides of the frame it reaches."""

    def __init__(self, mask: np.ndarray, seen: np.ndarray | None):
        self.label, n = regions(mask, True)
        flat = self.label.ravel()
        self.size = np.bincount(flat, minlength=n + 1)[1:]
        self.largest = int(self.size.argmax()) if n else -1
        self.share = np.round(self.size / self.size.max(), 4) if n else np.zeros(0)
        self.seen = None if seen is None else np.isin(np.arange(1, n + 1), flat[seen])
        edges = (self.label[0], self.label[-1], self.label[:, 0], self.label[:, -1])
        self.sides = np.stack([np.bincount(e, minlength=n + 1)[1:] > 0 for e in edges], axis=1)

    def theirs(self) -> np.ndarray:
        """The largest piece (ties: the first in scan order), pieces with a seen point, or without a pose those at a side it reaches too."""
        if self.largest < 0:
            return np.zeros(0, bool)
        linked = (self.sides & self.sides[self.largest]).any(1) if self.seen is None else self.seen
        return linked | (np.arange(len(self.size)) == self.largest)

    def held_by(self, part: np.ndarray) -> np.ndarray:
        """Pieces of which another frame's part holds most."""
        return 2 * np.bincount(self.label[part], minlength=len(self.size) + 1)[1:] > self.size

    def mask_of(self, some: np.ndarray) -> np.ndarray:
        return np.append(False, some)[self.label]


def _mask(numbers, width: int, height: int) -> np.ndarray:
    mask = np.zeros(height * width, bool)
    mask[np.asarray(numbers, int)] = True
    return mask.reshape(height, width)


def _unseen(x: np.ndarray, y: np.ndarray, lines, reach: float) -> int:
    """How many of these pixels are farther from all lines than reach."""
    if lines is None or not len(lines):
        return len(x)
    ax, ay, bx, by = np.array([list(v) for v in lines], float).T[:, :, None]
    dx, dy = bx - ax, by - ay
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / np.maximum(dx * dx + dy * dy, 1), 0, 1)
    return int((np.hypot(x - ax - t * dx, y - ay - t * dy) > reach).all(0).sum())


def _some(batches: Iterator[pa.RecordBatch], few: int = FEW) -> Iterator[pd.DataFrame]:
    """Few rows of Arrow batches at a time, so that lists of a whole batch never are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, few):
            yield batch.slice(k, few).to_pandas()


def person_parts(frames: DataFrame, px: DataFrame, width: int, height: int) -> DataFrame:
    """clip, frame, fragments (falling shares), attached_leak: how much of the person's part lies where neither the masks of the frames
    beside, grown by a fiftieth of the person's size, nor the skeleton are, as a share of the median area beside; 0 without a mask or a
    neighbour, null without a pose. Distances from the skeleton are exact.

    The person's part is the largest piece with those that a point or a side says belong to it; a piece from SPECK to under SECOND
    of it that the parts of two of the frames beside mostly hold is added. Other pieces of SPECK or more are fragments.

    frames: every frame once: clip, frame, seen, lines, scale (all null without a pose). The parts that frames have by themselves are
    found first, each once; then a row carries its own pixel numbers and the parts and masks of BESIDE frames either side (as bits),
    so rows are bounded and frames spread over tasks."""
    on = px.select(*PIXEL).distinct().groupBy(*FRAME).agg(F.collect_list((F.col("y") * width + F.col("x")).cast("long")).alias("on"))
    none = F.expr("CAST(array() AS array<bigint>)")
    df = frames.select(*FRAME, "seen", "lines", "scale").join(on, FRAME, "left").withColumn("on", F.coalesce("on", none))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, bits = [], []
            for pdf in _some([batch.select(["seen", "on"])]):
                for r in pdf.itertuples(index=False):
                    p = Pieces(_mask(r.on, width, height), None if r.seen is None else np.asarray(r.seen, int))
                    part.append(np.packbits(p.mask_of(p.theirs())).tobytes())
                    bits.append(np.packbits(p.label > 0).tobytes())
            own = [pa.array(part, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "part", "bits"])

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.BinaryType()), T.StructField("bits", T.BinaryType())])
    df = df.mapInArrow(alone, schema)
    w = Window.partitionBy("clip").orderBy("frame")
    beside = [k for k in range(-BESIDE, BESIDE + 1) if k]
    take = lambda k: F.when(F.lag("frame", -k).over(w) == F.col("frame") + k, F.lag(F.struct("part", "bits"), -k).over(w))
    df = df.select(*FRAME, "seen", "lines", "scale", "on", F.array_compact(F.array(*[take(k) for k in beside])).alias("beside"))

    def unpacked(bits: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bits, np.uint8), count=width * height).astype(bool).reshape(height, width)

    def judge(r) -> tuple[list[float], float | None]:
        pieces = Pieces(_mask(r.on, width, height), None if r.seen is None else np.asarray(r.seen, int))
        own = pieces.theirs()
        held = sum((pieces.held_by(unpacked(b["part"])) for b in r.beside), np.zeros(len(own), int))
        own = own | ((pieces.share >= SPECK) & (pieces.share < SECOND) & (held >= 2))
        torn = np.sort(pieces.share[~own & (pieces.share >= SPECK)])[::-1].tolist()
        if r.seen is None:
            return torn, None
        if not len(own) or not len(r.beside):
            return torn, 0.0
        around = [unpacked(b["bits"]) for b in r.beside]
        median = float(np.median([m.sum() for m in around]))
        grown = square(np.logical_or.reduce(around), max(3, int(0.02 * np.sqrt(median)) | 1))
        y, x = np.nonzero(pieces.mask_of(own) & ~grown)
        return torn, _unseen(x, y, r.lines, max(3, int(ZONE * r.scale))) / max(median, 1.0)

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _some(batches):
            found = [(r.clip, r.frame, *judge(r)) for r in pdf.itertuples(index=False)]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["clip", "frame", "fragments", "attached_leak"])

    return df.mapInArrow(run, "clip long, frame long, fragments array<double>, attached_leak double")


def pose_frames(parts: DataFrame, width: int, height: int, threshold: float = DRAW) -> DataFrame:
    """clip, frame, seen, lines, scale for person_parts, of frames with a pose in pixels (body, left_hand, right_hand, face)."""
    return parts.select(*FRAME, seen_points(width, height, threshold).alias("seen"), skeleton(width, height, threshold).alias("lines"), body_scale(threshold).alias("scale"))

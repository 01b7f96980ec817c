"""Set algebra on pixel tables (clip, frame, x, y)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["clip", "frame"]
PIXEL = [*FRAME, "x", "y"]


def areas(px: DataFrame) -> DataFrame:
    """area and the bounding box (ends exclusive) of each frame with pixels."""
    return px.groupBy(*FRAME).agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def gathered(px: DataFrame, width: int) -> DataFrame:
    """clip, frame, on: the numbers (y * width + x) of each frame's pixels; masks that come so stay as they are.

    A pixel table that a view explodes looks small to the planner, so what joins masks asks for a merge (merged)."""
    if "on" in px.columns:
        return px.select(*FRAME, "on")
    return px.groupBy(*FRAME).agg(F.collect_set((F.col("y") * width + F.col("x")).cast("int")).alias("on"))


def merged(masks: DataFrame) -> DataFrame:
    """Masks that are never broadcast: arrays that pack well look small on disk too."""
    return masks.hint("merge")


def bitmaps(on: pa.ListArray, width: int, height: int) -> np.ndarray:
    """A stack of masks of lists of pixel numbers; null is an empty one."""
    out = np.zeros((len(on), height * width), bool)
    size = np.diff(on.offsets.to_numpy()) * on.is_valid().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(on)), size), on.flatten().to_numpy()] = True
    return out.reshape(-1, height, width)


def by_frame(masks: DataFrame, step: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], width: int, height: int, schema: str, few: int = 256) -> DataFrame:
    """schema of step(clips, frames, stack of masks) over gathered masks, some frames at a time, wherever these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), few):
                batch = whole.slice(k, few)
                yield step(batch.column(0), batch.column(1), bitmaps(batch.column(2), width, height))

    return masks.select(*FRAME, "on").mapInArrow(run, schema)


def listed(stack: np.ndarray) -> pa.ListArray:
    """The pixel numbers of every mask of a stack: what bitmaps takes."""
    at = np.nonzero(stack.reshape(len(stack), -1))
    offsets = np.append(0, np.cumsum(np.bincount(at[0], minlength=len(stack))))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at[1].astype(np.int32)))


def words(px: DataFrame) -> DataFrame:
    """clip, frame, y, word, bits: each row of a frame's pixels in words of 64 bits, put together before they are shuffled."""
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(pmod(x, 64) AS INT))")).alias("bits")
    return px.groupBy(*FRAME, "y", F.floor(F.col("x") / 64).alias("word")).agg(bits)


def iou_with_previous(px: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """IoU of each frame's pixels with those of the frame before; null on a first frame.

    frames: clip, frame of all frames. A frame of these without pixels is an empty mask: 1 beside another one, else 0.
    Without it only frames with pixels are known, and one behind a gap has null.
    """
    now = words(px)
    before = now.select("clip", (F.col("frame") + 1).alias("frame"), "y", "word", F.col("bits").alias("old"))
    meet = now.join(before, [*FRAME, "y", "word"]).groupBy(*FRAME).agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("old")))).alias("common"))
    size = now.groupBy(*FRAME).agg(F.sum(F.bit_count("bits")).alias("area"))
    if frames is not None:
        size = frames.select(*FRAME).distinct().join(size, FRAME, "left").withColumn("area", F.coalesce("area", F.lit(0)))
    before = size.select("clip", (F.col("frame") + 1).alias("frame"), F.col("area").alias("before"))
    df = size.join(before, FRAME, "left").join(meet, FRAME, "left")
    common = F.coalesce("common", F.lit(0))
    union = F.col("area") + F.col("before") - common
    return df.select(*FRAME, F.when(union > 0, common / union).when(union == 0, 1.0).alias("iou"))


def render_identity(px: DataFrame, frames: DataFrame, width: int, height: int, colour: Column, background: Column) -> DataFrame:
    """clip, frame, x, y, rgb of every pixel of the given frames (clip, frame): colour on the mask, background off it."""
    line = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = frames.select(*FRAME).distinct().select(*FRAME, line(width).alias("x")).select(*FRAME, "x", line(height).alias("y"))
    on = px.select(*PIXEL).distinct().withColumn("on", F.lit(True))
    return grid.join(on, PIXEL, "left").select(*PIXEL, F.when(F.col("on"), colour).otherwise(background).alias("rgb"))


def cross_grown(stack: np.ndarray, steps: int) -> np.ndarray:
    """So many dilations of every frame of a stack [frames, height, width] by the 3 x 3 cross."""
    for _ in range(steps):
        wide = stack.copy()
        for axis in (1, 2):
            low, high = [slice(None)] * 3, [slice(None)] * 3
            low[axis], high[axis] = slice(None, -1), slice(1, None)
            wide[tuple(low)] |= stack[tuple(high)]
            wide[tuple(high)] |= stack[tuple(low)]
        stack = wide
    return stack


def each_frame(px: DataFrame, width: int, height: int, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """clip, frame, x, y of step(mask) for each frame with pixels. A frame travels as one row of pixel numbers, and is a bitmap only
    inside the task that holds its batch."""
    number = (F.col("y") * width + F.col("x")).cast("int")
    rows = px.groupBy(*FRAME).agg(F.collect_list(number).alias("on"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in (0, 1)]
            for clip, frame, on in zip(*keys, batch.column(2), strict=True):
                mask = np.zeros((height, width), bool)
                mask.ravel()[on.values.to_numpy()] = True
                y, x = np.nonzero(step(mask))
                same = [pa.array(np.full(len(x), v, np.int64)) for v in (clip, frame)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(x), pa.array(y)], names=PIXEL)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    if set(kinds[c] for c in FRAME) - {"bigint"}:
        rows = rows.select(*[F.col(c).cast("long").alias(c) for c in FRAME], "on")
    return rows.mapInArrow(run, "clip long, frame long, x long, y long")


def dilate(px: DataFrame, steps: int, width: int, height: int) -> DataFrame:
    """So many dilations by the 3x3 cross: all pixels within that L1 distance, clipped to the frame."""
    return each_frame(px, width, height, lambda mask: cross_grown(mask[None], steps)[0])


def final_blocks(px: DataFrame, grow: int, block: int, width: int, height: int) -> DataFrame:
    """The grown mask cut to blocks of its own box: clip, frame and the corners of every block that is on (ends exclusive)."""
    grown = dilate(px, grow, width, height)
    box = areas(grown).select(*FRAME, "x0", "y0", "x1", "y1")
    df = grown.join(box, FRAME)
    out = {}
    for c in "xy":
        side = F.col(f"{c}1") - F.col(f"{c}0")
        n = F.greatest(F.lit(1), F.floor(side / max(block, 1)))
        size = F.floor(side / n)
        i = F.least(F.floor((F.col(c) - F.col(f"{c}0")) / size), n - 1)
        out[c] = (F.col(f"{c}0") + i * size, F.when(i == n - 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0") + (i + 1) * size))
    return df.select(*FRAME, *[v.cast("long").alias(k) for k, v in (("bx0", out["x"][0]), ("by0", out["y"][0]), ("bx1", out["x"][1]), ("by1", out["y"][1]))]).distinct()


def lay_out(blocks: DataFrame) -> DataFrame:
    """clip, frame, x, y: the pixels of blocks (bx0, by0, bx1, by1; ends exclusive)."""
    span = lambda c: F.explode(F.sequence(F.col(f"b{c}0"), F.col(f"b{c}1") - 1)).alias(c)
    return blocks.select(*FRAME, span("x"), "by0", "by1").select(*FRAME, "x", span("y"))


def final_mask(px: DataFrame, grow: int, block: int, width: int, height: int) -> DataFrame:
    """clip, frame, x, y of the final mask: grown, cut to blocks and laid out again."""
    return lay_out(final_blocks(px, grow, block, width, height))


def outside_box(px: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Share of each frame's pixels outside a box."""
    out = ~((F.col("x") >= box[0]) & (F.col("x") < box[2]) & (F.col("y") >= box[1]) & (F.col("y") < box[3]))
    return px.groupBy(*FRAME).agg(F.count("*").alias("area"), F.avg(F.when(out, 1.0).otherwise(0.0)).alias("outside"))


def without_overlap(px: DataFrame, score: Column | float = 0.0) -> DataFrame:
    """Where several objects (clip) hold a pixel of a frame, the one with the higher score keeps it (ties: the smallest number)."""
    best = F.min_by("clip", F.struct(-(score if isinstance(score, Column) else F.lit(score)), "clip"))
    return px.groupBy("frame", "x", "y").agg(best.alias("clip")).select(*PIXEL)


def suppress_shrunk(px: DataFrame, least: float, logit: Column | float = 0.0) -> DataFrame:
    """clip, frame, area, kept: kept is 0 where less than this share of an object is left after overlaps are resolved.

    A pixel goes to the object with the highest logit there (ties: the smallest number)."""
    left = without_overlap(px, logit).groupBy(*FRAME).agg(F.count("*").alias("left"))
    df = areas(px).select(*FRAME, "area").join(left, FRAME, "left")
    rest = F.coalesce("left", F.lit(0))
    return df.select(*FRAME, "area", F.when(rest >= least * F.col("area"), rest).otherwise(0).alias("kept"))


def cells(px: DataFrame, width: int, height: int, least: float = 0.5) -> DataFrame:
    """The cells of the grid that is a sixteenth of the frame, each side rounded up, of which half or more is mask: clip, frame, x, y.

    The frame is halved first: a half-size pixel is on if all it covers are. A cell reads every half-size pixel it touches."""
    half = px.groupBy(*FRAME, F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.count("*").alias("n")).where("n = 4")
    reach = {}
    for c, n in (("x", width // 2), ("y", height // 2)):
        m = n
        for _ in range(3):
            m = (m + 1) // 2
        bounds = [(i * n // m, -(-(i + 1) * n // m)) for i in range(m)]
        reach[c] = F.array_compact(F.array(*[F.when((F.col(c) >= a) & (F.col(c) < b), F.struct(F.lit(i).cast("long").alias("at"), F.lit(b - a).alias("n"))) for i, (a, b) in enumerate(bounds)]))
    df = half.select(*FRAME, F.explode(reach["x"]).alias("i"), "y").select(*FRAME, "i", F.explode(reach["y"]).alias("k"))
    return df.groupBy(*FRAME, F.col("i.at").alias("x"), F.col("k.at").alias("y")).agg(F.count("*").alias("on"), F.first(F.col("i.n") * F.col("k.n")).alias("of")).where(F.col("on") >= least * F.col("of")).select(*PIXEL)


def keypoint_recall(px: DataFrame, points: DataFrame, width: int, height: int, least: float = 0.5) -> DataFrame:
    """clip, frame, recall: the share of a frame's sure points (clip, frame, x, y, c) that its mask holds; 1 with no sure point.
    Points off the frame are moved to its edge."""
    place = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c))).cast("long")
    on = points.select(*FRAME, place("x", width).alias("x"), place("y", height).alias("y"), (F.col("c") >= least).alias("sure"))
    hit = on.join(px.select(*PIXEL).distinct().withColumn("hit", F.lit(1.0)), PIXEL, "left")
    return hit.groupBy(*FRAME).agg(F.coalesce(F.avg(F.when(F.col("sure"), F.coalesce("hit", F.lit(0.0)))), F.lit(1.0)).alias("recall"))


def paint(pixels: DataFrame, px: DataFrame, colour: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Colour pixels (clip, frame, x, y, r, g, b, ...) with those of the mask in one colour, the rest unchanged."""
    df = pixels.join(px.select(*PIXEL).distinct().withColumn("__on", F.lit(True)), PIXEL, "left")
    return df.withColumns({c: F.when(F.col("__on"), v).otherwise(F.col(c)) for c, v in zip("rgb", colour, strict=True)}).drop("__on")


def convention(pixels: DataFrame, width: int, height: int, modes: dict[str, str]) -> DataFrame:
    """clip, mode: which way a coloured mask (clip, x, y, r, g, b of its first frame) was drawn, read from the frame's border: the
    mode whose background (white or black) most of the border has; null if neither has most."""
    border = pixels.where((F.col("x") == 0) | (F.col("x") == width - 1) | (F.col("y") == 0) | (F.col("y") == height - 1))
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    white, black = share(F.least("r", "g", "b") > 225.0 / 255.0), share(F.greatest("r", "g", "b") <= 0.1)
    named = {colour: mode for mode, colour in modes.items()}
    return border.groupBy("clip").agg(F.when(white > 0.5, named["white"]).when(black > 0.5, named["black"]).alias("mode"))


def regions(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Labels 1..n of a frame's connected regions, numbered in scan order, and n. The runs of each row are joined with those of the row
    above, so the work in Python grows with the runs and not with the pixels."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    edge = np.diff(wide, axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    root = list(range(len(row)))
    left, right = first.tolist(), last.tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    start, more = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist(), int(diagonal)
    for y in range(1, mask.shape[0]):
        i, above, k, here = start[y - 1], start[y], start[y], start[y + 1]
        while i < above and k < here:
            if left[i] < right[k] + more and left[k] < right[i] + more:
                r, t = find(i), find(k)
                root[max(r, t)] = min(r, t)
            if right[i] < right[k]:
                i += 1
            else:
                k += 1
    top, number = np.unique([find(i) for i in range(len(row))], return_inverse=True) if len(row) else (np.array([]), np.array([], int))
    label = np.zeros(mask.shape, np.int64)
    label[mask] = np.repeat(number + 1, last - first)  # runs stand in scan order
    return label, len(top)


def stack_regions(stack: np.ndarray, diagonal: bool) -> np.ndarray:
    """The labels that regions gives every frame of a stack, found in one go: frames stand below one another with a free row between."""
    n, height, width = stack.shape
    tall = np.zeros((n, height + 1, width), bool)
    tall[:, :height] = stack
    label = regions(tall.reshape(-1, width), diagonal)[0].reshape(n, height + 1, width)[:, :height]
    most = np.maximum.accumulate(label.max((1, 2), initial=0))  # frames number their regions one after the other
    return np.where(label > 0, label - np.append(0, most[:-1])[:, None, None], 0)


def clean(px: DataFrame, width: int, height: int, hole: float = 0.01, island: float = 0.01) -> DataFrame:
    """px with small enclosed holes filled (up to this share of the mask) and then pieces dropped that are under this share of the
    largest. Holes connect by sides, pieces also by corners. One frame is one Arrow table, bounded by its size."""

    def tidy(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), bool)
        mask[pdf["y"], pdf["x"]] = True
        limit = hole * mask.sum()
        label, n = regions(~mask, False)
        edge = set(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]]))
        size = np.bincount(label.ravel(), minlength=n + 1)
        if n > 1:
            mask |= np.isin(label, [i for i in range(1, n + 1) if i not in edge and size[i] <= limit])
        label, n = regions(mask, True)
        size = np.bincount(label.ravel(), minlength=n + 1)
        size[0] = 0
        y, x = np.nonzero(mask & (size[label] >= island * size.max()))
        return pd.DataFrame({"clip": pdf["clip"].iloc[0], "frame": pdf["frame"].iloc[0], "x": x, "y": y})

    return px.select(*PIXEL).groupBy(*FRAME).applyInPandas(tidy, "clip long, frame long, x long, y long")


def fragments(px: DataFrame, width: int, height: int, least: float = 0.01) -> DataFrame:
    """clip, frame, share: pieces detached from the largest one, as shares of it. A piece that runs off a side of the frame which the
    largest runs off too is a part of it."""
    sides = F.array_compact(F.array(F.when(F.col("x0") == 0, 0), F.when(F.col("y0") == 0, 1), F.when(F.col("x1") == width, 2), F.when(F.col("y1") == height, 3)))
    all_ = pieces(px, diagonal=True).select(*FRAME, "piece", "area", sides.alias("sides"))
    first = Window.partitionBy(*FRAME).orderBy("piece")
    df = all_.select(*FRAME, "piece", "sides", F.first("sides").over(first).alias("of"), (F.col("area") / F.first("area").over(first)).alias("share"))
    return df.where((F.col("piece") > 0) & ~F.arrays_overlap("sides", "of")).select(*FRAME, F.round("share", 4).alias("share")).where(F.col("share") >= least)


def pieces(px: DataFrame, diagonal: bool = False) -> DataFrame:
    """clip, frame, piece, area, x0, y0, x1, y1 (ends exclusive): connected pieces, largest first (ties: first in scan order). A frame's pixels are
    bounded by its size, so a group is a bounded Arrow table."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        number = regions(mask, diagonal)[0][y - y.min(), x - x.min()]
        g = pd.DataFrame({"root": number, "x": x, "y": y}).groupby("root").agg(area=("x", "size"), x0=("x", "min"), y0=("y", "min"), x1=("x", "max"), y1=("y", "max")).reset_index()
        g = g.sort_values(["area", "root"], ascending=[False, True]).reset_index(drop=True)
        return pd.DataFrame({"clip": pdf["clip"].iloc[0], "frame": pdf["frame"].iloc[0], "piece": g.index, "area": g["area"], "x0": g["x0"], "y0": g["y0"], "x1": g["x1"] + 1, "y1": g["y1"] + 1})

    return px.groupBy(*FRAME).applyInPandas(label, "clip long, frame long, piece long, area long, x0 long, y0 long, x1 long, y1 long")


def cut_margins(image: tuple[int, int], size: tuple[int, int]) -> tuple[int, int]:
    """What a cut about the centre to the aspect of size takes from each side of an image, across and down."""
    (w, h), old, new = image, image[0] / image[1], size[0] / size[1]
    return round((w - w * (new / old)) / 2) if old > new else 0, round((h - h * (old / new)) / 2) if old < new else 0


def placed(px: DataFrame, image: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """px of an image cut to size's aspect about its centre and resized to size, each pixel taking that under its middle."""
    cut = dict(zip("xy", cut_margins(image, size), strict=True))
    out = {}
    for c, n, to in (("x", image[0], size[0]), ("y", image[1], size[1])):
        side = n - 2 * cut[c]
        at = lambda v: F.ceil((v * to) / side - 0.5)  # noqa: B023, E731
        first, last = at(F.col(c) - cut[c]), at(F.col(c) - cut[c] + 1) - 1
        keep = (F.col(c) >= cut[c]) & (F.col(c) < n - cut[c]) & (first <= last)
        out[c] = F.when(keep, F.sequence(first, F.when(keep, last).otherwise(first)))
    df = px.select(*FRAME, F.explode(out["x"]).alias("i"), out["y"].alias("k"))
    return df.select(*FRAME, F.col("i").alias("x"), F.explode("k").alias("y"))


def window(px: DataFrame, size: tuple[int, int], frames: DataFrame, first: int, length: int) -> DataFrame:
    """clip, out, x, y: the pixels that are on in frames first to first + length of a mask video; frames past its end are on all over.
    frames: clip and n, its number of frames; a video of one frame is repeated; one that ends before first gives no rows."""
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("out")
    want = frames.where((F.col("n") == 1) | (F.col("n") > first)).select("clip", "n", steps)
    want = want.withColumn("frame", F.when(F.col("n") == 1, 0).otherwise(F.col("out") + first))
    line = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    past = want.where(F.col("frame") >= F.col("n")).select("clip", "out", line(size[0]).alias("x")).select("clip", "out", "x", line(size[1]).alias("y"))
    return want.where(F.col("frame") < F.col("n")).join(px.select(*PIXEL), FRAME).select("clip", "out", "x", "y").unionByName(past)


def latent_rows(px: DataFrame, seeds: int) -> DataFrame:
    """clip, row, x, y of a window's mask (clip, out, x, y): the first frames are known and so off, and frame 0 stands four times."""
    known = px.where(F.col("out") >= seeds)
    rows = F.when(F.col("out") == 0, F.array(*[F.lit(k).cast("long") for k in range(4)])).otherwise(F.array(F.col("out") + 3))
    return known.select("clip", F.explode(rows).alias("row"), "x", "y")

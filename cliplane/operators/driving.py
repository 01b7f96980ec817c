"""Masks that drive an animation: the person's colour and background by mode, what a half-size latent grid reads of them, references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.operators.losses import latent_reader
from cliplane.operators.masks import FRAME, PIXEL, by_frame, gathered, listed, render_identity

#: A colour counts as on above this level; the person's colour; backgrounds of driving and reference masks by mode.
ON = 225 / 255
PERSON, WHITE, BLACK = (0, 0, 1), (1, 1, 1), (0, 0, 0)
BACKGROUNDS = {"animation": (BLACK, WHITE), "replacement": (WHITE, BLACK)}
#: Share of the largest piece from which a second one is reported.
FRAGMENT = 0.05


def _colour(c: tuple[int, int, int]) -> Column:
    return F.array(*[F.lit(v) for v in c])


def is_person(r: Column, g: Column, b: Column) -> Column:
    """Whether a colour of a mask is the person's (blue alone is on)."""
    return (b > ON) & (r <= ON) & (g <= ON)


def coloured(px: DataFrame, frames: DataFrame, width: int, height: int, mode: Column, reference: bool = False) -> DataFrame:
    """clip, frame, x, y, rgb, mode of every pixel: the person's colour on the mask, else the background of the clip's mode.

    In replacement mode the reference is cut out by its mask, so one without a pixel is an error there."""
    choose = F.when(mode == "replacement", _colour(BACKGROUNDS["replacement"][reference])).otherwise(_colour(BACKGROUNDS["animation"][reference]))
    if reference:
        some = px.select(*FRAME).distinct().withColumn("some", F.lit(True))
        frames = frames.select(*FRAME).distinct().join(some, FRAME, "left").withColumn("mode", mode)
        told = F.format_string("clip %s frame %d: the reference mask marks no pixel", F.col("clip").cast("string"), "frame")
        fine = F.when(F.col("some").isNotNull() | (F.col("mode") != "replacement"), True).otherwise(F.raise_error(told).cast("boolean"))
        frames = frames.where(fine)
    return render_identity(px, frames, width, height, _colour(PERSON), choose).withColumn("mode", mode)


def extra_mask(px: DataFrame, covered: DataFrame) -> DataFrame:
    """The mask of an extra reference: its pixels that the picture covers (covered: clip, frame, x0, y0, x1, y1; ends exclusive)."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return px.join(covered, FRAME).where(inside).select(*PIXEL)


def with_extra(references: DataFrame, extra: DataFrame) -> DataFrame:
    """References (clip, index, ...) with one more behind the last of its clip (extra: clip, ... without an index)."""
    last = references.groupBy("clip").agg((F.max("index") + 1).alias("index"))
    return references.unionByName(extra.join(last, "clip"))


def latent_kept(px: DataFrame) -> DataFrame:
    """clip, frame, latent_kept: the share of the person that is left when the frame is halved (a half-size pixel needs all four)."""
    half = px.select(*PIXEL).distinct().groupBy(*FRAME, F.floor(F.col("x") / 2), F.floor(F.col("y") / 2)).agg(F.count("*").alias("n"))
    return half.groupBy(*FRAME).agg((F.sum(F.when(F.col("n") == 4, 4).otherwise(0)) / F.sum("n")).alias("latent_kept"))


def cell_edges(cells: int, size: int) -> list[int]:
    """Where the cells of a grid begin on a side of so many pixels, each pixel taking the nearest cell, and the end."""
    of = [int(i * (cells / size)) for i in range(size)]
    return [0, *[i for i in range(1, size) if of[i] != of[i - 1]], size]


def latent_reading(cells: DataFrame, width: int, height: int) -> DataFrame:
    """clip, frame, x, y: the pixels of the cells (clip, frame, x, y of masks.cells) that read as the person."""
    out = {}
    for c, n in (("x", width), ("y", height)):
        number = n // 2
        for _ in range(3):
            number = (number + 1) // 2
        edges = cell_edges(number, n)
        spans = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b - 1).cast("long").alias("b")) for a, b in zip(edges, edges[1:], strict=False)])
        span = F.element_at(spans, (F.col(c) + 1).cast("int"))
        out[c] = F.sequence(span["a"], span["b"])
    df = cells.select(*FRAME, F.explode(out["x"]).alias("i"), out["y"].alias("k"))
    return df.select(*FRAME, F.col("i").alias("x"), F.explode("k").alias("y"))


def readings(px: DataFrame, width: int, height: int) -> DataFrame:
    """clip, frame, on: latent_reading of the cells of masks (rows or gathered) as gathered masks, of frames with any. Gathered masks are
    read where they are, and no pixel is shuffled."""
    read = latent_reader(width, height)

    def step(clips: pa.Array, frames: pa.Array, stack: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([clips.cast(pa.int64()), frames.cast(pa.int64()), listed(read(stack)[0])], names=["clip", "frame", "on"])

    return by_frame(gathered(px, width), step, width, height, "clip long, frame long, on array<int>").where(F.size("on") > 0)


def character_flags(area: Column, torn: Column) -> Column:
    """Checks of every reference mask: reference_empty without a pixel, reference_fragmented with a large detached piece (torn)."""
    return F.array_compact(F.array(F.when(area == 0, "reference_empty"), F.when(torn, "reference_fragmented")))


def extra_references(px: DataFrame, frames: DataFrame, fragments: DataFrame, width: int, height: int) -> DataFrame:
    """clip, index, area (share of the frame), flags of each extra reference; fragments: clip, frame, share of detached pieces."""
    area = px.select(*PIXEL).distinct().groupBy(*FRAME).agg(F.count("*").alias("n"))
    torn = fragments.where(F.col("share") >= FRAGMENT).select(*FRAME, F.lit(True).alias("torn")).distinct()
    df = frames.select(*FRAME).distinct().join(area, FRAME, "left").join(torn, FRAME, "left")
    n = F.coalesce("n", F.lit(0))
    return df.select("clip", F.col("frame").alias("index"), (n / (width * height)).alias("area"), character_flags(n, F.coalesce("torn", F.lit(False))).alias("flags"))


#: What a report says about a flag of a reference.
LINES = {
    "reference_empty": "the reference mask has no character (blue) pixel",
    "reference_fragmented": "a detached region of the character beside its largest one",
    "reference_misaligned": "the reference isn't posed and placed like the first driving frame",
}


def check_black_background(black_background: bool, replacement_mode: bool) -> None:
    if black_background and replacement_mode:
        raise ValueError("black_background is for animation mode: in replacement mode the result keeps the driving video's background")


def check_face_crop(face_crop: bool, sources: int | None, image: tuple[int, int], mask: tuple[int, int] | None = None) -> None:
    """sources: how many source images there are (None: not given); image, mask: (width, height) of the reference and its mask."""
    if not face_crop:
        return
    if sources is None:
        raise ValueError("face_crop is on, but there is no source image")
    if sources != 1:
        raise ValueError(f"there are {sources} source images; the face is cut from one")
    if mask is not None and mask != image:
        raise ValueError(f"the reference mask is {mask[0]}x{mask[1]}, the reference {image[0]}x{image[1]}")

"""Sizes, rates and resampling: what to load and write, and pixels at another size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.operators.masks import FRAME, PIXEL

#: Portrait sizes by model and label, a model's grid, the finest rate, the width of a soft edge.
SIZES = {"Wan": {"480p": (480, 832), "720p": (720, 1280)}, "SCAIL": {"512p": (512, 896), "704p": (704, 1280)}, "None": {"480p": (480, 854), "720p": (720, 1280), "1080p": (1080, 1920)}}
GRIDS = {"Wan": 16, "SCAIL": 32, "None": 1}
FINEST_RATE, SOFT = 1001000, 0.02
METHODS = ("nearest", "area", "bilinear", "bicubic", "lanczos")


# ---------------------------------------------------------------- sizes and rates


def load_size(videos: DataFrame, model: Column, label: Column, orientation: Column) -> DataFrame:
    """video_id, to_width, to_height: a model's size of a label, turned to an orientation (auto: the video's; a square is landscape).
    The label source keeps the video's own size: null. Unknown models, and labels a model lacks, are errors."""
    known = F.coalesce(*[F.when((model == m) & (label == name), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"))) for m, sizes in SIZES.items() for name, (w, h) in sizes.items()])
    bad = F.when(~model.isin(*SIZES), F.concat(F.lit("no such model: "), model)).when((label != "source") & known.isNull(), F.concat(label, F.lit(" is no size of "), model))
    tall = F.when(orientation == "auto", F.col("height") > F.col("width")).otherwise(orientation == "portrait")
    side = lambda a, b: F.when(bad.isNotNull(), F.raise_error(bad).cast("long")).otherwise(F.when(tall, known[a]).otherwise(known[b]).cast("long"))
    return videos.select("video_id", side("w", "h").alias("to_width"), side("h", "w").alias("to_height"))


def parse_rate(text: Column) -> Column:
    """Text as a rate: null if blank, else a finite number above 0; other text is an error."""
    rate = F.trim(text).try_cast("double")
    bad = rate.isNull() | F.isnan(rate) | ~(rate > 0) | (rate == float("inf"))
    return F.when(F.trim(text) == "", F.lit(None).cast("double")).when(bad, F.raise_error(F.concat(F.lit("not a rate: "), text)).cast("double")).otherwise(rate)


def parse_count(text: Column) -> Column:
    """Text as a count: null if blank, else a whole number from 1; other text is an error."""
    number = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("long"))
    bad = F.coalesce(number < 1, F.lit(True))
    return F.when(F.trim(text) == "", F.lit(None).cast("long")).when(bad, F.raise_error(F.concat(F.lit("not a count: "), text)).cast("long")).otherwise(number)


def write_plan(videos: DataFrame, rate: int) -> DataFrame:
    """video_id, fps_num, fps_den, to_width, to_height, samples: the exact rate a stream is written at, its sides made even upwards, and the
    audio samples at rate that cover its frames (half to even). The rate is the closest fraction with a denominator up to FINEST_RATE;
    there are few distinct rates, but they are worked out row by row in Arrow batches, so nothing is collected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[float, Fraction] = {}
        for pdf in batches:
            for fps in pdf["fps"].unique():
                known.setdefault(fps, Fraction(fps).limit_denominator(FINEST_RATE))
            yield pdf.assign(fps_num=[known[f].numerator for f in pdf["fps"]], fps_den=[known[f].denominator for f in pdf["fps"]])

    df = videos.select("video_id", F.col("fps").cast("double").alias("fps"), F.col("frames").cast("long").alias("frames"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    df = df.mapInPandas(run, "video_id long, fps double, frames long, width long, height long, fps_num long, fps_den long")
    even = lambda c: F.col(c) + F.col(c) % 2
    return df.select("video_id", "fps_num", "fps_den", even("width").alias("to_width"), even("height").alias("to_height"), F.bround(F.col("frames") * rate / F.col("fps"), 0).cast("long").alias("samples"))


def side_by_side(videos: DataFrame, key: Column) -> DataFrame:
    """key, frames, width, height of one side of videos shown beside each other: the fewest frames and the largest sides, cut to even."""
    even = lambda c: (F.max(c) - F.max(c) % 2).alias(c)
    return videos.groupBy(key.alias("key")).agg(F.min("frames").alias("frames"), even("width"), even("height"))


# ---------------------------------------------------------------- resampling


def taps(n: int, m: int, method: str) -> list[tuple[int, int, float]]:
    """(out, in, weight) of one axis that goes from n to m pixels; weights of one out add to 1. area averages all a pixel touches;
    bilinear and bicubic read about the pixel's middle, edges repeated; lanczos widens its kernel when it shrinks."""
    if method not in METHODS:
        raise ValueError(f"{method} is none of {', '.join(METHODS)}")
    found: dict[tuple[int, int], float] = {}

    def add(i: int, at: int, w: float) -> None:
        key = (i, min(max(at, 0), n - 1))
        found[key] = found.get(key, 0.0) + w

    for i in range(m):
        middle = (i + 0.5) * n / m
        if method == "nearest":
            add(i, int(middle), 1.0)
        elif method == "area":
            a, b = i * n // m, -(-(i + 1) * n // m)
            for at in range(a, b):
                add(i, at, 1 / (b - a))
        elif method == "bilinear":
            at = max(middle - 0.5, 0.0)
            add(i, int(at), 1 - at % 1)
            add(i, int(at) + 1, at % 1)
        elif method == "bicubic":
            at = math.floor(middle - 0.5)
            for k in range(-1, 3):
                d = abs(middle - 0.5 - at - k)
                add(i, at + k, (1.25 * d - 2.25) * d * d + 1 if d <= 1 else ((-0.75 * d + 3.75) * d - 6) * d + 3)
        else:
            wide = max(n / m, 1.0)
            reach = range(max(0, int(middle - 3 * wide + 0.5)), min(n, int(middle + 3 * wide + 0.5)))
            sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
            ws = [sinc(d) * sinc(d / 3) if abs(d) < 3 else 0.0 for d in ((at + 0.5 - middle) / wide for at in reach)]
            for at, w in zip(reach, ws, strict=True):
                add(i, at, w / sum(ws))
    return [(i, at, w) for (i, at), w in found.items() if w]


def resample(pixels: DataFrame, image: tuple[int, int], size: tuple[int, int], method: str, values: list[str]) -> DataFrame:
    """pixels (clip, frame, x, y, values) of an image at another size; pixels without a row count as 0, and rows come only where some
    input has one. The weights of both axes are broadcast: a few rows a pixel of a side, whatever the data."""
    spark = pixels.sparkSession
    across, down = (F.broadcast(spark.createDataFrame(taps(n, m, method), f"{o} long, {c} long, __w{c} double")) for o, c, n, m in (("__i", "x", image[0], size[0]), ("__k", "y", image[1], size[1])))
    df = pixels.select(*PIXEL, *values).join(across, "x").join(down, "y").groupBy(*FRAME, "__i", "__k")
    df = df.agg(*[F.sum(F.col(v) * F.col("__wx") * F.col("__wy")).alias(v) for v in values])
    return df.withColumnsRenamed({"__i": "x", "__k": "y"})


def cut_resized(logits: DataFrame, image: tuple[int, int], size: tuple[int, int], threshold: float = 0.0) -> DataFrame:
    """clip, frame, x, y where logits (clip, frame, x, y, v), brought to size, are above a threshold."""
    return resample(logits, image, size, "bilinear", ["v"]).where(F.col("v") > threshold).select(*PIXEL)


def feather(px: DataFrame, width: int, height: int, soft: float = SOFT) -> DataFrame:
    """clip, frame, x, y, weight of a mask with a soft edge inside it, about so much of the shorter side wide: averaged down by that
    factor and brought back up; pixels off the mask have no row."""
    step = max(1, round(min(width, height) * soft))
    coarse = (-(-width // step), -(-height // step))
    on = px.select(*PIXEL).distinct()
    up = resample(resample(on.withColumn("weight", F.lit(1.0)), (width, height), coarse, "area", ["weight"]), coarse, (width, height), "bilinear", ["weight"])
    return on.join(up, PIXEL).select(*PIXEL, F.least("weight", F.lit(1.0)).alias("weight"))


def on_black(pixels: DataFrame, px: DataFrame, values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Colour pixels with all off the mask black."""
    df = pixels.join(px.select(*PIXEL).distinct().withColumn("__on", F.lit(True)), PIXEL, "left")
    return df.withColumns({c: F.when(F.col("__on"), F.col(c)).otherwise(0.0) for c in values}).drop("__on")


def present(frames: DataFrame, px: DataFrame) -> DataFrame:
    """clip, frame, masked: whether each frame has any mask."""
    return frames.select(*FRAME).join(px.select(*FRAME).distinct().withColumn("masked", F.lit(True)), FRAME, "left").select(*FRAME, F.coalesce("masked", F.lit(False)).alias("masked"))

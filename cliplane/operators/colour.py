"""Colours brought from one clip to another: statistics in Lab, the transfer and its application; whole levels of 8 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.functions.columns import half_even, lab, srgb

#: How far spreads may be stretched.
LEAST, MOST = 0.5, 2.0
CHANNELS = "lab"


def requantized(value: Column) -> Column:
    """A value in 0..1 at the nearest of the 256 levels."""
    return half_even(value * 255) / 255


def statistics(pixels: DataFrame) -> DataFrame:
    """clip, ml, ma, mb, sl, sa, sb: weighted mean and spread of each Lab channel. pixels: clip, r, g, b, weight.

    Clips without weight have no row: there is nothing to estimate from."""
    df = pixels.select("clip", "weight", *[c.alias(n) for n, c in zip(CHANNELS, lab(F.col("r"), F.col("g"), F.col("b")), strict=True)])
    total = F.sum("weight")
    mean = df.groupBy("clip").agg(total.alias("total"), *[(F.sum(F.col(c) * F.col("weight")) / total).alias(f"m{c}") for c in CHANNELS])
    mean = mean.where("total > 0").drop("total")
    spread = [F.sqrt(F.sum((F.col(c) - F.col(f"m{c}")) ** 2 * F.col("weight")) / total).alias(f"s{c}") for c in CHANNELS]
    # a row a clip goes to the pixels: by clip these would meet in as many tasks as there are clips
    return df.join(F.broadcast(mean), "clip").groupBy("clip").agg(*[F.first(f"m{c}").alias(f"m{c}") for c in CHANNELS], *spread)


def transfer(source: DataFrame, target: DataFrame) -> DataFrame:
    """clip, from_*, to_*, ratio_* of each channel: what maps source's statistics to target's (a row a clip in both)."""
    to = target.select("clip", *[F.col(f"{k}{c}").alias(f"t{k}{c}") for k in "ms" for c in CHANNELS])
    ratio = [F.least(F.greatest(F.col(f"ts{c}") / F.greatest(F.col(f"s{c}"), F.lit(1e-6)), F.lit(LEAST)), F.lit(MOST)).alias(f"ratio_{c}") for c in CHANNELS]
    return source.join(to, "clip").select("clip", *[F.col(f"m{c}").alias(f"from_{c}") for c in CHANNELS], *[F.col(f"tm{c}").alias(f"to_{c}") for c in CHANNELS], *ratio)


def apply_transfer(pixels: DataFrame, maps: DataFrame, strength: float, weight: Column | float = 1.0) -> DataFrame:
    """pixels (clip, r, g, b, ...) moved towards the colours that their clip's transfer maps them to, by strength and weight."""
    df = pixels.join(F.broadcast(maps), "clip")
    own = lab(F.col("r"), F.col("g"), F.col("b"))
    moved = [(v - F.col(f"from_{c}")) * F.col(f"ratio_{c}") + F.col(f"to_{c}") for c, v in zip(CHANNELS, own, strict=True)]
    scale = strength * (weight if isinstance(weight, Column) else F.lit(weight))
    new = {c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) + scale * (v - F.col(c)))) for c, v in zip("rgb", srgb(*moved), strict=True)}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in pixels.columns])

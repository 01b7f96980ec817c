"""Column expressions: geometry, rounding, the 4k+1 grid and colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (corners x1, y1, x2, y2); 0 for a union without area."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def grid_down(n: Column, least: int = 5) -> Column:
    """Largest 4k+1 that is not over n."""
    return F.greatest(F.lit(least), F.floor((n - 1) / 4) * 4 + 1)


def grid_up(n: Column, least: int = 5) -> Column:
    """Smallest 4k+1 that is not under n."""
    return F.greatest(F.lit(least), F.ceil((n - 1) / 4) * 4 + 1)


def overlap_of_motion(n: Column) -> Column:
    return F.when(n <= 0, 0).otherwise(grid_down(n, 1))


def half_up_10bit(x: Column) -> Column:
    """Levels as whole numbers of 10 bits: halves go up, what is outside is clamped."""
    return F.floor(F.least(F.greatest(x + 0.5, F.lit(0.0)), F.lit(1023.0)))


#: Weights of red and blue in the luma, and the levels of limited range in 10 bits.
KR, KB = 0.2126, 0.0722
TV_10BIT = {"black": 64.0, "luma": 876.0, "zero": 512.0, "chroma": 896.0}


def luma(r: Column, g: Column, b: Column) -> Column:
    r, g, b = (F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in (r, g, b))
    return KR * r + (1 - KR - KB) * g + KB * b


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


#: Linear sRGB to XYZ, and the D65 white.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
D65 = (0.95047, 1.0, 1.08883)
DELTA = 6 / 29


def linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((F.greatest(v, F.lit(0.0)) + 0.055) / 1.055, 2.4))


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b of an sRGB colour in 0..1."""
    rgb = [linear(c) for c in (r, g, b)]
    part = []
    for row, white in zip(TO_XYZ, D65, strict=True):
        t = (rgb[0] * row[0] + rgb[1] * row[1] + rgb[2] * row[2]) / white
        part.append(F.when(t > DELTA**3, F.pow(F.greatest(t, F.lit(DELTA**3)), 1 / 3)).otherwise(t / (3 * DELTA**2) + 4 / 29))
    return [116.0 * part[1] - 16.0, 500.0 * (part[0] - part[1]), 200.0 * (part[1] - part[2])]


def inverse(m: tuple) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def srgb(light: Column, a: Column, b: Column) -> list[Column]:
    """sRGB in 0..1 of a Lab colour, clipped to the gamut."""
    y = (light + 16.0) / 116.0
    xyz = [F.when(t > DELTA, t * t * t).otherwise(3 * DELTA**2 * (t - 4 / 29)) * white for t, white in zip((y + a / 500.0, y, y - b / 200.0), D65, strict=True)]
    out = []
    for row in inverse(TO_XYZ):
        v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]))
        out.append(F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055))
    return out

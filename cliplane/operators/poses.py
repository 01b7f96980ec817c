"""Poses moved between images: box forms, crops, resizes with padding, foreign layouts, heat maps and detector crops.

Points are arrays of struct<x, y, c> in pixels. All of it is column arithmetic: no shuffle and no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The crop of a person (height, width) and how much wider than the box it is.
CROP, RESCALE = (224, 224), 1.25
SETS = ("body", "left_hand", "right_hand", "face")


def convert_box(box: Column, form: str) -> Column:
    """A box of four numbers in another form: corners (xyxy), corner and size (xywh), centre and size (ctwh)."""
    a, b, c, d = (box[k] for k in range(4))
    half = lambda v: F.floor(v / 2)
    forms = {
        "xyxy2xywh": (a, b, c - a, d - b),
        "xywh2xyxy": (a, b, c + a, d + b),
        "xyxy2ctwh": ((a + c) / 2, (b + d) / 2, c - a, d - b),
        "ctwh2xyxy": (a - half(c), b - half(d), a + (c - half(c)), b + (d - half(d))),
    }
    return F.array(*[v.cast("double") for v in forms[form]])


def valid(p: Column, width: Column | int, height: Column | int, threshold: float) -> Column:
    """Whether a point is sure enough and in the image, its far edges included."""
    return (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= width) & (p["y"] <= height) & (p["c"] >= threshold)


def bounds(points: Column, threshold: float = 0.5) -> Column:
    """x0, y0, x1, y1 of the points that are surer than the threshold; zeros if none is."""
    sure = F.filter(points, lambda p: p["c"] > threshold)
    side = lambda f, c: F.coalesce(f(F.transform(sure, lambda p: p[c])), F.lit(0.0))
    return F.struct(*[side(f, c).alias(f"{c}{k}") for k, f in enumerate((F.array_min, F.array_max)) for c in "xy"])


def mapped(points: Column, sx: Column | float = 1.0, sy: Column | float = 1.0, dx: Column | float = 0.0, dy: Column | float = 0.0) -> Column:
    """Points scaled, then moved. A crop to a corner moves by its negative; a resize scales by the quotient of the sides."""
    return F.transform(points, lambda p: F.struct((p["x"] * sx + dx).alias("x"), (p["y"] * sy + dy).alias("y"), p["c"].alias("c")))


def padding(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """scale, dx, dy that fit an image into another one about its centre: the longer side fits, the other gets bars."""
    tall = height / width > to_height / to_width
    bar = lambda side, full: F.floor((full - F.floor(side)) / 2)  # noqa: E731  (whole pixels, cut)
    return F.struct(
        F.when(tall, to_height / height).otherwise(to_width / width).alias("scale"),
        F.when(tall, bar(to_height / height * width, to_width)).otherwise(0).cast("double").alias("dx"),
        F.when(tall, 0).otherwise(bar(to_width / width * height, to_height)).cast("double").alias("dy"),
    )


def with_confidence(points: Column) -> Column:
    """Points without a confidence (a null c, as in layouts of two numbers a point) have 1."""
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.coalesce(p["c"], F.lit(1.0)).alias("c")))


def from_listed_body(points: Column, width: Column, height: Column) -> Column:
    """A body as a list of relative points, null where one is missing: in pixels, confidence 1, or 0 at the corner."""
    place = lambda p, c, n: F.coalesce(p[c], F.lit(0.0)) * n
    return F.transform(points, lambda p: F.struct(place(p, "x", width).alias("x"), place(p, "y", height).alias("y"), F.when(p.isNull(), 0.0).otherwise(1.0).alias("c")))


def to_image(x: Column, y: Column, centre: tuple[Column, Column], scale: tuple[Column, Column], size: tuple[int, int], udp: bool = False) -> tuple[Column, Column]:
    """A place on a heat map of size (width, height) in the image whose part about a centre it shows; scale: that part's sides.

    udp: places are counted between the middles of the first and the last cell."""
    step = [s / (n - int(udp)) for s, n in zip(scale, size, strict=True)]
    return tuple(v * s + m - full * 0.5 for v, s, m, full in zip((x, y), step, centre, scale, strict=True))


def affine(centre: tuple[Column, Column], scale: Column, size: tuple[int, int], rot: float = 0.0) -> list[Column]:
    """Two rows of a matrix (a, b, c) from the image to a crop of size (height, width); scale in units of 200 pixels of height."""
    high = 200 * scale
    wide = high / (size[0] / size[1])
    sx, sy = size[1] / wide, size[0] / high
    tx, ty = size[1] * (-centre[0] / wide + 0.5), size[0] * (-centre[1] / high + 0.5)
    if not rot:
        return [sx, F.lit(0.0), tx, F.lit(0.0), sy, ty]
    sn, cs = math.sin(math.radians(-rot)), math.cos(math.radians(-rot))
    mx, my = size[1] / 2, size[0] / 2  # the crop turns about its middle
    ux, uy = tx - mx, ty - my
    return [cs * sx, -sn * sy, cs * ux - sn * uy + mx, sn * sx, cs * sy, sn * ux + cs * uy + my]


def transformed(x: Column, y: Column, m: list[Column], invert: bool = False) -> tuple[Column, Column]:
    """A pixel (counted from 1) through a matrix or back, rounded half to even."""
    a, b, c, d, e, f = m
    u, w = x - 1, y - 1
    if invert:
        det = a * e - b * d
        u, w = u - c, w - f
        out = ((e * u - b * w) / det, (a * w - d * u) / det)
    else:
        out = (a * u + b * w + c, d * u + e * w + f)
    return tuple(F.bround(v, 0).cast("long") + 1 for v in out)


def detector_crop(box: list[Column], size: tuple[int, int] = CROP, rescale: float = RESCALE) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """(centre, scale) of the crop of size (height, width) about a detected box; scale is in units of 200 pixels, by axis."""
    aspect = size[0] / size[1]
    side = F.greatest((box[2] - box[0]) * aspect, box[3] - box[1])
    return ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2), (side / aspect / 200 * rescale, side / 200 * rescale)


def crop_window(centre: tuple[Column, Column], scale: tuple[Column, Column], size: tuple[int, int], width: int, height: int) -> Column:
    """The square part of an image that a crop shows, and the part of it that lies in the image.

    x0..y1: its corners in the image (they may lie outside it); w, h: its sides; ox0..oy1: what is read from the image;
    nx0..ny1: where that goes in the crop before it is resized."""
    m = affine(centre, F.greatest(*scale), size)
    ul = [v - 1 for v in transformed(F.lit(1), F.lit(1), m, True)]
    br = [v - 1 for v in transformed(F.lit(size[1] + 1), F.lit(size[0] + 1), m, True)]
    out = {}
    for c, a, b, n in zip("xy", ul, br, (width, height), strict=True):
        out |= {f"{c}0": a, f"{c}1": b, f"n{c}0": F.greatest(F.lit(0), -a), f"n{c}1": F.least(b, F.lit(n)) - a, f"o{c}0": F.greatest(F.lit(0), a), f"o{c}1": F.least(F.lit(n), b)}
    return F.struct(*[v.cast("long").alias(k) for k, v in out.items()], (br[0] - ul[0]).alias("w"), (br[1] - ul[1]).alias("h"))


def heat(cells: Column, x: Column, y: Column, width: int) -> Column:
    return F.get(cells, (y * width + x).cast("int"))


def peak(cells: Column, width: int) -> tuple[Column, Column, Column]:
    """(x, y, value) of the first largest cell of a heat map, row by row; x and y are -1 where it isn't over 0."""
    top = F.array_max(cells)
    at = F.array_position(cells, top) - 1
    on = lambda v: F.when(top > 0, v).otherwise(-1).cast("double")
    return on(at % width), on(F.floor(at / width)), top


def nudged(cells: Column, x: Column, y: Column, width: int, height: int, megvii: bool = False) -> tuple[Column, Column]:
    """A peak moved by a quarter of a cell towards its higher neighbours (megvii: and by half a cell more), off the edges."""
    inner = (x > 1) & (x < width - 1) & (y > 1) & (y < height - 1)
    more = 0.5 if megvii else 0.0
    dx = F.signum(heat(cells, x + 1, y, width) - heat(cells, x - 1, y, width)) * 0.25 + more
    dy = F.signum(heat(cells, x, y + 1, width) - heat(cells, x, y - 1, width)) * 0.25 + more
    return F.when(inner, x + dx).otherwise(x), F.when(inner, y + dy).otherwise(y)


def taylor(cells: Column, x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """A peak moved to the top of the parabola through the cells around it (log heat), two cells off the edges."""
    h = lambda i, j: heat(cells, x + i, y + j, width)
    inner = (x > 1) & (x < width - 2) & (y > 1) & (y < height - 2)
    dx, dy = 0.5 * (h(1, 0) - h(-1, 0)), 0.5 * (h(0, 1) - h(0, -1))
    dxx, dyy = 0.25 * (h(2, 0) - 2 * h(0, 0) + h(-2, 0)), 0.25 * (h(0, 2) - 2 * h(0, 0) + h(0, -2))
    dxy = 0.25 * (h(1, 1) - h(1, -1) - h(-1, 1) + h(-1, -1))
    det = dxx * dyy - dxy * dxy
    go = inner & (det != 0)
    return F.when(go, x - (dyy * dx - dxy * dy) / det).otherwise(x), F.when(go, y - (dxx * dy - dxy * dx) / det).otherwise(y)


#: The small kernels that stand for a Gaussian of their size; larger ones are computed.
KERNELS = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


def gaussian(size: int) -> list[float]:
    """Weights of a Gaussian kernel of an odd size, whose spread follows from the size."""
    if size in KERNELS:
        return KERNELS[size]
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [w / sum(weights) for w in weights]


def blurred(cells: Column, width: int, height: int, kernel: int, mirror: bool = False) -> Column:
    """A heat map blurred along rows, then along columns. Beyond the border it is cold, or mirrored about the outermost cells.

    With a cold border it is brought back to its old maximum."""
    weights = gaussian(kernel)
    half = kernel // 2

    def along(values: Column, step: int, n: int) -> Column:
        def one(_: Column, i: Column) -> Column:
            place = F.floor(i / step) % n
            total = F.lit(0.0)
            for k, w in enumerate(weights):
                to = place + (k - half)
                if mirror:
                    inside = F.when(to < 0, -to).when(to >= n, 2 * n - 2 - to).otherwise(to)
                    total = total + w * F.get(values, (i + (inside - place) * step).cast("int"))
                else:
                    total = total + w * F.when((to >= 0) & (to < n), F.get(values, (i + (k - half) * step).cast("int"))).otherwise(0.0)
            return total

        return F.transform(values, one)

    # each pass is bound once, by a map over an array of one element
    rows = F.transform(F.array(cells), lambda v: along(v, 1, width))
    both = F.transform(rows, lambda v: along(v, width, height))
    if mirror:
        return both[0]
    return F.transform(both, lambda v: F.transform(v, lambda x: x * (F.array_max(cells) / F.array_max(v))))[0]


def log_heat(cells: Column) -> Column:
    """Heat kept within 0.001 and 50, as logarithms."""
    return F.transform(cells, lambda v: F.log(F.least(F.lit(50.0), F.greatest(F.lit(0.001), v))))


def refined(logs: Column, x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """A peak moved by the inverse of the second derivatives times the first ones; beyond the border stands the outermost cell.

    logs: log_heat of a blurred map. Peaks that aren't there (-1) stay."""
    near = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), v))
    h = lambda i, j: heat(logs, near(x + i, width), near(y + j, height), width)
    eps = 2.0**-23  # keeps a flat map's second derivatives invertible
    dx, dy = 0.5 * (h(1, 0) - h(-1, 0)), 0.5 * (h(0, 1) - h(0, -1))
    dxx, dyy = h(1, 0) - 2 * h(0, 0) + h(-1, 0) + eps, h(0, 1) - 2 * h(0, 0) + h(0, -1) + eps
    dxy = 0.5 * (h(1, 1) - h(1, 0) - h(0, 1) + 2 * h(0, 0) - h(-1, 0) - h(0, -1) + h(-1, -1))
    det = dxx * dyy - dxy * dxy
    there = x >= 0
    return F.when(there, x - (dyy * dx - dxy * dy) / det).otherwise(x), F.when(there, y - (dxx * dy - dxy * dx) / det).otherwise(y)

"""Measures on body keypoints (arrays of structs) and the draw rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.functions.columns import distance
from cliplane.operators.boxes import by_frame

#: Keypoint names in order, and the limbs as pairs of them.
NAMES = ["nose", "neck", "r_shoulder", "r_elbow", "r_wrist", "l_shoulder", "l_elbow", "l_wrist", "r_hip", "r_knee", "r_ankle", "l_hip", "l_knee", "l_ankle", "r_eye", "l_eye", "r_ear", "l_ear", "l_foot", "r_foot"]
LIMBS = [(1, 2), (1, 5), (2, 3), (3, 4), (5, 6), (6, 7), (1, 8), (8, 9), (9, 10), (1, 11), (11, 12), (12, 13), (1, 0), (0, 14), (14, 16), (0, 15), (15, 17), (13, 18), (10, 19)]
TORSO = [0, 1, 2, 5, 8, 11]
LIMB_ENDS = [3, 4, 6, 7, 9, 10, 12, 13, 18, 19]
ARMS = {"left": (6, 7), "right": (3, 4)}
DRAW, LIMB_WIDTH, MIRROR, SPIKE_BACK = 0.5, 0.25, 0.2, 3


def at(j: int, body: Column | None = None) -> Column:
    return (F.col("body") if body is None else body)[j]


def drawn(j: int, threshold: float = DRAW, body: Column | None = None) -> Column:
    return at(j, body)["c"] >= threshold


def counts(pose: DataFrame, threshold: float = DRAW) -> DataFrame:
    """pose_conf, drawn_keypoints and drawn_limbs of each frame; keypoints off the frame count too."""
    on = lambda j: drawn(j, threshold)
    number = lambda flags: reduce(lambda a, b: a + b, [F.when(f, 1).otherwise(0) for f in flags]).cast("long")
    conf = F.aggregate("body", F.lit(0.0), lambda a, p: a + p["c"]) / F.size("body")
    return pose.select("clip", "frame", conf.alias("pose_conf"), number([on(j) for j in range(20)]).alias("drawn_keypoints"), number([on(a) & on(b) for a, b in LIMBS]).alias("drawn_limbs"))


def body_scale(threshold: float = DRAW) -> Column:
    part = lambda a, b, k=1.0: F.when(drawn(a, threshold) & drawn(b, threshold), k * distance(at(a), at(b))).otherwise(0.0)
    return F.greatest(part(2, 5), part(8, 11), part(1, 0, 1.5), F.lit(1.0))


def out_of_shot(pose: DataFrame, width: int, height: int, threshold: float = DRAW) -> DataFrame:
    """Limbs with one end drawn whose other end the model put outside the frame or near its edge: clip, frame, a, b."""
    df = pose.withColumn("scale", body_scale(threshold))
    limbs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LIMBS])
    df = df.select("clip", "frame", "body", "scale", F.explode(limbs).alias("limb"))
    first = F.element_at("body", F.col("limb.a") + 1)
    second = F.element_at("body", F.col("limb.b") + 1)
    one = (first["c"] >= threshold) != (second["c"] >= threshold)
    other = F.when(first["c"] >= threshold, second).otherwise(first)
    edge = F.least(other["x"], width - 1 - other["x"], other["y"], height - 1 - other["y"])
    return df.where(one & (edge < LIMB_WIDTH * F.col("scale"))).select("clip", "frame", F.col("limb.a").cast("long").alias("a"), F.col("limb.b").cast("long").alias("b"))


def torso_move(pose: DataFrame, threshold: float = DRAW) -> DataFrame:
    """Largest move of a torso keypoint that is drawn in this frame and the one before, in pixels; 0 if there is none."""
    before = F.lag("body").over(by_frame())
    df = pose.select("clip", "frame", "body", before.alias("before"))
    on = lambda j, b: drawn(j, threshold, b)
    body, prev = F.col("body"), F.col("before")
    moves = [F.when(on(j, body) & on(j, prev), distance(at(j, body), at(j, prev))) for j in TORSO]
    return df.select("clip", "frame", F.coalesce(F.greatest(*moves), F.lit(0.0)).alias("torso_move"))


def limb_spikes(pose: DataFrame, height: int, most: float = 0.08, threshold: float = DRAW) -> DataFrame:
    """clip, frame, keypoint: limb ends that jumped away and came back within SPIKE_BACK frames, on the frames they were away."""
    pts = F.array(*[F.struct(F.lit(j).alias("keypoint"), at(j)["x"].alias("x"), at(j)["y"].alias("y"), drawn(j, threshold).alias("on")) for j in LIMB_ENDS])
    long = pose.select("clip", "frame", F.explode(pts).alias("p")).select("clip", "frame", "p.*")
    w = Window.partitionBy("clip", "keypoint").orderBy("frame")
    this = F.struct("x", "y", "on")
    df = long.select("clip", "frame", "keypoint", this.alias("now"), F.lag(this).over(w).alias("was"), *[F.lead(this, k).over(w).alias(f"n{k}") for k in range(1, SPIKE_BACK + 1)])
    jumped = F.col("was.on") & F.col("now.on") & (distance(F.col("now"), F.col("was")) > most * height)
    back = F.coalesce(*[F.when(F.col(f"n{k}.on") & (distance(F.col(f"n{k}"), F.col("was")) < most * height / 2), k) for k in range(1, SPIKE_BACK + 1)])
    return df.where(jumped & back.isNotNull()).select("clip", "keypoint", F.explode(F.sequence(F.col("frame"), F.col("frame") + back - 1)).alias("frame")).distinct().select("clip", "frame", F.col("keypoint").cast("long").alias("keypoint"))


def mirrored_arms(pose: DataFrame, threshold: float = DRAW) -> DataFrame:
    """clip, frame, side: the less confident arm where both arms lie on one another."""
    scale = F.greatest(distance(at(2), at(5)), distance(at(8), at(11)), 1.5 * distance(at(1), at(0)), F.lit(1.0))
    near = (distance(at(3), at(6)) < MIRROR * scale) & (distance(at(4), at(7)) < MIRROR * scale)
    whole = {s: drawn(e, threshold) & drawn(w, threshold) for s, (e, w) in ARMS.items()}
    some = {s: drawn(e, threshold) | drawn(w, threshold) for s, (e, w) in ARMS.items()}
    conf = {s: at(e)["c"] + at(w)["c"] for s, (e, w) in ARMS.items()}
    seen = (whole["right"] & some["left"]) | (whole["left"] & some["right"])
    side = F.when(conf["right"] < conf["left"], "right").otherwise("left")
    return pose.where(near & seen & (conf["right"] != conf["left"])).select("clip", "frame", side.alias("side"))


def overlong_forearms(pose: DataFrame, limit: float, threshold: float = DRAW) -> DataFrame:
    """clip, side, frame, median, ratio: drawn forearms longer than limit times the clip's median."""
    arms = F.array(*[F.struct(F.lit(s).alias("side"), distance(at(e), at(w)).alias("length"), (drawn(e, threshold) & drawn(w, threshold)).alias("on")) for s, (e, w) in ARMS.items()])
    long = pose.select("clip", "frame", F.explode(arms).alias("a")).where("a.on").select("clip", "frame", "a.side", "a.length")
    median = F.percentile("length", 0.5).over(Window.partitionBy("clip", "side"))
    return long.withColumn("median", median).where(F.col("length") > limit * F.col("median")).select("clip", "side", "frame", "median", (F.col("length") / F.col("median")).alias("ratio"))


def face_box(points: Column, width: int, height: int, scale: float = 1.3) -> Column:
    """Crop box (x1, x2, y1, y2) around finite points [struct<x, y>]; the frame's centre if there is none."""
    finite = lambda c: F.abs(c) < float("inf")  # noqa: E731  (NaN is above it)
    good = F.filter(points, lambda p: finite(p["x"]) & finite(p["y"]))
    values = {"x": F.transform(good, lambda p: p["x"]), "y": F.transform(good, lambda p: p["y"])}
    bound = {k: F.coalesce((F.array_min if k[1] == "0" else F.array_max)(values[k[0]]), F.lit((width if k[0] == "x" else height) / 2.0)) for k in ("x0", "x1", "y0", "y1")}
    least = max(8.0, 0.05 * min(width, height))
    side = {}
    for c in "xy":
        a, b = bound[c + "0"], bound[c + "1"]
        mid = (a + b) / 2
        side[c + "0"], side[c + "1"] = F.when(b - a < least, mid - least / 2).otherwise(a), F.when(b - a < least, mid + least / 2).otherwise(b)
    w, h = side["x1"] - side["x0"], side["y1"] - side["y0"]
    new_w, new_h = F.sqrt(w * h * scale * (w / h)), F.sqrt(w * h * scale * (h / w))
    dx, dy = (new_w - w) / 2, (new_h - h) / 4
    return F.struct(
        F.greatest(side["x0"] - dx, F.lit(0.0)).cast("long").alias("x1"), F.least(side["x1"] + dx, F.lit(float(width))).cast("long").alias("x2"),
        F.greatest(side["y0"] - 3 * dy, F.lit(0.0)).cast("long").alias("y1"), F.least(side["y1"] + dy, F.lit(float(height))).cast("long").alias("y2"),
    )


def settled(smooth: dict[str, Column], width: int, height: int) -> list[Column]:
    """Smoothed corners of the valid boxes, the invalid boxes' own, back inside the frame and cut to whole pixels."""
    side = lambda c: float(width if c[0] == "x" else height)
    return [F.greatest(F.lit(0.0), F.least(F.lit(side(c)), F.when(F.col("score") > 0, v).otherwise(F.col(c)))).cast("long").alias(c) for c, v in smooth.items()]


def smooth_median(boxes: DataFrame, width: int, height: int, half: int = 2) -> DataFrame:
    """Median of each coordinate over the valid boxes within so many frames."""
    near = by_frame().rowsBetween(-half, half)
    return boxes.select("clip", "frame", *settled({c: F.percentile(F.when(F.col("score") > 0, F.col(c)), 0.5).over(near) for c in ("x1", "y1", "x2", "y2")}, width, height))


def smooth_size(boxes: DataFrame, width: int, height: int, sigma: float = 2.0) -> DataFrame:
    """Centres stay; log sizes are averaged with Gaussian weights over the valid boxes nearby. Offsets are lags, so one window serves."""
    import math

    radius = math.ceil(3 * sigma)
    w = by_frame()
    size = {"w": F.log(F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0))), "h": F.log(F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0)))}
    df = boxes.select("clip", "frame", "x1", "y1", "x2", "y2", "score", size["w"].alias("lw"), size["h"].alias("lh"))
    df = df.select("*", *[F.lag(F.struct("lw", "lh", "score"), -k).over(w).alias(f"o{k + radius}") for k in range(-radius, radius + 1)])
    total, sums = F.lit(0.0), {"lw": F.lit(0.0), "lh": F.lit(0.0)}
    for k in range(-radius, radius + 1):
        g, o = math.exp(-0.5 * (k / sigma) ** 2), F.col(f"o{k + radius}")
        valid = o["score"] > 0
        total = total + F.when(valid, g).otherwise(0.0)
        sums = {c: v + F.when(valid, g * o[c]).otherwise(0.0) for c, v in sums.items()}
    half = {c: F.exp(F.when(total > 0, v / F.greatest(total, F.lit(1e-12))).otherwise(F.col(c))) / 2 for c, v in sums.items()}
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return df.select("clip", "frame", *settled({"x1": cx - half["lw"], "y1": cy - half["lh"], "x2": cx + half["lw"], "y2": cy + half["lh"]}, width, height))

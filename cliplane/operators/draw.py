"""Draw rules on hands and faces, what they hide, keypoint layouts and points as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.functions.columns import distance
from cliplane.operators.boxes import by_frame, in_frame
from cliplane.operators.pose import ARMS, DRAW, at, drawn

#: Limits of the hand and face rules, the jaw line among the face points (1 to 17), nose and eyes of the body.
DUP_RATIO, DUP_SHARED, JAW_CUT, JAW, FACE = 0.6, 3, 0.835, (1, 17), (0, 14, 15)
#: The body keypoints that are offered as points of the first frame.
KEY_POINTS = (0, 1, 2, 5, 8, 11, 10, 13)
#: The 133 whole-body points that are averaged in pairs to the 20 of the body layout.
BODY_FIRST = (0, 6, 6, 8, 10, 5, 7, 9, 12, 14, 16, 11, 13, 15, 2, 1, 4, 3, 17, 20)
BODY_SECOND = (0, 5, 6, 8, 10, 5, 7, 9, 12, 14, 16, 11, 13, 15, 2, 1, 4, 3, 18, 21)
#: The other parts of the body layout: first point and number of points among the 133.
PARTS = {"left_hand": (91, 21), "right_hand": (112, 21), "face": (22, 69)}
RULES = ("limb_dedup", "forearm_rule", "back_view_face")
SIDES = ("right", "left")


def whole_from_70() -> list[int | None]:
    """For each of the 133 whole-body points its place among the 70; None for the face.

    Body points keep their places but for the wrists, which come from the hands; legs and feet lie two places earlier. A hand is
    its wrist, then five fingers of four points, base first; the 70 hold them tip first."""
    place: list[int | None] = [*range(9), 62, 41, *range(9, 21), *[None] * 68]
    for wrist, tip in ((62, 42), (41, 21)):
        place += [wrist, *[tip + 4 * finger + 3 - k for finger in range(5) for k in range(4)]]
    return place


def diagonal(hand: Column, threshold: float) -> Column:
    """Of the box around a hand's drawn points; null if none is drawn."""
    on = F.filter(hand, lambda p: p["c"] >= threshold)
    span = lambda c: F.array_max(F.transform(on, lambda p: p[c])) - F.array_min(F.transform(on, lambda p: p[c]))
    return F.hypot(span("x"), span("y"))


def hands_coincide(threshold: float = DRAW) -> Column:
    """Whether left_hand and right_hand are one hand drawn twice: the median distance of the points drawn in both is small."""
    left, right = F.col("left_hand"), F.col("right_hand")
    pairs = F.filter(F.arrays_zip(left, right), lambda p: (p["left_hand"]["c"] >= threshold) & (p["right_hand"]["c"] >= threshold))
    far = F.array_sort(F.transform(pairs, lambda p: distance(p["left_hand"], p["right_hand"])))
    n = F.size(far)
    # element_at fails on place 0, so places of an empty array are moved up and its null stays out
    median = (F.try_element_at(far, F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int"))) + F.try_element_at(far, F.greatest(F.lit(1), F.floor(n / 2 + 1).cast("int")))) / 2
    size = F.greatest(diagonal(left, threshold), diagonal(right, threshold), F.lit(1.0))
    return F.coalesce((n >= DUP_SHARED) & (median / size < DUP_RATIO), F.lit(False))


def duplicate_hands(pose: DataFrame, threshold: float = DRAW) -> DataFrame:
    """clip, frame, side: hands that are the other hand drawn again. The other arm is whole, this one isn't, here and on a frame next to it."""
    whole = {s: drawn(e, threshold) & drawn(w, threshold) for s, (e, w) in ARMS.items()}
    df = pose.select("clip", "frame", *[w.alias(s) for s, w in whole.items()], hands_coincide(threshold).alias("same"))
    df = df.withColumns({f"near_{s}": F.coalesce(~F.lag(s).over(by_frame()), F.lit(False)) | F.coalesce(~F.lead(s).over(by_frame()), F.lit(False)) for s in SIDES})
    side = F.when(F.col("right"), "left").otherwise("right")
    near = F.when(F.col("right"), F.col("near_left")).otherwise(F.col("near_right"))
    return df.where((F.col("left") != F.col("right")) & F.col("same") & near).select("clip", "frame", side.alias("side"))


def back_view_faces(pose: DataFrame, threshold: float = DRAW) -> DataFrame:
    """clip, frame: a nose or eye is drawn on a body seen from behind (left shoulder on the image's left) whose jaw line is unsure."""
    jaw = F.slice("face", JAW[0] + 1, JAW[1] - JAW[0] + 1)
    sure = F.aggregate(jaw, F.lit(0.0), lambda a, p: a + p["c"]) / F.size(jaw)
    any_drawn = reduce(lambda a, b: a | b, [drawn(j, threshold) for j in FACE])
    return pose.where((at(5)["x"] < at(2)["x"]) & (sure < JAW_CUT) & any_drawn).select("clip", "frame")


def hidden_parts(duplicates: DataFrame, mirrored: DataFrame, overlong: DataFrame, back_view: DataFrame) -> DataFrame:
    """clip, frame, body, hands, rules: what the rules leave out of the frames they fire on. body: keypoints, ascending; hands: sides,
    ascending; rules: each rule with the places it fired on, in the order of RULES and SIDES."""
    ints = lambda *x: F.array(*[F.lit(k) for k in x]) if x else F.expr("CAST(array() AS array<int>)")
    side = lambda df, rule: df.select("clip", "frame", F.lit(RULES.index(rule)).alias("rule"), "side")
    arm = F.when(F.col("side") == "left", ints(*ARMS["left"])).otherwise(ints(*ARMS["right"]))
    wrist = F.when(F.col("side") == "left", ints(ARMS["left"][1])).otherwise(ints(ARMS["right"][1]))
    rows = side(duplicates, "limb_dedup").withColumn("points", ints()).unionByName(side(mirrored, "limb_dedup").withColumn("points", arm)).unionByName(side(overlong, "forearm_rule").withColumn("points", wrist))
    rows = rows.unionByName(side(back_view.withColumn("side", F.lit("head")), "back_view_face").withColumn("points", ints(*FACE)))
    place = F.when(F.col("side") == "right", 0).when(F.col("side") == "left", 1).otherwise(2)
    g = rows.groupBy("clip", "frame").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("points")))).alias("body"),
        F.array_sort(F.collect_set(F.when(F.col("side") != "head", F.col("side")))).alias("hands"),
        F.array_sort(F.collect_set(F.struct("rule", place.alias("place"), "side"))).alias("fired"),
    )
    sides = lambda k: F.transform(F.filter("fired", lambda f: f["rule"] == k), lambda f: f["side"])
    rules = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), sides(k).alias("places")) for k, r in enumerate(RULES)]), lambda r: F.size(r["places"]) > 0)
    return g.select("clip", "frame", "body", "hands", rules.alias("rules"))


def key_points_json(pose: DataFrame, width: int, height: int, frame: int = 0, threshold: float = DRAW) -> DataFrame:
    """clip, points: the frame's sure key points on the frame, in whole pixels, as JSON text."""
    one = F.array(*[F.when((at(j)["c"] >= threshold), F.struct(at(j)["x"].cast("int").alias("x"), at(j)["y"].cast("int").alias("y"))) for j in KEY_POINTS])
    good = F.filter(one, lambda p: p.isNotNull() & in_frame(p["x"], p["y"], width, height))
    text = F.concat(F.lit("["), F.array_join(F.transform(good, lambda p: F.format_string('{"x": %d, "y": %d}', p["x"], p["y"])), ", "), F.lit("]"))
    return pose.where(F.col("frame") == frame).select("clip", text.alias("points"))


def whole_body(points: Column) -> Column:
    """133 whole-body points out of an array of 70 or more; the face's are zero."""
    nothing = F.struct(*[F.lit(0.0).alias(c) for c in "xyc"])
    return F.array(*[nothing if k is None else points[k] for k in whole_from_70()])


def body_layout(points: Column) -> dict[str, Column]:
    """The 20 body points, the hands and the face (whose first point is a heel) out of 133 whole-body points."""
    mean = lambda a, b: F.struct(*[((points[a][c] + points[b][c]) / 2).alias(c) for c in "xyc"])
    body = F.array(*[mean(a, b) for a, b in zip(BODY_FIRST, BODY_SECOND, strict=True)])
    return {"body": body} | {k: F.slice(points, first + 1, n) for k, (first, n) in PARTS.items()}

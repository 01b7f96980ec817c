"""Boxes over time: one window over (clip, frame) each, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.functions.columns import iou

CORNERS = ["x1", "y1", "x2", "y2"]
BOX_WINDOW, BOX_MARGIN, EDGE_SNAP, MIN_SIDE = 4, 0.1, 0.15, 10
NMS_IOU = 0.1


def by_frame():
    """Frames of a clip in order."""
    return Window.partitionBy("clip").orderBy("frame")


def iou_with_previous(boxes: DataFrame) -> DataFrame:
    """box_iou_prev: null on the first frame and where either frame is undetected."""
    before = [F.lag(c).over(by_frame()) for c in CORNERS]
    value = F.when((F.col("score") > 0) & (F.lag("score").over(by_frame()) > 0), iou([F.col(c) for c in CORNERS], before))
    return boxes.withColumn("box_iou_prev", value)


def widen(boxes: DataFrame, window: int) -> DataFrame:
    """Each detected box becomes the union of the detected boxes within so many frames; undetected rows stay."""
    near = by_frame().rowsBetween(-window, window)
    seen = lambda c: F.when(F.col("score") > 0, F.col(c))
    new = {c: F.when(F.col("score") > 0, (F.min if c[1] == "1" else F.max)(seen(c)).over(near)).otherwise(F.col(c)) for c in CORNERS}
    return boxes.select(*[c for c in boxes.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def envelope(boxes: DataFrame, width: int, height: int, window: int = BOX_WINDOW, margin: float = BOX_MARGIN) -> DataFrame:
    """ex1..ey2: union of the grown, clipped boxes nearby; the whole frame where none is detected."""
    near = by_frame().rowsBetween(-window, window)
    wide, high = F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    grown = {
        "ex1": F.greatest(F.lit(0.0), F.col("x1") - margin * wide), "ey1": F.greatest(F.lit(0.0), F.col("y1") - margin * high),
        "ex2": F.least(F.lit(float(width)), F.col("x2") + margin * wide), "ey2": F.least(F.lit(float(height)), F.col("y2") + margin * high),
    }
    whole = {"ex1": 0.0, "ey1": 0.0, "ex2": float(width), "ey2": float(height)}
    pick = lambda k, v: (F.min if k[2] == "1" else F.max)(F.when(F.col("score") > 0, v)).over(near)
    return boxes.select("*", *[F.coalesce(pick(k, v), F.lit(whole[k])).alias(k) for k, v in grown.items()])


def snap(boxes: DataFrame, width: int, height: int, edge: float = EDGE_SNAP) -> DataFrame:
    """Sides near the frame's edge move onto it; both axes use the box's own size."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    new = {
        "x1": F.when(F.col("x1") < edge * wide, 0.0).otherwise(F.col("x1")), "y1": F.when(F.col("y1") < edge * high, 0.0).otherwise(F.col("y1")),
        "x2": F.when(width - F.col("x2") < edge * wide, float(width)).otherwise(F.col("x2")), "y2": F.when(height - F.col("y2") < edge * high, float(height)).otherwise(F.col("y2")),
    }
    return boxes.select(*[c for c in boxes.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def fallback(boxes: DataFrame, width: int, height: int, least: int = MIN_SIDE) -> DataFrame:
    """Undetected or tiny boxes become the whole frame with score -1 and nobody."""
    bad = (F.col("score") <= 0) | (F.col("x2") - F.col("x1") < least) | (F.col("y2") - F.col("y1") < least)
    whole = {"x1": 0.0, "y1": 0.0, "x2": float(width), "y2": float(height), "score": -1.0, "persons": 0}
    return boxes.select("clip", "frame", *[F.when(bad, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in whole.items()])


def parse(text: Column) -> Column:
    """A box from JSON text: four numbers or a startX/startY/endX/endY record (put in corner order); null if it is no box."""
    listed = F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})
    named = F.from_json(text, "struct<startX:double,startY:double,endX:double,endY:double>", {"mode": "PERMISSIVE"})
    box = F.when(F.size(listed) >= 4, F.slice(listed, 1, 4)).when(
        named["startX"].isNotNull() & named["endY"].isNotNull(),
        F.array(F.least(named["startX"], named["endX"]), F.least(named["startY"], named["endY"]), F.greatest(named["startX"], named["endX"]), F.greatest(named["startY"], named["endY"])),
    )
    return F.when((box[2] > box[0]) & (box[3] > box[1]), box)


def supplied(asks: DataFrame) -> DataFrame:
    """clip, frame, x1, y1, x2, y2, score (1) of boxes that a user gives: asks is clip, text, n (frames).

    The text is JSON: one box, used on all frames, or a list of one box a frame; a box is four numbers (more are ignored) or a record
    of startX, startY, endX, endY. Anything else, boxes without an inside, and another number of boxes than frames are errors."""
    record = "struct<startX:double,startY:double,endX:double,endY:double>"
    strict = {"mode": "PERMISSIVE"}
    one, many = F.from_json("text", "array<double>", strict), F.from_json("text", "array<array<double>>", strict)
    single, records = F.from_json("text", record, strict), F.from_json("text", f"array<{record}>", strict)
    corners = lambda b: F.when(F.size(b) >= 4, F.slice(b, 1, 4))
    fields = lambda b: F.when(b["startX"].isNotNull() & b["startY"].isNotNull() & b["endX"].isNotNull() & b["endY"].isNotNull(), F.array(F.least(b["startX"], b["endX"]), F.least(b["startY"], b["endY"]), F.greatest(b["startX"], b["endX"]), F.greatest(b["startY"], b["endY"])))
    start = F.substring(F.regexp_replace("text", r"\s", ""), 1, 2)
    boxes = (
        F.when(F.substring(start, 1, 1) == "{", F.array(fields(single)))
        .when(start == "[{", F.transform(records, fields))
        .when(start == "[[", F.transform(many, corners))
        .when(F.substring(start, 1, 1) == "[", F.array(corners(one)))
    )
    df = asks.select("clip", "n", "text", boxes.alias("boxes"))
    whole = F.forall("boxes", lambda b: b.isNotNull() & (F.size(F.array_compact(b)) == 4))
    inside = F.forall("boxes", lambda b: (b[2] > b[0]) & (b[3] > b[1]))
    told = lambda words, *cols: F.raise_error(F.format_string(words, *cols)).cast("boolean")
    clip = F.col("clip").cast("string")
    fine = (
        F.when(F.col("boxes").isNull() | (F.size("boxes") == 0) | ~F.coalesce(whole, F.lit(False)), told("clip %s: no box or list of boxes: %s", clip, F.substring("text", 1, 80)))
        .when(~inside, told("clip %s: a box ends before it begins: %s", clip, F.substring("text", 1, 80)))
        .when((F.size("boxes") > 1) & (F.size("boxes") != F.col("n")), told("clip %s: %d boxes for %d frames", clip, F.size("boxes"), F.col("n").cast("int")))
        .otherwise(True)
    )
    frame = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("frame")
    df = df.where(fine).where("n > 0").select("clip", "boxes", frame)
    box = F.element_at("boxes", F.when(F.size("boxes") == 1, 1).otherwise(F.col("frame") + 1).cast("int"))
    return df.select("clip", "frame", *[box[k].alias(c) for k, c in enumerate(CORNERS)], F.lit(1.0).alias("score"))


def in_frame(x: Column, y: Column, width: int, height: int) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def choose_person(candidates: DataFrame, keys: list[str], name: str, least: float = 0.05, ratio: float = 0.4) -> DataFrame:
    """keys, chosen (the name of the person's box): of each frame's boxes over the score, best score first, a larger one takes
    over unless its long side is under this ratio of that of the one to beat, which is at first the longest of all.

    A frame's boxes are few, so they are folded as an array; ties of the score go by name."""
    size, side = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    one = F.struct((-F.col("score")).alias("place"), F.col(name).alias("name"), size.alias("size"), side.alias("side"))
    g = candidates.where(F.col("score") > least).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"), F.max(side).alias("longest"))
    none = F.expr("CAST(NULL AS BIGINT)")
    start = F.struct(F.lit(float("-inf")).alias("size"), F.col("longest").alias("side"), none.alias("name"))

    def step(held: Column, b: Column) -> Column:
        wins = (b["size"] > held["size"]) & (b["side"] >= held["side"] * ratio)
        return F.when(wins, F.struct(b["size"].alias("size"), b["side"].alias("side"), b["name"].cast("long").alias("name"))).otherwise(held)

    return g.select(*keys, F.aggregate("all", start, step)["name"].alias("chosen")).where("chosen IS NOT NULL")


def suppress(candidates: DataFrame, limit: float = NMS_IOU) -> DataFrame:
    """Greedy non-maximum suppression of each (clip, slot)'s boxes, best score first (ties: by event_id).

    A box goes where it overlaps a kept one by the limit or more. A frame's boxes are few, so they are folded as an array.
    """
    one = F.struct((-F.col("score")).alias("place"), "event_id", *CORNERS, "score")
    every = candidates.groupBy("clip", "slot").agg(F.array_sort(F.collect_list(one)).alias("all"))
    box = "struct<place:double,event_id:bigint,x1:double,y1:double,x2:double,y2:double,score:double>"

    def step(kept: Column, b: Column) -> Column:
        clash = F.exists(kept, lambda k: iou([k[c] for c in CORNERS], [b[c] for c in CORNERS]) >= limit)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("all", F.expr(f"CAST(array() AS array<{box}>)"), step)
    return every.select("clip", "slot", F.explode(kept).alias("b")).select("clip", "slot", "b.event_id", *[f"b.{c}" for c in CORNERS], "b.score")

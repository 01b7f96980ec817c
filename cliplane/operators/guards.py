"""From measures to flags, runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.operators.boxes import in_frame
from cliplane.operators.masks import cut_margins, placed
from cliplane.operators.pose import DRAW, NAMES, at, drawn

#: The checks in the order of reports, those that only warn, the head's points, and the share of a second piece.
CHECKS = ("pose_jump", "pose_spike", "subject_switch", "no_driving_person", "driving_empty", "driving_fragmented", "mask_empty", "mask_leak", "mask_attached_leak", "mask_fragmented", "mask_head_out", "mask_limb_out", "mask_loss")
WARNINGS = ("pose_jump", "pose_spike", "subject_switch", "mask_leak", "mask_attached_leak", "driving_empty", "reference_fragmented", "reference_misaligned")
HEAD, TORN = (0, 14, 15, 16, 17), 0.05


def runs(flags: DataFrame, keys: tuple[str, ...] = ("clip", "check")) -> DataFrame:
    """Runs of consecutive frames of each key: first, last, length."""
    w = Window.partitionBy(*keys).orderBy("frame")
    df = flags.select(*keys, "frame").distinct().withColumn("island", F.col("frame") - F.row_number().over(w))
    return df.groupBy(*keys, "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("length")).drop("island")


def ranges_text(flags: DataFrame, keys: tuple[str, ...] = ("clip", "check")) -> DataFrame:
    """Frames of each key as text, such as 1-3, 7."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    parts = runs(flags, keys).select(*keys, F.struct("first", one.alias("text")).alias("part"), "length")
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), ", ").alias("frames"), F.sum("length").alias("count"), F.max("length").alias("longest"))


def pose_flags(measures: DataFrame, most_torso: float = 0.25) -> DataFrame:
    """clip, check, frame of pose_jump, pose_spike and subject_switch; measures: box_iou_prev, torso_jump and, if there, limb_spikes."""
    iou = F.col("box_iou_prev")
    spike = F.col("limb_spikes") if "limb_spikes" in measures.columns else F.lit(0)
    fired = {"pose_jump": (iou > 0.5) & (F.col("torso_jump") > most_torso), "pose_spike": spike > 0, "subject_switch": iou < 0.3}
    return fire(measures, fired)


def fire(measures: DataFrame, fired: dict[str, Column]) -> DataFrame:
    checks = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in fired.items()]))
    return measures.select("clip", "frame", F.explode(checks).alias("check")).select("clip", "check", "frame")


def mask_measures(frames: DataFrame, px: DataFrame, width: int, height: int, threshold: float = DRAW, every: bool = False) -> DataFrame:
    """Each frame's measures of its mask against box and pose; head points are asked on frames with a mask (every: on all). frames: clip, frame, x1..y2, score, ex1..ey2 (the envelope), body.

    mask_area and mask_to_box are shares, outside is the share of the mask off the envelope, head_out names head points in the frame
    with no mask near. A frame's pixels meet its one row, and all is summed in one pass."""
    wide, high = F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    reach = F.floor(F.greatest(F.lit(3), F.floor(0.02 * F.hypot(wide, high)).cast("int").bitwiseOR(F.lit(1))) / 2)
    on = F.filter("body", lambda p: p["c"] >= threshold)
    sure = F.aggregate(on, F.lit(0.0), lambda a, p: a + p["c"]) / F.size(on)
    seen = lambda j: drawn(j, threshold) & in_frame(at(j)["x"], at(j)["y"], width, height)
    heads = {j: F.when(seen(j), F.struct(at(j)["x"].cast("int").alias("x"), at(j)["y"].cast("int").alias("y"))) for j in HEAD}
    f = frames.select("clip", "frame", (wide * high).alias("__box"), reach.alias("__reach"), *[F.floor(c).alias(c) for c in ("ex1", "ey1", "ex2", "ey2")], *[h.alias(f"__h{j}") for j, h in heads.items()],
                      ((F.col("score") > 0) & (F.size(on) >= 8) & (sure >= 0.5)).alias("box_reliable"))
    inside = (F.col("x") >= F.col("ex1")) & (F.col("x") < F.col("ex2")) & (F.col("y") >= F.col("ey1")) & (F.col("y") < F.col("ey2"))
    near = lambda j: (F.abs(F.col("x") - F.col(f"__h{j}.x")) <= F.col("__reach")) & (F.abs(F.col("y") - F.col(f"__h{j}.y")) <= F.col("__reach"))
    met = f.join(px.select("clip", "frame", "x", "y"), ["clip", "frame"]).groupBy("clip", "frame")
    met = met.agg(F.count("*").alias("__area"), F.count(F.when(inside, 1)).alias("__inside"), *[F.max(F.when(near(j), 1)).alias(f"__m{j}") for j in HEAD])
    df = f.join(met, ["clip", "frame"], "left").withColumn("__area", F.coalesce("__area", F.lit(0)))
    out = F.array_compact(F.array(*[F.when(F.col(f"__h{j}").isNotNull() & F.col(f"__m{j}").isNull() & ((F.col("__area") > 0) | F.lit(every)), F.lit(NAMES[j])) for j in HEAD]))
    return df.select("clip", "frame", (F.col("__area") / (width * height)).alias("mask_area"), (F.col("__area") / F.col("__box")).alias("mask_to_box"), "box_reliable",
                     F.when(F.col("__area") > 0, (F.col("__area") - F.col("__inside")) / F.col("__area")).otherwise(0.0).alias("outside"), out.alias("head_out"))


def mask_flags(measures: DataFrame, fragments: DataFrame | None = None, least: float = 0.15, most_outside: float = 0.10, sides: int = 2, limbs: DataFrame | None = None, losses: DataFrame | None = None, leaks: DataFrame | None = None, most_leak: float = 0.03) -> DataFrame:
    """clip, check, frame of mask_empty, mask_leak, mask_head_out and, with fragments (clip, frame, share), limbs (clip, frame, limbs),
    losses (clip, frame, mask_loss) or leaks (clip, frame, attached_leak), mask_fragmented, mask_limb_out, mask_loss and
    mask_attached_leak. A frame without a mask has no checks but mask_empty."""
    empty = F.col("box_reliable") & ((F.col("mask_area") == 0) | (F.col("mask_to_box") < least))
    others = F.size(F.array_remove("head_out", NAMES[0]))
    fired = {"mask_empty": empty, "mask_leak": F.col("box_reliable") & ~empty & (F.col("outside") > most_outside)}
    if fragments is not None:
        torn = fragments.where(F.col("share") >= TORN).select("clip", "frame", F.lit(1).alias("torn")).distinct()
        measures = measures.join(torn, ["clip", "frame"], "left")
        fired["mask_fragmented"] = F.col("torn").isNotNull()
    fired["mask_head_out"] = (F.col("mask_area") > 0) & (F.array_contains("head_out", NAMES[0]) | (others >= sides))
    if leaks is not None:
        measures = measures.join(leaks.where(F.col("attached_leak") > most_leak).select("clip", "frame", F.lit(1).alias("__leak")).distinct(), ["clip", "frame"], "left")
        fired["mask_attached_leak"] = F.col("__leak").isNotNull()
    if limbs is not None:
        out = limbs.where(F.size("limbs") > 0).select("clip", "frame", F.lit(1).alias("__limb")).distinct()
        measures = measures.join(out, ["clip", "frame"], "left")
        fired["mask_limb_out"] = (F.col("mask_area") > 0) & F.col("__limb").isNotNull()
    if losses is not None:
        measures = measures.join(losses.where("mask_loss > 0").select("clip", "frame", F.lit(1).alias("__loss")).distinct(), ["clip", "frame"], "left")
        fired["mask_loss"] = (F.col("mask_area") > 0) & F.col("__loss").isNotNull()
    return fire(measures, fired)


def driving_flags(areas: DataFrame, fragments: DataFrame, posed: bool) -> DataFrame:
    """clip, check, frame of no_driving_person (no frame of the clip has a mask: nothing else fires), driving_empty (only without a
    pose) and driving_fragmented. areas: clip, frame, area, frames without a mask included."""
    some = F.max("area").over(Window.partitionBy("clip")) > 0
    torn = fragments.where(F.col("share") >= TORN).select("clip", "frame", F.lit(1).alias("torn")).distinct()
    df = areas.withColumn("some", some).join(torn, ["clip", "frame"], "left")
    fired = {"no_driving_person": ~F.col("some")}
    if not posed:
        fired["driving_empty"] = F.col("some") & (F.col("area") == 0)
    fired["driving_fragmented"] = F.col("some") & F.col("torn").isNotNull()
    return fire(df, fired)


def combine(pose: DataFrame, mask: DataFrame, shared: list[str]) -> DataFrame:
    """The measures of both guards frame by frame. It fails where a frame is missing on one side or a shared measure differs."""
    p, m = pose.withColumn("__p", F.lit(1)), mask.withColumnsRenamed({c: f"__{c}" for c in shared}).withColumn("__m", F.lit(1))
    df = p.join(m, ["clip", "frame"], "full")
    fails = [F.when(F.col("__p").isNull() | F.col("__m").isNull(), F.format_string("clip %s frame %d is not in both", F.col("clip").cast("string"), "frame"))]
    fails += [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.format_string("clip %s frame %d: both differ on %s", F.col("clip").cast("string"), "frame", F.lit(c))) for c in shared]
    # the check must not be pruned with a column nobody reads, so it is a filter
    fine = F.coalesce(*fails).isNull()
    ok = F.when(fine, True).otherwise(F.raise_error(F.coalesce(*fails)).cast("boolean"))
    return df.where(ok).drop("__p", "__m", *[f"__{c}" for c in shared])


def report(flags: DataFrame, frames: DataFrame, title: str, enabled: set[str], names: DataFrame | None = None) -> DataFrame:
    """clip, passed, report: a headline and one line a check in the order they first fired (ties: the order of CHECKS).

    frames: clip and n, its number of frames. Checks that only warn never fail; others fail if enabled, else they are off.
    names: clip, check, frame, place, name: what a check missed on a frame, counted by name at the line's end."""
    kind = F.when(F.col("check").isin(*WARNINGS), "warning").when(F.col("check").isin(*enabled), "fail").otherwise("off")
    order = F.coalesce(*[F.when(F.col("check") == c, k) for k, c in enumerate(CHECKS)])
    text = ranges_text(flags).join(flags.groupBy("clip", "check").agg(F.min("frame").alias("seen")), ["clip", "check"])
    missed = F.lit("")
    if names is not None:
        fired = names.join(flags, ["clip", "check", "frame"], "left_semi")
        n = fired.groupBy("clip", "check", "name").agg(F.count("*").alias("n"), F.min(F.struct("frame", "place")).alias("at"))
        parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "at", F.format_string("%s x%d", "name", "n").alias("text"))))
        lines = n.groupBy("clip", "check").agg(F.concat(F.lit(" | missed: "), F.array_join(F.transform(parts, lambda p: p["text"]), ", ")).alias("missed"))
        text, missed = text.join(lines, ["clip", "check"], "left"), F.coalesce("missed", F.lit(""))
    line = F.concat(F.format_string("- %s (%s): %d frame(s), longest run %d: %s", "check", kind, "count", "longest", "frames"), missed)
    lines = F.array_sort(F.collect_list(F.struct("seen", order.alias("order"), line.alias("line"), kind.alias("kind"))))
    by_clip = text.groupBy("clip").agg(lines.alias("lines"))
    bad = flags.where(kind == "fail").groupBy("clip").agg(F.countDistinct("check").alias("checks"), F.countDistinct("frame").alias("bad"))
    df = frames.join(by_clip, "clip", "left").join(bad, "clip", "left")
    checks = F.coalesce("checks", F.lit(0))
    head = F.format_string(f"{title}: %s - %d check(s) failed on %d/%d frames", F.when(checks > 0, "FAILED").otherwise("passed"), checks, F.coalesce("bad", F.lit(0)), "n")
    rest = F.coalesce(F.transform("lines", lambda x: x["line"]), F.expr("CAST(array() AS array<string>)"))
    return df.select("clip", (checks == 0).alias("passed"), F.array_join(F.concat(F.array(head), rest), "\n").alias("report"))


def metrics_json(measures: DataFrame, columns: list[str]) -> DataFrame:
    """clip, frame, record: the measures of a frame as JSON, nulls included."""
    one = F.to_json(F.struct("frame", *columns), {"ignoreNullFields": "false"})
    return measures.select("clip", "frame", one.alias("record"))


def reference_fit(reference: DataFrame, image: tuple[int, int], first: DataFrame, size: tuple[int, int], least: float = 0.4) -> DataFrame:
    """clip, area, cropped, iou, scale, flags: how a character on a reference image (clip, x, y) fits the first frame's mask (clip, x, y)
    once it is cut and resized to the frame. area is its share of the image, cropped the share of it that the cut takes, iou and scale
    (of heights) compare it with the mask; they are null where either is empty. An iou under least is reference_misaligned.

    Clips of either side have a row; a clip without a character has area 0."""
    pick = lambda df: df.select("clip", F.lit(0).cast("long").alias("frame"), "x", "y").distinct()
    own, other = pick(reference), pick(first)
    put = placed(own, image, size)
    cut = _cut(own, image, size).groupBy("clip").agg(F.count("*").alias("kept"))
    high = lambda df, name: df.groupBy("clip").agg(F.count("*").alias(name), (F.max("y") - F.min("y") + 1).alias(f"{name}_high"))
    common = put.join(other, ["clip", "frame", "x", "y"]).groupBy("clip").agg(F.count("*").alias("common"))
    df = own.select("clip").union(other.select("clip")).distinct()
    for part in (high(own, "own"), cut, high(put, "put"), high(other, "other"), common):
        df = df.join(part, "clip", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    iou = F.when(F.col("put").isNotNull() & F.col("other").isNotNull(), n("common") / (F.col("put") + F.col("other") - n("common")))
    return df.select("clip", (n("own") / (image[0] * image[1])).alias("area"), F.when(n("own") > 0, 1 - n("kept") / F.col("own")).otherwise(0.0).alias("cropped"), iou.alias("iou"),
                     (F.col("put_high") / F.col("other_high")).alias("scale"), F.when(iou < least, F.array(F.lit("reference_misaligned"))).otherwise(F.expr("CAST(array() AS array<string>)")).alias("flags"))


def _cut(px: DataFrame, image: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    x, y = cut_margins(image, size)
    return px.where((F.col("x") >= x) & (F.col("x") < image[0] - x) & (F.col("y") >= y) & (F.col("y") < image[1] - y))


def reference_line(record: DataFrame, enabled: set[str]) -> DataFrame:
    """clip, report: the measures of reference_fit as a line, and one line a flag."""
    value = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit("n/a"))
    val = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(value(F.col(c)))
    line = F.concat(F.lit("reference image: area "), val("area"), F.lit(", cropped "), val("cropped"), F.lit(", IoU with mask frame 0 "), val("iou"), F.lit(", scale vs mask frame 0 "), val("scale"))
    kind = lambda f: F.when(f.isin(*WARNINGS), "warning").when(f.isin(*enabled), "fail").otherwise("off")
    rest = F.transform("flags", lambda f: F.concat(F.lit("- "), f, F.lit(" ("), kind(f), F.lit(")")))
    return record.select("clip", F.array_join(F.concat(F.array(line), rest), "\n").alias("report"))

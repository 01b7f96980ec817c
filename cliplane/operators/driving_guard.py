"""The guard of a driving mask as a whole: measures and checks of its frames, of the reference and of extra references, the record
and the report.

Without a pose the driving frames get the checks that need none. With one they also get the mask checks, judged by what the latent
grid reads of the person: head points and limbs meet that reading, and a lost region is one the grid loses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.operators import driving, guards, leaks, losses, masks
from cliplane.operators.masks import FRAME
from cliplane.operators.pose import DRAW
from cliplane.session import settled

#: Checks that only a pose allows, in the order of reports; checks of a reference; those that stop a run.
POSED = ("mask_empty", "mask_leak", "mask_attached_leak", "mask_head_out", "mask_limb_out", "mask_loss")
REFERENCE = ("reference_empty", "reference_fragmented", "reference_misaligned")
FAILS = ("no_driving_person", "driving_fragmented", "reference_empty", "mask_empty", "mask_head_out", "mask_limb_out", "mask_loss")
ENABLED = frozenset((*FAILS, *guards.WARNINGS))
#: Columns of a frame's record, in its order.
ROW = ["frame", "mask_area", "fragments", "latent_kept", "mask_loss", "mask_to_box", "box_reliable", "mask_outside_box", "attached_leak", "head_out", "limbs_out", "box_iou_prev"]


@dataclass(frozen=True)
class Posed:
    """frames: as guards.mask_measures takes them, with box_iou_prev; parts: clip, frame, body, left_hand, right_hand and face in pixels."""

    frames: DataFrame
    parts: DataFrame


def _empty(kind: str) -> Column:
    return F.expr(f"CAST(array() AS array<{kind}>)")


def driving_rows(px: DataFrame, frames: DataFrame, width: int, height: int, posed: Posed | None = None, threshold: float = DRAW, slab: int = 32) -> DataFrame:
    """clip and ROW of every driving frame, settled in the shared folder, since checks, report and record all read them. px: the person's pixels; frames: clip, frame of all frames (from 0)."""
    frames = frames.select(*FRAME).distinct()
    area = masks.areas(px.select(*masks.PIXEL).distinct()).select(*FRAME, (F.col("area") / (width * height)).alias("mask_area"))
    df = frames.join(area, FRAME, "left").join(driving.latent_kept(px), FRAME, "left").withColumn("mask_area", F.coalesce("mask_area", F.lit(0.0)))
    if posed is None:
        torn = masks.fragments(px, width, height).groupBy(*FRAME).agg(F.sort_array(F.collect_list("share"), False).alias("fragments"))
        df = df.join(torn, FRAME, "left").withColumn("fragments", F.coalesce("fragments", _empty("double")))
        none = {c: F.lit(None).cast("double") for c in ("mask_loss", "mask_to_box", "mask_outside_box", "attached_leak", "box_iou_prev")}
        return settled(df.withColumns({**none, "box_reliable": F.lit(False), "head_out": _empty("string"), "limbs_out": _empty("string")}).select("clip", *ROW))
    at = F.explode("on").alias("at")
    reading = driving.readings(px, width, height).select(*FRAME, at).select(*FRAME, (F.col("at") % width).cast("long").alias("x"), F.expr(f"at div {width}").alias("y"))
    own = guards.mask_measures(posed.frames, px, width, height, threshold).select(*FRAME, "mask_to_box", "box_reliable", F.when(F.col("mask_area") > 0, F.col("outside")).alias("mask_outside_box"))
    seen = guards.mask_measures(posed.frames, reading, width, height, threshold, every=True).select(*FRAME, "head_out")
    limbs = losses.limbs_out(posed.parts, reading, width, height, threshold, frames=px).select(*FRAME, F.col("limbs").alias("limbs_out"))
    found = leaks.person_parts(leaks.pose_frames(posed.parts, width, height), px, width, height).select(*FRAME, "fragments", "attached_leak")
    n = frames.groupBy("clip").agg((F.max("frame") + 1).alias("n"))
    evidence = losses.limb_evidence(posed.parts, width, height, threshold)
    loss = losses.mask_losses(px, n, width, height, slab=slab, limbs=evidence, read=losses.latent_reader(width, height))
    for part in (own, seen, limbs, found, loss, posed.frames.select(*FRAME, "box_iou_prev")):
        df = df.join(part, FRAME, "left")
    some = F.col("mask_area") > 0
    filled = {"fragments": F.coalesce("fragments", _empty("double")), "mask_loss": F.coalesce("mask_loss", F.lit(0.0)), "limbs_out": F.coalesce("limbs_out", _empty("string"))}
    return settled(df.withColumns(filled).withColumn("head_out", F.when(some, F.col("head_out")).otherwise(_empty("string"))).select("clip", *ROW))


def driving_checks(rows: DataFrame, posed: bool, least: float = 0.15, most_outside: float = 0.10, sides: int = 2, most_leak: float = 0.03) -> DataFrame:
    """clip, check, frame. A clip without the person on any frame has no_driving_person on all frames and nothing else; without a pose
    an empty frame is driving_empty, with one mask_empty says so."""
    torn = rows.select(*FRAME, F.explode("fragments").alias("share"))
    own = guards.driving_flags(rows.select(*FRAME, F.col("mask_area").alias("area")), torn, posed)
    if not posed:
        return own
    nobody = own.where(F.col("check") == "no_driving_person").select("clip").distinct()
    measures = rows.withColumnRenamed("mask_outside_box", "outside").join(nobody, "clip", "left_anti")
    limbs, loss, leak = rows.select(*FRAME, F.col("limbs_out").alias("limbs")), rows.select(*FRAME, "mask_loss"), rows.select(*FRAME, "attached_leak")
    return own.unionByName(guards.mask_flags(measures, None, least, most_outside, sides, limbs, loss, leak, most_leak))


def reference_record(px: DataFrame, clips: DataFrame, image: tuple[int, int], first: DataFrame, size: tuple[int, int], least: float = 0.4) -> DataFrame:
    """clip, mode, area, fragments, cropped, iou_first_frame, scale_first_frame, flags of each clip's reference. px: clip, x, y of the
    character; clips: clip, mode; first: clip, x, y of the person on the first driving frame."""
    own = px.select("clip", F.lit(0).cast("long").alias("frame"), "x", "y").distinct()
    torn = masks.fragments(own, *image).groupBy("clip").agg(F.sort_array(F.collect_list("share"), False).alias("fragments"))
    fit = guards.reference_fit(px, image, first, size, least).drop("flags")
    df = clips.select("clip", "mode").join(fit, "clip", "left").join(torn, "clip", "left")
    area, pieces = F.coalesce("area", F.lit(0.0)), F.coalesce("fragments", _empty("double"))
    flags = driving.character_flags(area, F.exists(pieces, lambda s: s >= driving.FRAGMENT))
    apart = F.when((F.col("mode") == "replacement") & (F.col("iou") < least), F.array(F.lit("reference_misaligned"))).otherwise(_empty("string"))
    cropped = F.coalesce("cropped", F.lit(0.0)).alias("cropped")
    return df.select("clip", "mode", area.alias("area"), pieces.alias("fragments"), cropped, F.col("iou").alias("iou_first_frame"), F.col("scale").alias("scale_first_frame"), F.concat(flags, apart).alias("flags"))


def extra_records(px: DataFrame, references: DataFrame, image: tuple[int, int]) -> DataFrame:
    """clip, index, area, fragments, flags of each extra reference. px: clip, frame (the index), x, y; references: clip, frame of all."""
    torn = masks.fragments(px, *image)
    found = driving.extra_references(px, references, torn, *image)
    shares = torn.groupBy(*FRAME).agg(F.sort_array(F.collect_list("share"), False).alias("fragments")).withColumnRenamed("frame", "index")
    return found.join(shares, ["clip", "index"], "left").select("clip", "index", "area", F.coalesce("fragments", _empty("double")).alias("fragments"), "flags")


def _value(c: str) -> Column:
    return F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.3f", F.col(c)))


def _shares(c: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda s: s.cast("string")), ", "), F.lit("]"))


def _flag_lines(flags: Column, enabled: frozenset, name: Column, says: dict[str, Column]) -> Column:
    """One line for each flag of a reference."""
    kind = lambda f: F.when(f.isin(*guards.WARNINGS), "warning").when(f.isin(*enabled) if enabled else F.lit(False), "fail").otherwise("off")
    text = lambda f: F.coalesce(*[F.when(f == k, v) for k, v in says.items()])
    return F.transform(flags, lambda f: F.concat(F.lit("- "), f, F.lit(" ("), kind(f), F.lit("): reference "), name, F.lit(": "), text(f)))


def report(rows: DataFrame, flags: DataFrame, references: DataFrame, extras: DataFrame | None = None, enabled: frozenset = ENABLED, posed: bool = False) -> DataFrame:
    """clip, passed, report: the driving frames' checks as the other guards report them, then the reference and each extra one."""
    names = None
    if posed:
        per = [rows.select("clip", F.lit(check).alias("check"), "frame", F.posexplode(c).alias("place", "name")) for check, c in (("mask_head_out", "head_out"), ("mask_limb_out", "limbs_out"))]
        names = per[0].unionByName(per[1])
    counts = rows.groupBy("clip").agg(F.count("*").alias("n"))
    text = guards.report(flags, counts, "driving mask", set(enabled), names)
    largest = F.format_string("a detached region of %.3f of the character's largest one", F.coalesce(F.array_max("fragments"), F.lit(0.0)))
    empty = {"reference_empty": F.lit("no pixel of the mask is the character's (blue)"), "reference_fragmented": largest}
    apart = F.concat(F.lit("IoU "), _value("iou_first_frame"), F.lit(" with the person on the first driving frame; replacement expects both posed and placed alike"))
    fails = lambda c: F.exists(c, lambda f: f.isin(*[k for k in enabled if k not in guards.WARNINGS]) if enabled else F.lit(False))
    own = references.select(
        "clip", F.coalesce("mode", F.lit("unclear")).alias("mode"), fails("flags").alias("bad"),
        F.concat(F.lit("reference 0 mask (primary): area "), _value("area"), F.lit(", fragments "), _shares("fragments"), F.lit(", cropped "), _value("cropped"),
                 F.lit(", IoU with driving frame 0 "), _value("iou_first_frame"), F.lit(", scale vs driving frame 0 "), _value("scale_first_frame")).alias("line"),
        _flag_lines(F.col("flags"), enabled, F.lit("0"), {**empty, "reference_misaligned": apart}).alias("lines"),
    )
    df = own.join(text, "clip", "left")
    more, worse = _empty("string"), F.lit(False)
    if extras is not None:
        index = F.col("index").cast("string")
        line = F.concat(F.lit("reference "), index, F.lit(" mask (extra, on black): area "), _value("area"), F.lit(", fragments "), _shares("fragments"))
        each = extras.select("clip", "index", fails("flags").alias("bad2"), F.concat(F.array(line), _flag_lines(F.col("flags"), enabled, index, empty)).alias("text"))
        each = each.groupBy("clip").agg(F.max("bad2").alias("bad2"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"])).alias("more"))
        df, more, worse = df.join(each, "clip", "left"), F.coalesce("more", more), F.coalesce("bad2", worse)
    passed = F.coalesce("passed", F.lit(True)) & ~F.col("bad") & ~worse
    head = F.concat(F.lit("Driving guard: "), F.when(passed, "passed").otherwise("FAILED"), F.lit(" - "), F.col("mode"), F.lit(" mode (the primary reference mask's border)"))
    body = F.coalesce("report", F.lit("driving mask: passed - 0 check(s) failed on 0/0 frames"))
    missing = [] if posed else [F.lit("- without pose_data, not checked: " + ", ".join(POSED))]
    lines = F.concat(F.array(head, body, *missing, F.col("line")), F.col("lines"), more)
    return df.select("clip", passed.alias("passed"), F.array_join(lines, "\n").alias("report"))


def record(rows: DataFrame, flags: DataFrame, references: DataFrame, thresholds: dict[str, float | None], extras: DataFrame | None = None, enabled: frozenset = ENABLED) -> DataFrame:
    """clip, record: everything measured as JSON: guard, thresholds, enabled, flags (check to frames, in the order they first fired),
    reference, extra_references where there are any, frames."""
    order = {c: k for k, c in enumerate(guards.CHECKS)}
    fired = flags.groupBy("clip", "check").agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    place = F.coalesce(*[F.when(F.col("check") == c, k) for c, k in order.items()])
    fired = fired.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct(F.col("frames")[0].alias("seen"), place.alias("place"), "check", "frames"))).alias("f"))
    fired = fired.select("clip", F.map_from_entries(F.transform("f", lambda x: F.struct(x["check"], x["frames"]))).alias("flags"))
    frames = rows.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct(*ROW))).alias("frames"))
    primary = references.select("clip", F.struct(*[c for c in references.columns if c != "clip"]).alias("reference"))
    df = primary.join(fired, "clip", "left").join(frames, "clip", "left")
    limits = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in thresholds.items()])
    fields = [F.lit("driving").alias("guard"), limits.alias("thresholds"), F.array(*[F.lit(c) for c in sorted(enabled)]).alias("enabled"), "flags", "reference"]
    if extras is not None:
        own = extras.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("index", "area", "fragments", "flags"))).alias("extra_references"))
        df, fields = df.join(own, "clip", "left"), [*fields, "extra_references"]
    return df.select("clip", F.to_json(F.struct(*fields, "frames"), {"ignoreNullFields": "false"}).alias("record"))


def check(text: DataFrame) -> DataFrame:
    """The reports (clip, passed, report) of a run that stops: it fails with the report of a clip that didn't pass."""
    fine = F.when(F.col("passed"), True).otherwise(F.raise_error(F.col("report")).cast("boolean"))
    return text.where(fine)

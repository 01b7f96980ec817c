"""The driving guard as a whole: a clip with and without a pose, references, the record, and the stop."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplane.operators import driving_guard as dg
from cliplane.operators import losses
from cliplane.operators.boxes import envelope

W, H, N = 96, 128, 20
PX = "clip long, frame long, x long, y long"


def px_of(spark, masks):
    rows = [(0, f, int(x), int(y)) for f, m in enumerate(masks) for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, PX)


def person(hole=False):
    m = np.zeros((H, W), bool)
    m[16:112, 16:80] = True
    if hole:
        m[48:80, 48:80] = False
    return m


def frames_of(spark, n=N):
    return spark.createDataFrame([(0, f) for f in range(n)], "clip long, frame long")


def reference(spark, mask, first, mode="replacement"):
    clips = spark.createDataFrame([(0, mode)], "clip long, mode string")
    flat = lambda m: spark.createDataFrame([(0, int(x), int(y)) for y, x in np.argwhere(m)], "clip long, x long, y long")
    return dg.reference_record(flat(mask), clips, (W, H), flat(first), (W, H))


def posed(spark, hidden=()):
    """A body in the middle whose right arm crosses the hole; on hidden frames the wrist isn't drawn."""
    place = {0: (48, 24), 1: (48, 36), 2: (36, 36), 5: (60, 36), 3: (60, 50), 4: (70, 60), 8: (40, 70), 11: (56, 70), 14: (46, 22), 15: (50, 22)}
    rows, boxes = [], []
    for f in range(N):
        body = [(float(place[j][0]), float(place[j][1]), 0.9) if j in place and not (f in hidden and j == 4) else (70.0, 60.0, 0.1) if j == 4 else (-9.0, -9.0, 0.1) for j in range(20)]
        none = [(-9.0, -9.0, 0.1)]
        rows.append((0, f, body, none * 21, none * 21, none * 69))
        boxes.append((0, f, 14.0, 14.0, 82.0, 114.0, 0.9, 1))
    point = "array<struct<x:double,y:double,c:double>>"
    parts = spark.createDataFrame(rows, f"clip long, frame long, body {point}, left_hand {point}, right_hand {point}, face {point}")
    b = spark.createDataFrame(boxes, "clip long, frame long, x1 double, y1 double, x2 double, y2 double, score double, persons int")
    frames = envelope(b, W, H).join(parts.select("clip", "frame", "body"), ["clip", "frame"]).withColumn("box_iou_prev", F.lit(None).cast("double"))
    return dg.Posed(frames, parts)


def checks(rows, with_pose):
    found = {}
    for r in dg.driving_checks(rows, with_pose).collect():
        found.setdefault(r.check, []).append(r.frame)
    return {k: sorted(v) for k, v in found.items()}


def test_without_a_pose(spark):
    torn, thin = person(), np.zeros((H, W), bool)
    torn[1:13, 30:60] = True  # away from every side, more than a twentieth
    thin[16:112, 40] = True
    masks = [person()] * 4 + [torn, np.zeros((H, W), bool), thin] + [person()] * 3
    rows = dg.driving_rows(px_of(spark, masks), frames_of(spark, 10), W, H)
    assert checks(rows, False) == {"driving_fragmented": [4], "driving_empty": [5]}
    kept = {r.frame: r.latent_kept for r in rows.collect()}
    assert kept[0] == 1.0 and kept[5] is None and kept[6] == 0.0
    ref = reference(spark, person(), person())
    text = dg.report(rows, dg.driving_checks(rows, False), ref).collect()[0]
    assert not text.passed and text.report.startswith("Driving guard: FAILED - replacement mode") and "not checked: mask_empty, mask_leak" in text.report
    off = dg.report(rows, dg.driving_checks(rows, False), ref, enabled=frozenset()).collect()[0]
    assert off.passed and "- driving_fragmented (off)" in off.report and "- driving_empty (warning)" in off.report
    with pytest.raises(Exception, match="FAILED"):
        dg.check(dg.report(rows, dg.driving_checks(rows, False), ref)).collect()


def test_nobody_on_any_frame(spark):
    rows = dg.driving_rows(px_of(spark, []), frames_of(spark, 3), W, H)
    assert checks(rows, False) == {"no_driving_person": [0, 1, 2]}
    posed_rows = rows.withColumn("box_reliable", F.lit(True))
    assert checks(posed_rows, True) == {"no_driving_person": [0, 1, 2]}


def test_references(spark):
    ref = lambda m, first=None, mode="replacement": reference(spark, m, person() if first is None else first, mode).collect()[0]
    assert ref(person()).flags == [] and ref(person()).iou_first_frame == 1.0
    assert ref(np.zeros((H, W), bool)).flags == ["reference_empty"]
    aside = np.zeros((H, W), bool)
    aside[16:112, 60:96] = True
    assert ref(aside).flags == ["reference_misaligned"] and ref(aside, mode="animation").flags == []
    half = person() & (np.arange(H)[:, None] < 64)
    assert ref(half).scale_first_frame == 0.5
    two = person() & (np.arange(H)[:, None] < 60) | person() & (np.arange(H)[:, None] > 64)
    assert "reference_fragmented" in ref(two).flags
    extra = px_of(spark, [np.zeros((H, W), bool), person(), two])
    found = dg.extra_records(extra, frames_of(spark, 4).where("frame > 0"), (W, H)).orderBy("index").collect()
    assert [(r["index"], r.flags) for r in found] == [(1, []), (2, ["reference_fragmented"]), (3, ["reference_empty"])]


def test_with_a_pose_a_region_the_grid_loses_is_found(spark):
    """One clip drops a region for two frames; two drop it to the end, with the limb drawn on and with the wrist lost."""
    closed, ends = [person(hole=f in (8, 9)) for f in range(N)], [person(hole=f >= 14) for f in range(N)]
    px, frames, clips = px_of(spark, closed), frames_of(spark), posed(spark)
    lost = posed(spark, range(14, N))
    for clip, own in ((1, clips), (2, lost)):
        at = F.lit(clip).cast("long")
        px, frames = px.unionByName(px_of(spark, ends).withColumn("clip", at)), frames.unionByName(frames_of(spark).withColumn("clip", at))
        base = posed(spark) if clip == 1 else own
        clips = dg.Posed(clips.frames.unionByName(base.frames.withColumn("clip", at)), clips.parts.unionByName(base.parts.withColumn("clip", at)))
    rows = dg.driving_rows(px, frames, W, H, clips, slab=8)
    found = {}
    for r in dg.driving_checks(rows, True).where(F.col("check") == "mask_loss").collect():
        found.setdefault(r.clip, set()).add(r.frame)
    assert found == {0: {8, 9}, 1: set(range(14, N)), 2: set(range(14, N))}
    plain = losses.latent_reader(W, H)(np.array(closed))[0]
    gone = plain[7] & plain[10] & ~plain[8] & ~plain[9] & ~closed[8]
    loss = {r.frame: r.mask_loss for r in rows.where("clip = 0").collect()}
    assert round(loss[8], 6) == round(gone.sum() / closed[7].sum(), 6) and loss[0] == 0.0
    own = rows.where("clip = 0").withColumn("clip", F.lit(0).cast("long"))
    text = dg.report(own, dg.driving_checks(own, True), reference(spark, person(), person()), posed=True).collect()[0]
    assert not text.passed and "- mask_loss (fail): 2 frame(s), longest run 2: 8-9" in text.report and "not checked" not in text.report


def test_the_record(spark):
    masks = [person()] * 2 + [np.zeros((H, W), bool)]
    rows = dg.driving_rows(px_of(spark, masks), frames_of(spark, 3), W, H)
    ref = reference(spark, person(), person())
    got = json.loads(dg.record(rows, dg.driving_checks(rows, False), ref, {"min_reference_iou": 0.4, "draw_threshold": None}).collect()[0].record)
    assert list(got) == ["guard", "thresholds", "enabled", "flags", "reference", "frames"]
    assert got["thresholds"] == {"min_reference_iou": 0.4, "draw_threshold": None} and got["enabled"] == sorted(dg.ENABLED)
    assert got["flags"] == {"driving_empty": [2]} and list(got["frames"][0]) == dg.ROW and len(got["frames"]) == 3
    assert list(got["reference"]) == ["mode", "area", "fragments", "cropped", "iou_first_frame", "scale_first_frame", "flags"]

"""Guards, draw rules and selections against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplane.operators import boxes, draw, guards, masks, sequence
from cliplane.plans import catalog


def test_person_is_chosen_in_order_of_score(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), i, 0.0, 0.0, float(w), float(h), float(s)) for g in range(30) for i, (w, h, s) in enumerate(zip(rng.integers(1, 200, 6), rng.integers(1, 200, 6), rng.random(6), strict=True))]
    df = spark.createDataFrame(rows, "g int, id int, x1 double, y1 double, x2 double, y2 double, score double")
    want = {}
    for g in range(30):
        found = sorted((r for r in rows if r[0] == g and r[6] > 0.05), key=lambda r: -r[6])
        side, size, best = max(max(r[4], r[5]) for r in found), -1.0, None
        for r in found:
            if r[4] * r[5] > size and max(r[4], r[5]) >= side * 0.4:
                side, size, best = max(r[4], r[5]), r[4] * r[5], r[1]
        if best is not None:
            want[g] = best
    assert {r["g"]: r["chosen"] for r in boxes.choose_person(df, ["g"], "id").collect()} == want


@pytest.mark.parametrize("keep", [1, 2, 4])
def test_closest_conditioning(spark, keep):
    marks = [3, 4, 10, 11, 12, 40]
    frames = spark.createDataFrame([(0, f) for f in range(50)] + [(1, 0)], "clip long, frame long")
    got = {}
    for r in sequence.closest_conditioning(frames, spark.createDataFrame([(0, m) for m in marks], "clip long, frame long"), keep).collect():
        got.setdefault((r["clip"], r["frame"]), set()).add(r["t"])
    for f in range(50):
        near = {max((m for m in marks if m < f), default=None), min((m for m in marks if m >= f), default=None)} - {None}
        order = sorted(marks, key=lambda m: (m not in near, abs(m - f), m))
        assert got[0, f] == set(order[:keep])
    assert (1, 0) not in got


def test_loaded_frames_range(spark):
    kept = spark.createDataFrame([(1, i, 2 * i) for i in range(20)], "video_id long, out long, frame long")
    assert [r["frame"] for r in sequence.loaded_frames(kept, 3, 7, 4).orderBy("out").collect()] == [4, 6, 8, 10, 12]
    with pytest.raises(Exception, match="frames 19 to 25"):
        sequence.loaded_frames(kept, 19, 7, 4).collect()


def test_loaded_frames_join_nothing(spark):
    """Frames that are counted and frames that tell their number: the same, each read once, with no join that could broadcast them."""
    rows = [(video, i, 2 * i) for video, n in ((1, 20), (2, 11), (3, 14)) for i in range(n)]
    kept = spark.createDataFrame(rows, "video_id long, out long, frame long")
    told = kept.withColumn("n", F.when(F.col("video_id") == 1, 20).when(F.col("video_id") == 2, 11).otherwise(14).cast("long"))
    got = [sorted(map(tuple, sequence.loaded_frames(k, 3, None, 4).collect())) for k in (kept, told)]
    assert got[0] == got[1] == [(video, k, 2 * k + 4) for video, n in ((1, 17), (2, 9), (3, 9)) for k in range(n)]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (sequence.loaded_frames(kept, 3, None, 4), catalog.QUERIES["loaded_frames"](spark, "/root/testdata/sf0.001"))]
    assert not any("Join" in p for p in plans) and "Window" not in plans[1]


def test_clean_fills_small_holes_and_drops_islands(spark):
    mask = np.zeros((20, 20), bool)
    mask[2:14, 2:14] = True
    mask[5, 5] = False  # a hole
    mask[8:12, 8:12] = False  # too large to fill
    mask[18, 18] = mask[19, 19] = True  # islands
    df = spark.createDataFrame([(0, 0, int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)], "clip long, frame long, x long, y long")
    want = mask.copy()
    want[5, 5], want[18, 18], want[19, 19] = True, False, False
    got = {(r["x"], r["y"]) for r in masks.clean(df, 20, 20, 0.01, 0.05).collect()}
    assert got == {(int(x), int(y)) for y, x in zip(*np.nonzero(want), strict=True)}


def test_fragments_leave_parts_cut_by_the_edge(spark):
    px = [(0, 0, x, y) for x in range(5) for y in range(4, 10)] + [(0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 8, 5), (0, 0, 8, 6), (0, 0, 8, 7)]
    df = spark.createDataFrame(px, "clip long, frame long, x long, y long")
    assert [tuple(r) for r in masks.fragments(df, 10, 10).collect()] == [(0, 0, 0.1)]


def test_driving_flags(spark):
    areas = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 9)], "clip long, frame long, area long")
    torn = spark.createDataFrame([(1, 1, 0.06), (1, 1, 0.02)], "clip long, frame long, share double")
    got = sorted(tuple(r) for r in guards.driving_flags(areas, torn, posed=False).collect())
    assert got == [(0, "no_driving_person", 0), (0, "no_driving_person", 1), (1, "driving_empty", 0), (1, "driving_fragmented", 1)]
    assert guards.driving_flags(areas, torn, posed=True).where("check = 'driving_empty'").count() == 0


def test_report_lines(spark):
    flags = spark.createDataFrame([(0, "mask_leak", 4), (0, "mask_head_out", 4), (0, "mask_head_out", 5), (0, "mask_loss", 2)], "clip long, check string, frame long")
    names = spark.createDataFrame([(0, "mask_head_out", 4, 0, "r_eye"), (0, "mask_head_out", 4, 1, "nose"), (0, "mask_head_out", 5, 0, "nose")], "clip long, check string, frame long, place int, name string")
    n = spark.createDataFrame([(0, 9), (1, 3)], "clip long, n long")
    got = {r["clip"]: (r["passed"], r["report"]) for r in guards.report(flags, n, "Mask guard", {"mask_head_out"}, names).collect()}
    assert got[1] == (True, "Mask guard: passed - 0 check(s) failed on 0/3 frames")
    assert got[0] == (False, "\n".join([
        "Mask guard: FAILED - 1 check(s) failed on 2/9 frames", "- mask_loss (off): 1 frame(s), longest run 1: 2", "- mask_leak (warning): 1 frame(s), longest run 1: 4",
        "- mask_head_out (fail): 2 frame(s), longest run 2: 4-5 | missed: nose x2, r_eye x1"]))


def test_combine_refuses_what_differs(spark):
    a = spark.createDataFrame([(0, 0, 0.5), (0, 1, None)], "clip long, frame long, box_iou_prev double")
    assert guards.combine(a, a.withColumnsRenamed({}), ["box_iou_prev"]).count() == 2
    with pytest.raises(Exception, match="differ on box_iou_prev"):
        guards.combine(a, spark.createDataFrame([(0, 0, 0.4), (0, 1, None)], a.schema), ["box_iou_prev"]).collect()
    with pytest.raises(Exception, match="not in both"):
        guards.combine(a, a.where("frame = 0"), ["box_iou_prev"]).collect()


def test_hands_without_drawn_points_do_not_coincide(spark):
    hand = "array(named_struct('x', {0}D, 'y', 0D, 'c', {1}D), named_struct('x', {0}D + 9, 'y', 0D, 'c', {1}D), named_struct('x', {0}D + 18, 'y', 9D, 'c', {1}D))"
    sql = " UNION ALL ".join(f"SELECT {k} AS k, {hand.format(0, c)} AS left_hand, {hand.format(m, c)} AS right_hand" for k, m, c in [(0, 1, 0.9), (1, 30, 0.9), (2, 1, 0.1)])
    df = spark.sql(sql).select("k", draw.hands_coincide().alias("same"))
    assert {r["k"]: r["same"] for r in df.collect()} == {0: True, 1: False, 2: False}


def test_whole_body_places():
    places = draw.whole_from_70()
    assert len(places) == 133 and places[23:91] == [None] * 68
    assert [places[k] for k in (9, 10, 11, 22, 91, 92, 95, 111, 112, 113, 132)] == [62, 41, 9, 20, 62, 45, 42, 58, 41, 24, 37]


def test_suppression_is_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(0, int(s), i, float(x), float(y), float(x + 40), float(y + 40), float(p)) for i, (s, x, y, p) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 60, 60), rng.integers(0, 60, 60), rng.random(60), strict=True))]
    df = spark.createDataFrame(rows, "clip long, slot int, event_id int, x1 double, y1 double, x2 double, y2 double, score double")

    def overlap(a, b):
        wide, high = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        inter = max(0, wide) * max(0, high)
        return inter / (3200 - inter)

    kept = []
    for r in sorted(rows, key=lambda r: -r[7]):
        if all(k[1] != r[1] or overlap(k, r) < 0.1 for k in kept):
            kept.append(r)
    assert {r["event_id"] for r in boxes.suppress(df).collect()} == {r[2] for r in kept}


def test_supplied_boxes(spark):
    ask = lambda text, n=2: spark.createDataFrame([(7, text, n)], "clip long, text string, n long")
    get = lambda *a: [(r.frame, r.x1, r.y1, r.x2, r.y2, r.score) for r in boxes.supplied(ask(*a)).orderBy("frame").collect()]
    same = [(0, 1.0, 2.0, 3.0, 4.0, 1.0), (1, 1.0, 2.0, 3.0, 4.0, 1.0)]
    assert get("[1, 2, 3, 4]") == get("[1, 2, 3, 4, 0.5]") == get(' {"startX": 3, "startY": 4, "endX": 1, "endY": 2}') == get("[[1, 2, 3, 4]]") == same
    assert get("[[1, 2, 3, 4], [0, 0, 9, 9]]") == [same[0], (1, 0.0, 0.0, 9.0, 9.0, 1.0)]
    assert get('[{"startX": 1, "startY": 2, "endX": 3, "endY": 4}, {"startX": 0, "startY": 0, "endX": 9, "endY": 9}]')[1][4] == 9.0
    for text, told in (("[1, 2, 3]", "no box"), ("nonsense", "no box"), ("[]", "no box"), ("[[1, 2, 3, 4], [1, 2]]", "no box"), ("[3, 2, 1, 4]", "ends before"), ("[[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]]", "3 boxes for 2")):
        with pytest.raises(Exception, match=told):
            get(text)

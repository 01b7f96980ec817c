"""Repair rules of tracks against plain loops over small masks, and the driving masks' readings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplane.operators import depths, driving, repairs
from cliplane.operators.masks import regions

PX = "clip long, frame long, x long, y long"


def px_of(spark, masks):
    return spark.createDataFrame([(0, f, int(x), int(y)) for f, m in enumerate(masks) for y, x in zip(*np.nonzero(m))], PX)


def largest(mask):
    label, n = regions(mask, False)
    sizes = [(label == k).sum() for k in range(1, n + 1)]
    return label == 1 + sizes.index(max(sizes)) if n else mask


def body(*parts):
    m = np.zeros((12, 16), bool)
    m[2:10, 2:7] = True
    for y, x, h, w in parts:
        m[y : y + h, x : x + w] = True
    return m


ARM, LEG = (3, 7, 3, 6), (10, 3, 2, 3)


def test_gained_pieces(spark):
    births = spark.createDataFrame([(0, 1)], "clip long, birth long")

    def found(masks, birth=1):
        rows = repairs.gained(px_of(spark, masks), births.select("clip", F.lit(birth).cast("long").alias("birth")), spark.createDataFrame([(0, len(masks))], "clip long, n long"), 16, 12).collect()
        return [(r.frame, round(r.share, 6)) for r in rows]

    arm = lambda f: body(ARM) if f >= 4 else body()
    assert found([arm(f) for f in range(14)]) == [(4, round(18 / 58, 6))]
    assert found([arm(f) for f in range(9)]) == []  # too few frames follow
    assert found([body(ARM) if f in (4, 5, 6) else body() for f in range(14)]) == []  # it doesn't last
    assert found([arm(f) for f in range(14)], birth=-1) == []
    assert found([body() if f < 20 else body(ARM) for f in range(30)]) == []  # too long after the birth
    two = [body(*([ARM] if f >= 4 else []), *([(10, 2, 2, 5)] if f >= 8 else [])) for f in range(20)]
    assert found(two) == [(4, round(18 / 58, 6))]  # ten of 68 pixels are too few
    small = [body(LEG) if f >= 4 else body() for f in range(14)]
    assert found(small) == []


def test_parts_lost_for_good(spark):
    births = spark.createDataFrame([(0, 0)], "clip long, birth long")

    def found(masks):
        return [(r.frame, r.last, round(r.share, 6)) for r in repairs.lost_for_good(px_of(spark, masks), births, 16, 12).collect()]

    gone = [body(ARM) if f < 5 else body() for f in range(10)]
    assert found(gone) == [(5, 9, round(18 / 58, 6))]
    assert found([*gone, body(ARM)]) == []  # its area comes back
    empty = np.zeros((12, 16), bool)
    assert found([*gone, empty, body(ARM)]) == [(5, 9, round(18 / 58, 6))]  # an empty frame ends the stretch
    assert found([body(ARM)] * 4) == []


@pytest.mark.parametrize("seed", range(12))
def test_points_inside(seed):
    rng = np.random.default_rng(seed)
    mask = largest(rng.random((9, 12)) < 0.7)
    if not mask.any():
        return
    wide = np.pad(mask, 1)
    place = np.argwhere(~wide)
    depth = np.array([[np.hypot(*(place - (y + 1, x + 1)).T).min() if mask[y, x] else 0 for x in range(12)] for y in range(9)])
    half, free, want = depth.max() / 2, depth >= depth.max() / 2, []
    free &= mask
    while len(want) < 4 and free.any():
        y, x = np.unravel_index(int(np.argmax(np.where(free, depth, -1))), depth.shape)
        want.append((int(x), int(y)))
        free &= (np.arange(9)[:, None] - y) ** 2 + (np.arange(12)[None] - x) ** 2 > half**2
    assert depths.inner_points(mask, 4) == want


def test_region_frames_and_words(spark):
    found = spark.createDataFrame([(0, 1, 4, 2, [3, 6], [(1.5, 2.5)]), (0, 2, 5, 1, [4, 6], [(7.5, 8.5)])], "clip long, number int, start long, length long, anchors array<long>, points array<struct<x:double,y:double>>")
    births, masked = spark.createDataFrame([(0, 5)], "clip long, birth long"), spark.createDataFrame([(0, f) for f in range(9)], "clip long, frame long")
    rows = repairs.region_frames(found, births, masked).withColumn("words", repairs.held_words(F.col("holding"))).collect()
    assert [(r.frame, [tuple(p) for p in r.points], r.holding) for r in rows] == [(5, [(1.5, 2.5), (7.5, 8.5)], [3, 4, 6])]
    assert rows[0].words == "in a region the mask dropped (held on frames 3, 4 and 6)"


def test_first_influenced_by_a_refined_frame(spark):
    frames = spark.createDataFrame([(0, f) for f in range(40)], "clip long, frame long")
    cond = spark.createDataFrame([(0, f) for f in (0, 10, 20, 30)], "clip long, frame long")
    refined = spark.createDataFrame([(0, 20)], "clip long, frame long")
    first = lambda *a, **k: [r.frame for r in repairs.first_influenced(frames, cond, cond, *a, **k).collect()]
    assert first(refined, 2) == [11]  # 20 is the closest at or after it
    assert first(refined, 2, selection=True) == [11]
    assert first(refined.where("false"), 2) == []


def test_driving_masks(spark):
    assert driving.cell_edges(2, 24) == [0, 12, 24] and driving.cell_edges(3, 10) == [0, 4, 7, 10]
    px = spark.createDataFrame([(0, 0, x, y) for x in range(1, 5) for y in range(4)], PX)
    assert driving.latent_kept(px).collect()[0].latent_kept == 0.5
    one = spark.createDataFrame([(0, 0)], "clip long, frame long")
    full = driving.coloured(px, one, 6, 4, F.lit("replacement"), reference=True).collect()
    assert sum(tuple(r.rgb) == (0, 0, 1) for r in full) == 16 and sum(tuple(r.rgb) == (0, 0, 0) for r in full) == 8
    with pytest.raises(Exception, match="marks no pixel"):
        driving.coloured(px.where("false"), one, 6, 4, F.lit("replacement"), reference=True).collect()
    cut = driving.extra_mask(px, spark.createDataFrame([(0, 0, 0, 0, 3, 2)], "clip long, frame long, x0 long, y0 long, x1 long, y1 long"))
    assert cut.count() == 4
    for bad in ((True, None, (8, 8)), (True, 2, (8, 8)), (True, 1, (8, 8), (9, 8))):
        with pytest.raises(ValueError):
            driving.check_face_crop(*bad)
    driving.check_face_crop(False, None, (8, 8))
    with pytest.raises(ValueError):
        driving.check_black_background(True, True)

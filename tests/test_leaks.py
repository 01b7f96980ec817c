"""Scripted cases of the person's part of a mask."""

import numpy as np
import pyarrow as pa

from cliplane.operators import leaks

PX = "clip long, frame long, x long, y long"
FRAMES = "clip long, frame long, seen array<long>, lines array<array<long>>, scale double"
BODY = np.zeros((60, 80), bool)
BODY[10:50, 20:40] = True


def parts(spark, masks, seen=None, lines=None):
    px = spark.createDataFrame([(0, f, int(x), int(y)) for f, m in enumerate(masks) for y, x in zip(*np.nonzero(m))], PX)
    rows = [(0, f, None if seen is None else seen.get(f, []), lines, None if seen is None else 20.0) for f in range(len(masks))]
    return {r.frame: (list(r.fragments), r.attached_leak) for r in leaks.person_parts(spark.createDataFrame(rows, FRAMES), px, 80, 60).collect()}


def with_box(y0, y1, x0, x1):
    m = BODY.copy()
    m[y0:y1, x0:x1] = True
    return m


def test_squares():
    rng = np.random.default_rng(1)
    for k in (1, 3, 5):
        m = rng.random((9, 13)) < 0.1
        want = np.zeros_like(m)
        for y, x in np.argwhere(m):
            want[max(0, y - k // 2) : y + k // 2 + 1, max(0, x - k // 2) : x + k // 2 + 1] = True
        assert (leaks.square(m, k) == want).all()


def test_fragments_and_whose_they_are(spark):
    torn = with_box(10, 20, 50, 60)
    assert parts(spark, [BODY, torn, BODY], {})[1][0] == [0.125]
    assert parts(spark, [BODY, torn, BODY], {1: [15 * 80 + 55]})[1][0] == []  # a keypoint is in it
    assert parts(spark, [BODY, torn, BODY])[1] == ([0.125], None)  # no pose, off the sides
    cut = with_box(50, 60, 25, 30)
    cut[55:60, 60:70] = True
    assert parts(spark, [cut])[0] == ([], None)  # both run off the bottom


def test_specks_that_frames_beside_hold(spark):
    speck, joined = with_box(10, 14, 42, 48), with_box(10, 14, 40, 48)
    assert parts(spark, [BODY, joined, speck, joined, BODY], {})[2][0] == []
    assert parts(spark, [BODY, joined, speck, BODY, BODY], {})[2][0] == [0.03]


def test_leaks_that_join_for_a_frame(spark):
    grown = with_box(20, 40, 40, 60)
    found = parts(spark, [BODY, BODY, grown, BODY, BODY], {}, None)
    assert found[2][1] == 20 * 19 / 800 and found[0][1] == 0.0 and found[1][1] == 0.0  # the column beside is in reach of the others
    arm = [[40, 30, 60, 30]]  # the skeleton reaches max(3, 5) pixels
    assert parts(spark, [BODY, BODY, grown, BODY, BODY], {}, arm)[2][1] == 9 * 19 / 800
    assert parts(spark, [BODY, BODY, grown, grown, BODY], {}, None)[2][1] == 0.0
    assert parts(spark, [grown], {}, None)[0][1] == 0.0
    assert parts(spark, [BODY, np.zeros_like(BODY), BODY], {}, None)[1] == ([], 0.0)


def test_few_rows_are_objects_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([[k] * 3 for k in range(1000)])], names=["frame", "on"])
    parts = list(leaks._some([batch, batch.slice(0, 0)]))
    assert max(map(len, parts)) == leaks.FEW and sum(map(len, parts)) == 1000
    assert [v[0] for p in parts for v in p["on"]] == list(range(1000))

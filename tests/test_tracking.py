"""Scripted and brute-force cases of the tracker's state, of lost regions and of windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplane.operators import losses, masks, sequence, tracking

PX = "clip long, frame long, x long, y long"


def px_of(spark, frames, clip=0):
    return spark.createDataFrame([(clip, f, int(x), int(y)) for f, m in enumerate(frames) for y, x in zip(*np.nonzero(m))], PX)


def figure(hand=True, moved=False):
    m = np.zeros((24, 32), bool)
    m[0:20, 2:10] = True
    if hand:
        m[2:14, 10:22] = True
    if moved:
        m[2:14, 22:32] = True
    return m


def flood(mask, diagonal):
    label, n = np.zeros(mask.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for start in zip(*np.nonzero(mask)):
        if not label[start]:
            n, todo = n + 1, [start]
            label[start] = n
            while todo:
                y, x = todo.pop()
                for dy, dx in steps:
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not label[q]:
                        label[q] = n
                        todo.append(q)
    return label, n


def test_regions_and_discs():
    rng = np.random.default_rng(3)
    for _ in range(150):
        m = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.random()
        for diagonal in (False, True):
            (a, n), (b, k) = masks.regions(m, diagonal), flood(m, diagonal)
            assert n == k and (a == b).all()
        reach, on, place = rng.random() * 5, np.argwhere(m), np.indices(m.shape)
        far = np.min([np.hypot(place[0] - y, place[1] - x) for y, x in on], axis=0) if len(on) else np.full(m.shape, np.inf)
        assert (tracking.near(m, reach) == (far <= reach)).all()


def loss_of(spark, frames, points=None, slab=64):
    n = spark.createDataFrame([(0, len(frames))], "clip long, n long")
    found = losses.mask_losses(px_of(spark, frames), n, 32, 24, 1, 4, points, slab).collect()
    return {r.frame: round(r.mask_loss, 4) for r in found}


def test_loss_of_a_hand(spark):
    away = lambda *at: [figure(k not in at) for k in range(24)]
    found = loss_of(spark, away(6, 7))
    assert set(found) == {6, 7} and found[6] == round(11 * 12 / (160 + 144), 4)  # the column next to the body is grown over
    assert set(loss_of(spark, away(*range(6, 14)))) == set(range(6, 14))
    assert loss_of(spark, away(*range(6, 15))) == {}  # longer than a run
    assert loss_of(spark, [figure(k not in (6, 7, 8, 9), k in (6, 7, 8, 9)) for k in range(24)]) == {}  # it moved
    assert loss_of(spark, [figure(k in (6, 8)) for k in range(24)]) == {}  # held on no frame beyond: it blinked
    assert loss_of(spark, away(*range(6, 24))) == {}  # it never comes back
    empty = [np.zeros((24, 32), bool)] * 3 + away(6, 7)
    assert set(loss_of(spark, empty)) == {9, 10}


def test_loss_needs_points_of_a_pose(spark):
    frames = [figure(k not in (6, 7)) for k in range(16)]
    points = lambda *at: spark.createDataFrame([(0, f, 15, 6) for f in at], PX)
    assert set(loss_of(spark, frames, points(6, 7))) == {6, 7}
    assert loss_of(spark, frames, points(6)) == {}


def test_slabs_change_nothing(spark):
    rng = np.random.default_rng(5)
    frames = [figure(rng.random() < 0.7) for _ in range(60)]
    whole = loss_of(spark, frames)
    assert whole and whole == loss_of(spark, frames, slab=5) == loss_of(spark, frames, slab=1)


def test_annexed_background(spark):
    body, more = np.zeros((24, 32), bool), np.zeros((24, 32), bool)
    body[4:12, 4:12], more[14:22, 20:28] = True, True
    frames = [body, body | more, body | more, body]
    points = lambda *rows: spark.createDataFrame([(0, *r) for r in rows], PX)
    held = lambda p: {r.frame: r.n for r in tracking.annexed(px_of(spark, frames), p, 32, 24, 0.05).groupBy("frame").agg(F.count("*").alias("n")).collect()}
    assert held(points((0, 5, 5))) == {1: 64, 2: 64, 3: 64}
    assert held(points((1, 22, 15))) == {}
    assert held(points((2, 22, 15))) == {1: 64}  # the person has moved there: all of it goes


def test_memory_frames_and_conditioning(spark):
    stored = spark.createDataFrame([(0, f, 0.5 if f in (0, 2, 3, 5) else 0.0) for f in range(8)], "clip long, frame long, score double")
    found = {}
    for r in tracking.memory_frames(stored, stored, 2).collect():
        found.setdefault(r.frame, set()).add(r.t)
    assert found == {1: {0}, 2: {1}, 3: {2}, 4: {2, 3}, 5: {2, 3, 4}, 6: {3, 5}, 7: {3, 5, 6}}
    cond = spark.createDataFrame([(0, f) for f in (0, 10, 20, 30)], "clip long, frame long")
    kept = lambda birth: sorted(r.frame for r in tracking.keep_conditioning(cond, 2, birth).collect())
    assert kept(True) == [0, 30] and kept(False) == [20, 30]


def test_points_from_text(spark):
    read = lambda text: spark.createDataFrame([(text,)], "t string").select(tracking.parse_points(F.col("t"), 100, 50).alias("p")).collect()[0].p
    assert read(None) == [] and read("  ") == []
    assert [tuple(p) for p in read('[{"x": 5, "y": 6.5}]')] == [(5.0, 6.5)]
    assert [tuple(p) for p in read('{"points": [[0.5, 0.5]]}')] == [(50.0, 25.0)]
    for bad in ('[{"x": 100, "y": 0}]', '[{"x": 1}]', "nonsense", '{"points": [[0.1]]}'):
        with pytest.raises(Exception, match="not points"):
            read(bad)


def test_sigmas():
    rounded = lambda steps, shift: [round(s, 4) for s in sequence.beta_sigmas(steps, shift)]
    assert rounded(4, 5.0) == [1.0, 0.7313, 0.2931, 0.0244, 0.0]
    assert rounded(4, 3.0) == [1.0, 0.7270, 0.2819, 0.0089, 0.0]
    assert sequence.beta_sigmas(2, 5.0, denoise=0.5) == sequence.beta_sigmas(4, 5.0)[-3:]


def test_window_past_the_end(spark):
    px = px_of(spark, [np.eye(4, dtype=bool)] * 3)
    n = spark.createDataFrame([(0, 3)], "clip long, n long")
    count = lambda first, length: {r.out: r["count"] for r in masks.window(px, (4, 4), n, first, length).groupBy("out").count().collect()}
    assert count(1, 4) == {0: 4, 1: 4, 2: 16, 3: 16} and count(3, 2) == {}
    one = spark.createDataFrame([(0, 1)], "clip long, n long")
    assert masks.window(px.where("frame = 0"), (4, 4), one, 9, 3).count() == 12

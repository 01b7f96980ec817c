"""The interval join against all pairs, exact edges of frames, and sound that begins late or ends early."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from cliplane.operators import sound


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(1)

    def make(n):
        begin = [rng.randint(-40, 200) for _ in range(n)]
        return [(rng.randint(0, 2), i, a, a + rng.choice([0, 1, 5, 90])) for i, a in enumerate(begin)]

    left, right = make(120), make(100)
    got = sound.interval_join(spark.createDataFrame(left, "k long, i long, a0 long, a1 long"), spark.createDataFrame(right, "k long, j long, b0 long, b1 long"), ["k"], 16)
    want = sorted((i, j) for k, i, a0, a1 in left for m, j, b0, b1 in right if k == m and max(a0, b0) < min(a1, b1))
    assert sorted((r.i, r.j) for r in got.collect()) == want and want


def test_edges_are_exact(spark):
    frames = spark.createDataFrame([(0, f) for f in [0, 1, 2, 3, 29, 30, 10**7]], "clip long, frame long")
    for rate, fps in ((48000, (30000, 1001)), (44100, (24, 1)), (1, (2, 1)), (1001, (24000, 1001))):
        want = {f: tuple(round(Fraction(k * rate * fps[1], fps[0])) for k in (f, f + 1)) for f in [0, 1, 2, 3, 29, 30, 10**7]}
        assert {r.frame: (r.b0, r.b1) for r in sound.frame_edges(frames, rate, fps).collect()} == want


def test_sound_of_windows_and_frames(spark):
    blocks = spark.createDataFrame([(0, 1, 0.5, [1.0, 2.0, 3.0]), (0, 2, None, [4.0, 5.0]), (1, 1, None, [9.0])], "clip long, number long, time double, samples array<double>")
    at = sound.placed(blocks, 4)
    assert sorted((r.clip, r.at) for r in at.collect()) == [(0, 2), (0, 5), (1, 0)]
    asks = spark.createDataFrame([(0, 0.0, 1.5), (1, 0.0, 2.0)], "clip long, start double, duration double")
    got = {r.clip: (r.at, r.samples) for r in sound.window(at, asks, 4, 2).collect()}
    assert got == {0: (0, [0.0, 0.0, 1.0, 2.0, 3.0, 4.0]), 1: (0, [9.0])}  # silence first; the second ends early
    frames = spark.createDataFrame([(0, f) for f in range(3)], "clip long, frame long")
    cut = {r.frame: (r.at, r.samples) for r in sound.by_frame(at, frames, 4, (2, 1), 3).collect()}
    assert cut == {1: (2, [1.0, 2.0]), 2: (4, [3.0, 4.0])}
    assert sound.by_frame(at.where(F.lit(False)), frames, 4, (2, 1)).count() == 0

"""Operators against plain restatements of their rules."""

import numpy as np

from cliplane.operators import boxes, masks, sequence


def test_plan_covers_exactly(spark):
    rows = [(i, t, c, o) for i, (t, c, o) in enumerate([(1, 9, 0), (5, 5, 1), (81, 81, 1), (82, 81, 1), (609, 81, 1), (200, 33, 5)])]
    df = spark.createDataFrame(rows, "video_id long, total_frames long, frames_per_chunk long, overlap long")

    def plain(total, chunk, overlap):
        up = lambda n: max(5, -(-(n - 1) // 4) * 4 + 1)
        out, made = [], 0
        while made < total:
            n = min(chunk, up(total - made + (overlap if out else 0)))
            made += n - (overlap if out else 0)
            out.append(n)
        return out

    got = {r["video_id"]: r["lengths"] for r in sequence.plan_chunks(df).groupBy("video_id").agg({"chunk": "max"}).join(sequence.plan_text(sequence.plan_chunks(df)), "video_id").selectExpr("video_id", "split(split(plan, ' -> ')[0], ' [+] ') AS lengths").collect()}
    assert {k: list(map(int, x)) for k, x in got.items()} == {i: plain(t, c, o) for i, t, c, o in rows}


def test_time_grid_keeps_known_frames(spark):
    df = spark.createDataFrame([(1, 30.0, 8, 24.0), (2, 16.0, 3, 32.0)], "video_id long, fps double, frames long, rate double")
    got = {}
    for r in sequence.time_grid(df).orderBy("video_id", "out").collect():
        got.setdefault(r["video_id"], []).append(r["frame"])
    assert got[1] == [0, 2, 3, 4, 5, 7]
    assert got[2][:5] == [0, 1, 1, 2, 2]


def test_pieces_and_ties(spark):
    px = [(0, 0, x, y) for x, y in [(0, 0), (1, 0), (5, 5), (5, 6), (6, 7)]]
    df = spark.createDataFrame(px, "clip long, frame long, x long, y long")
    four = [(r["area"], r["x0"], r["y0"]) for r in masks.pieces(df).orderBy("piece").collect()]
    assert four == [(2, 0, 0), (2, 5, 5), (1, 6, 7)]
    assert masks.pieces(df, diagonal=True).count() == 2


def test_dilate_is_repeated_cross(spark):
    rng = np.random.default_rng(1)
    mask = rng.random((12, 9)) < 0.1
    df = spark.createDataFrame([(0, 0, int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)], "clip long, frame long, x long, y long")
    want = mask.copy()
    for _ in range(2):
        p = np.pad(want, 1)
        want = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    got = {(r["x"], r["y"]) for r in masks.dilate(df, 2, 9, 12).collect()}
    assert got == {(int(x), int(y)) for y, x in zip(*np.nonzero(want), strict=True)}


def test_undetected_frames(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 1), (1, 1, 0.0, 0.0, 90.0, 90.0, -1.0, 0), (1, 2, 5.0, 5.0, 20.0, 20.0, 0.8, 1)], "clip long, frame long, x1 double, y1 double, x2 double, y2 double, score double, persons int")
    wide = {r["frame"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in boxes.widen(df, 2).collect()}
    assert wide == {0: (0.0, 0.0, 20.0, 20.0), 1: (0.0, 0.0, 90.0, 90.0), 2: (0.0, 0.0, 20.0, 20.0)}
    assert [r["box_iou_prev"] for r in boxes.iou_with_previous(df).orderBy("frame").collect()] == [None, None, None]


def test_entry_imports_without_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_time_grids_of_many_videos_side_by_side(spark):
    """Against a plain fold; lengths and rates vary within a batch, and only the videos themselves are dealt out."""
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.choice([24, 29.97, 60, 3])), int(rng.integers(0, 70)), float(rng.choice([16, 24, 30, 100]))) for i in range(200)]
    want = []
    for i, fps, frames, rate in rows:
        time, out, step, grid = 0.0, 0, 1 / fps, 1 / rate
        for f in range(frames):
            time += step if f else grid
            while time >= grid:
                time -= grid
                want.append((i, out, f))
                out += 1
    df = spark.createDataFrame(rows, "video_id long, fps double, frames long, rate double")
    assert sorted(map(tuple, sequence.time_grid(df).collect())) == want
    loaded = sequence.frame_indices(df.where("frames > 20"), 3, None, 4)
    assert loaded._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    many = {i: sum(1 for w in want if w[0] == i) for i, *_ in rows}
    assert loaded.count() == sum((many[i] - 3) // 4 * 4 + 1 for i, _, frames, _ in rows if frames > 20)


def test_windows_far_longer_than_the_sound(spark):
    """A window of 10^12 samples over 6: bins are made where there is sound, which failed before for want of memory."""
    from cliplane.operators import sound

    blocks = spark.createDataFrame([(1, 2, [1.0, 2.0, 3.0]), (1, 5, [4.0, 5.0, 6.0])], "clip long, at long, samples array<double>")
    asks = spark.createDataFrame([(1, 0.0, 1e12)], "clip long, start double, duration double")
    assert [(r.clip, r.at, r.samples) for r in sound.window(blocks, asks, 1, 2).collect()] == [(1, 0, [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]

"""Frame sequences written and read in ranges, turned pictures, broken files, and the frames of a time grid."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplane.sources import frame_files as ff


def frames_of(spark, clips):
    rows = [(c, f, x.shape[1], x.shape[0], 30000, 1001, bytearray(x.tobytes())) for c, stack in clips.items() for f, x in enumerate(stack)]
    return spark.createDataFrame(rows, ff.SCHEMA)


def read(spark, path, **options):
    ff.register(spark)
    df = spark.read.format("frame_sequence").options(**options).load(str(path))
    return {(r.clip, r.frame): (r.width, r.height, r.rate_num, r.rate_den, bytes(r.pixels)) for r in df.collect()}


def test_round_trip_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    clips = {c: rng.integers(0, 256, (n, 4 + c, 6, 3), dtype=np.uint8) for c, n in ((0, 1), (1, 13), (2, 30))}
    path = tmp_path / "clips"
    ff.write(frames_of(spark, {c: clips[c] for c in (0, 1)}), str(path), range_frames=5)
    ff.write(frames_of(spark, {2: clips[2]}), f"file://{path}", range_frames=7)
    want = {(c, f): (6, 4 + c, 30000, 1001, x.tobytes()) for c, stack in clips.items() for f, x in enumerate(stack)}
    assert read(spark, path) == want and read(spark, path, range_frames="3") == want
    found = {r.clip: (r.frames, r.width, r.height, round(r.fps, 3)) for r in ff.probe(spark, str(path)).collect()}
    assert found == {0: (1, 6, 4, 29.97), 1: (13, 6, 5, 29.97), 2: (30, 6, 6, 29.97)}
    # a segment that no list names (of a task that failed) isn't read
    (path / "9-0-x.ppms").write_bytes(ff.head(1, 1, (1, 1)) + b"abc")
    assert read(spark, path) == want
    ff.write(frames_of(spark, {0: clips[0]}), str(path), mode="overwrite")
    assert set(read(spark, path)) == {(0, 0)}


def test_many_clips_share_few_files(spark, tmp_path):
    """A task's segments stand in one file (or a few, by size), whatever their number, and the driver plans by bytes."""
    rng = np.random.default_rng(5)
    at = [(c, f) for c in range(150) for f in range(1 + c % 7) if (c + f) % 11] + [(None, f) for f in (0, 1, 7)]
    pixels = {k: rng.integers(0, 256, (2 + (k[0] or 0) // 60, 3, 3), dtype=np.uint8) for k in at}
    frames = spark.createDataFrame([(*k, 3, len(x), 24 + (k[0] or 0) % 2, 1, bytearray(x.tobytes())) for k, x in pixels.items()], ff.SCHEMA)
    want = {k: (3, len(x), 24 + (k[0] or 0) % 2, 1, x.tobytes()) for k, x in pixels.items()}
    ff.write(frames, str(tmp_path / "a"), range_frames=3)
    named = json.loads((tmp_path / "a" / ff.LISTING).read_text())
    assert len(named) <= 4 and len(list((tmp_path / "a").glob("*.ppms"))) == len(named)
    parts = lambda path, size, info=False: ff.FrameReader(str(path), 64, True, info, size).partitions()
    assert len(parts(tmp_path / "a", 1 << 20)) == 1 and len(parts(tmp_path / "a", 4000)) > 4
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    frames.repartition(1).sortWithinPartitions("clip", "frame").write.format("frame_sequence").option("file_bytes", "5000").mode("append").save(str(tmp_path / "b"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(json.loads((tmp_path / "b" / ff.LISTING).read_text())) > 4
    for path in (tmp_path / "a", tmp_path / "b"):
        for options in ({}, {"range_frames": "1", "task_bytes": "100"}, {"range_frames": "2", "task_bytes": "777"}):
            assert read(spark, path, **options) == want
        found = {r.clip: (r.frames, r.height) for r in ff.probe(spark, str(path)).collect()}
        assert found == {c: (sum(k[0] == c for k in at), 2 + (c or 0) // 60) for c in {k[0] for k in at}}


def test_lists_of_an_earlier_version(spark, tmp_path):
    x = np.random.default_rng(6).integers(0, 256, (4, 2, 3, 3), dtype=np.uint8)
    for name, part in (("a.ppms", x[:3]), ("b.ppms", x[3:])):
        (tmp_path / name).write_bytes(b"".join(ff.head(3, 2, (24, 1)) + f.tobytes() for f in part))
    (tmp_path / ff.LISTING).write_text(json.dumps([{"name": "a.ppms", "clip": 8, "first": 0}, {"name": "b.ppms", "clip": 8, "first": 3}]))
    ff.write(frames_of(spark, {9: x[:1]}), str(tmp_path))
    got = read(spark, tmp_path)
    assert {k: v[4] for k, v in got.items()} == {(8, f): x[f].tobytes() for f in range(4)} | {(9, 0): x[0].tobytes()}


def test_turned_pictures_and_plain_files(spark, tmp_path):
    x = np.random.default_rng(2).integers(0, 256, (2, 3, 5, 3), dtype=np.uint8)
    for turns in range(4):
        (tmp_path / f"{turns}.ppms").write_bytes(b"".join(ff.head(5, 3, (25, 1), turns) + f.tobytes() for f in x))
        got = read(spark, tmp_path / f"{turns}.ppms")
        shown = [np.rot90(f, turns) for f in x]
        assert [got[0, f][4] for f in (0, 1)] == [np.ascontiguousarray(s).tobytes() for s in shown]
        assert got[0, 0][:2] == (shown[0].shape[1], shown[0].shape[0])
        assert read(spark, tmp_path / f"{turns}.ppms", upright="false")[0, 1][4] == x[1].tobytes()
    assert {k[0] for k in read(spark, tmp_path)} == {0, 1, 2, 3}  # without a list every file is a clip
    (tmp_path / "plain.ppm").write_bytes(b"P6 \n# made by hand\n5 3 \n255\n" + x[0].tobytes())
    assert read(spark, tmp_path / "plain.ppm")[0, 0] == (5, 3, 1, 1, x[0].tobytes())


def test_broken_files_and_rows(spark, tmp_path):
    for name, raw, told in (("a", b"P5\n1 1\n255\nx", "P6"), ("b", ff.head(2, 2, (1, 1)) + b"x" * 11, "whole number"), ("c", b"\x00" * 9, "binary pictures")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=told):
            read(spark, tmp_path / name)
    with pytest.raises(Exception, match="not 2 x 2 pixels"):
        ff.write(spark.createDataFrame([(0, 0, 2, 2, 1, 1, bytearray(b"abc"))], ff.SCHEMA), str(tmp_path / "out"))
    ff.write(spark.createDataFrame([], ff.SCHEMA), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none" / ff.LISTING).read_text()) == [] and read(spark, tmp_path / "none") == {}


def test_packed_pixels_come_back_and_grids_pick_frames(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (3, 2, 4, 3))
    rows = [(5, f, i, k, *map(int, x[f, k, i])) for f in range(3) for k in range(2) for i in range(4)]
    px = spark.createDataFrame(rows, "clip long, frame long, x long, y long, r long, g long, b long")
    frames = ff.packed(px, 4, 2)
    assert {r.frame: bytes(r.pixels) for r in frames.collect()} == {f: x[f].astype(np.uint8).tobytes() for f in range(3)}
    assert sorted(map(tuple, ff.unpacked(frames).collect())) == sorted(rows)
    order = lambda df: [r.frame for r in df.orderBy("position").collect()]
    assert order(ff.extended(frames, 6)) == [0, 1, 2, 2, 2, 2] and order(ff.extended(frames, 8, True)) == [0, 1, 2, 1, 0, 1, 2, 1]
    one = frames.where("frame = 0")
    assert order(ff.extended(one, 3, True)) == [0, 0, 0]
    moved = ff.in_order(frames.where("frame > 0").withColumn("frame", F.col("frame") * 10))
    assert sorted(r.frame for r in moved.collect()) == [0, 1]


def test_frames_with_arrays_and_struct_keys(spark):
    """Frames are packed from arrays too, keys may be structs, and pictures are never broadcast to their positions."""
    df = spark.createDataFrame([(1, f, [f, 2], [3, 255], [5, 6]) for f in range(3)], "clip long, frame long, r array<long>, g array<long>, b array<long>")
    frames = ff.packed(df, 2, 1)
    assert [bytes(r.pixels) for r in frames.orderBy("frame").collect()] == [bytes([f, 3, 5, 2, 255, 6]) for f in range(3)]
    far = ff.extended(frames, 5, True)
    assert far._jdf.queryExecution().optimizedPlan().toString().count("Hint=(strategy=merge)") == 2
    px = ff.unpacked(far.select("clip", F.struct("position", "frame").alias("frame"), "width", "height", "pixels"))
    assert sorted((r.frame.position, r.frame.frame, r.x, r.r, r.g, r.b) for r in px.collect()) == sorted((p, f, x, *((f, 3, 5), (2, 255, 6))[x]) for p, f in enumerate([0, 1, 2, 1, 0]) for x in (0, 1))

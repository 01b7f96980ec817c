"""Masks gathered by frame: the same results as pixel rows, and joins that never send masks to every task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cliplane.operators import depths, driving, losses, masks, repairs, tracking
from cliplane.plans import catalog


def both(spark, seed=1, clips=2, frames=24, width=12, height=10):
    """Random masks with gaps as pixel rows and gathered."""
    rng = np.random.default_rng(seed)
    rows = [(c, f, x, y) for c in range(clips) for f in range(frames) if (c + f) % 9 for y in range(height) for x in range(width) if x < 4 or (x < 9 and f % 5 and rng.random() < 0.95)]
    px = spark.createDataFrame(rows, "clip long, frame long, x long, y long")
    return px, masks.gathered(px, width)


def got(df):
    return sorted(map(repr, df.collect()))


def test_bitmaps_take_slices_and_nulls():
    on = pa.array([[0, 5], None, [], [3]], pa.list_(pa.int32()))
    assert [np.flatnonzero(m).tolist() for m in masks.bitmaps(on, 3, 2)] == [[0, 5], [], [], [3]]
    assert [np.flatnonzero(m).tolist() for m in masks.bitmaps(on.slice(2), 3, 2)] == [[], [3]]


def test_rows_and_gathered_masks_agree(spark):
    px, on = both(spark)
    births = px.groupBy("clip").agg(F.min("frame").alias("birth"))
    n = px.groupBy("clip").agg((F.max("frame") + 1).alias("n"))
    read = losses.final_reader(1, 2)
    for f in (
        lambda m: repairs.gained(m, births, n, 12, 10),
        lambda m: repairs.lost_for_good(m, births, 12, 10),
        lambda m: depths.region_points(m, 12, 10),
        lambda m: losses.mask_losses(m, n, 12, 10, grow=1, block=2, slab=8),
        lambda m: losses.dropped_parts(m, n, 12, 10, read, slab=8).drop("region"),
    ):
        assert got(f(px)) == got(f(on))
    assert got(depths.region_points(on, 12, 10))


def test_depths_of_stacks_equal_those_of_frames():
    stack = np.random.default_rng(4).random((30, 9, 13)) < 0.8
    stack[0], stack[1] = False, True
    assert all((a == depths.squared_depths(m)).all() for a, m in zip(depths.stack_depths(stack), stack, strict=True))


def test_masks_are_not_broadcast(spark, tmp_path):
    for name in ("track_lost_for_good", "track_gained", "mask_loss", "dropped_parts"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=merge)" in plan or "leftHint=(strategy=merge)" in plan, name
        assert "explode(sequence(0, 21" not in plan  # no row for each pixel


def test_readings_are_those_of_cells_and_shuffle_nothing(spark):
    rng = np.random.default_rng(8)
    width, height, clear = 56, 40, 0
    rows = []
    for f in range(12):
        mask = np.kron(rng.random((10, 14)) < rng.choice([0.0, 0.3, 0.6, 0.9]), np.ones((4, 4), bool))
        rows += [(1, f, int(x), int(y)) for y, x in np.argwhere(mask)]
    px = spark.createDataFrame(rows, "clip long, frame long, x long, y long")
    wide = masks.gathered(px, width)
    want = sorted((r.clip, r.frame, r.y * width + r.x) for r in driving.latent_reading(masks.cells(px, width, height), width, height).collect())
    for some in (px, wide):
        found = driving.readings(some, width, height).collect()
        assert sorted((r.clip, r.frame, p) for r in found for p in r.on) == want and want
    held = spark.createDataFrame([(r.clip, r.frame, r.on) for r in wide.collect()], "clip long, frame long, on array<int>")
    assert "Exchange" not in driving.readings(held, width, height)._jdf.queryExecution().executedPlan().toString()


def test_slabs_travel_as_bits_in_many_tasks_and_regions_are_found_once(spark):
    """Masks of like frames are few bytes: their slabs aren't put into one task, and no list of pixels is dealt to them."""
    for name, steps in (("repair_frames", 1), ("repair_frames_posed", 1), ("mask_loss_posed", 3)):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        text = plan.toString()
        assert text.count("RepartitionByExpression [clip") >= steps and "FlatMapGroupsInPandas" not in text and "FlatMapCoGroups" not in text, name
        assert all(f", {spark.conf.get('spark.sql.shuffle.partitions')}" in line for line in text.splitlines() if "RepartitionByExpression" in line and "slab" in line), name
    assert text.count("bits#") > 0
    once = catalog.QUERIES["repair_frames"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("RepartitionByExpression" in line and "slab" in line for line in once.splitlines()) == 1


def test_lots_of_slabs_equal_one_at_a_time(spark):
    """Whole groups in lots of any size, over batches that cut them, clips without a name among them."""
    rows = [(clip, f, bytes([(clip or 7) * 31 + f & 255])) for clip in (None, 1, 2, 3) for f in range(40)]
    df = spark.createDataFrame(rows, "clip long, frame long, bits binary").withColumn("slab", F.floor(F.col("frame") / 7))

    def told(rows, starts):
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            some = rows.slice(a, b - a).to_pydict()
            yield pa.RecordBatch.from_pydict({"clip": pa.array(some["clip"][:1], pa.int64()), "slab": some["slab"][:1], "text": [str((some["clip"], some["slab"], some["frame"]))]})

    want = sorted(str(([c] * len(f), [k] * len(f), f)) for c in (None, 1, 2, 3) for k in range(6) for f in [list(range(7 * k, min(40, 7 * k + 7)))])
    for size in ("3", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for pixels in (1, losses.TOGETHER // 20, losses.TOGETHER * 2):
            got = losses.in_groups(df, ["clip", "slab"], "frame", pixels, told, "clip long, slab long, text string").collect()
            assert sorted(r.text for r in got) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_regions_and_zones_of_stacks_equal_those_of_frames():
    rng = np.random.default_rng(12)
    stack = rng.random((40, 9, 13)) < rng.choice([0.0, 0.3, 0.6, 1.0], (40, 1, 1))
    for diagonal in (False, True):
        assert all((a == masks.regions(m, diagonal)[0]).all() for a, m in zip(masks.stack_regions(stack, diagonal), stack, strict=True))
    assert masks.stack_regions(stack[:0], True).shape == (0, 9, 13)
    for reach in (0.0, 1.2, 3.7):
        assert all((a == tracking.near(m, reach)).all() for a, m in zip(tracking.near(stack, reach), stack, strict=True))

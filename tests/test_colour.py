"""Colour statistics and transfers send a row a clip to the pixels, never the pixels to their clip's task."""

from pyspark.sql import functions as F

from cliplane.operators import colour


def test_pixels_stay_where_they_are(spark):
    rows = [("ab"[i % 2], i % 5 / 5, i % 7 / 7, i % 11 / 11, 1.0 + i % 3) for i in range(500)]
    px = spark.createDataFrame(rows, "clip string, r double, g double, b double, weight double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no table looked small
    try:
        found = colour.statistics(px)
        plans = [found, colour.apply_transfer(px, colour.transfer(found, found), 1.0)]
        joins = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
        assert "SortMergeJoin" not in joins[0] and "BroadcastHashJoin" in joins[1]
        same = plans[1].agg(F.sum("r"), F.sum("g"), F.sum("b")).first()
        assert all(abs(a - sum(r[k] for r in rows)) < 1e-3 for k, a in enumerate(same, 1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)

"""Resampling weights and the errors of load fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplane.operators import media


@pytest.mark.parametrize("method", media.METHODS)
def test_weights_add_to_one_and_keep_a_size(method):
    for n, m in ((7, 7), (7, 3), (3, 7), (1, 4), (48, 13), (5, 1)):
        w = np.zeros((m, n))
        for i, at, v in media.taps(n, m, method):
            w[i, at] = v
        assert np.allclose(w.sum(axis=1), 1)
        if n == m:
            assert np.allclose(w, np.eye(n))
        assert np.allclose(w, w[::-1, ::-1]) or method == "nearest"  # mirrored input, mirrored output


def test_resample_matches_matrices(spark):
    rng = np.random.default_rng(2)
    image = rng.random((6, 9))
    rows = [(0, 0, x, y, float(image[y, x])) for y in range(6) for x in range(9)]
    df = spark.createDataFrame(rows, "clip long, frame long, x long, y long, v double")
    for method in media.METHODS:
        a, b = np.zeros((4, 9)), np.zeros((11, 6))
        for m, n, k in ((a, 9, 4), (b, 6, 11)):
            for i, at, w in media.taps(n, k, method):
                m[i, at] = w
        got = np.zeros((11, 4))
        for r in media.resample(df, (9, 6), (4, 11), method, ["v"]).collect():
            got[r.y, r.x] = r.v
        assert np.allclose(got, b @ image @ a.T)
    with pytest.raises(ValueError):
        media.taps(3, 3, "other")


def test_load_fields_refuse(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0].v
    assert one(media.parse_rate(F.lit(" 23.976 "))) == 23.976 and one(media.parse_rate(F.lit(""))) is None
    assert one(media.parse_count(F.lit(" 81 "))) == 81 and one(media.parse_count(F.lit("  "))) is None
    for text in ("0", "-1", "fast", "NaN", "Infinity"):
        with pytest.raises(Exception, match="not a rate"):
            one(media.parse_rate(F.lit(text)))
    for text in ("0", "1.5", "many"):
        with pytest.raises(Exception, match="not a count"):
            one(media.parse_count(F.lit(text)))
    v = spark.createDataFrame([(1, 640, 640)], "video_id long, width long, height long")
    size = lambda m, label, o: tuple(media.load_size(v, F.lit(m), F.lit(label), F.lit(o)).collect()[0])[1:]
    assert size("Wan", "480p", "auto") == (832, 480) and size("SCAIL", "512p", "portrait") == (512, 896) and size("Wan", "source", "auto") == (None, None)
    with pytest.raises(Exception, match="no such model"):
        size("Other", "480p", "auto")
    with pytest.raises(Exception, match="is no size of"):
        size("Wan", "512p", "auto")


def test_soft_edge_stays_inside(spark):
    px = spark.createDataFrame([(0, 0, x, y) for x in range(10, 30) for y in range(10, 30)], "clip long, frame long, x long, y long")
    rows = {(r.x, r.y): r.weight for r in media.feather(px, 40, 40, 0.1).collect()}
    assert len(rows) == 400 and max(rows.values()) == 1.0 and 0 < rows[10, 10] < rows[13, 13] <= 1.0

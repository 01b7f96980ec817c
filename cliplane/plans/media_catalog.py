"""Queries of sizes, rates and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplane.operators import media
from cliplane.plans.catalog import query, rounded
from cliplane.sources import views as v

MW, MH = 48, 50


@query(f"""WITH {v.VIDEO_SQL} SELECT video_id, [24, 25, 30, 2997, 2997, 60][video_id % 6 + 1]::BIGINT AS fps_num, [1, 1, 1, 100, 125, 1][video_id % 6 + 1]::BIGINT AS fps_den, width + width % 2 AS to_width, height + height % 2 AS to_height,
  round_even(frames * 48000 / fps, 0)::BIGINT AS samples FROM video""")
def video_write_plan(spark, d):
    return media.write_plan(v.videos(spark, d), 48000)


@query(f"WITH {v.VIDEO_SQL} SELECT video_id // 2 AS key, min(frames) AS frames, max(width) // 2 * 2 AS width, max(height) // 2 * 2 AS height FROM video GROUP BY 1")
def side_by_side(spark, d):
    return media.side_by_side(v.videos(spark, d), F.floor(F.col("video_id") / 2))


@query(f"""WITH {v.VIDEO_SQL}, s AS (SELECT *, CASE WHEN video_id % 4 = 3 THEN NULL WHEN video_id % 2 = 0 THEN 720 ELSE 704 END AS a, CASE WHEN video_id % 4 = 3 THEN NULL ELSE 1280 END AS b, CASE video_id % 3 WHEN 0 THEN height > width WHEN 1 THEN true ELSE false END AS tall FROM video)
SELECT video_id, (CASE WHEN tall THEN a ELSE b END)::BIGINT AS to_width, (CASE WHEN tall THEN b ELSE a END)::BIGINT AS to_height FROM s""")
def load_size(spark, d):
    k = F.col("video_id")
    label = F.when(k % 4 == 3, "source").when(k % 2 == 0, "720p").otherwise("704p")
    turned = F.when(k % 3 == 0, "auto").when(k % 3 == 1, "portrait").otherwise("landscape")
    return media.load_size(v.videos(spark, d), F.when(k % 2 == 0, "Wan").otherwise("SCAIL"), label, turned)


@query("SELECT p_partkey AS video_id, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_size::DOUBLE ELSE 29.97e0 END AS rate, CASE p_partkey % 2 WHEN 0 THEN NULL ELSE p_size::BIGINT END AS frames FROM part")
def parse_load_fields(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    rate = F.when(k % 3 == 0, "").when(k % 3 == 1, size).otherwise(" 29.97 ")
    return v.table(spark, d, "part").select(k.alias("video_id"), media.parse_rate(rate).alias("rate"), media.parse_count(F.when(k % 2 == 0, " ").otherwise(size)).alias("frames"))


_AREA = "SELECT clip, frame, i AS x, k AS y, count(*)::DOUBLE / ((-(-(i + 1) * {n} // {a}) - i * {n} // {a}) * (-(-(k + 1) * {m} // {b}) - k * {m} // {b})) AS v FROM px, range({a}) s(i), range({b}) t(k) WHERE x >= i * {n} // {a} AND x * {a} < (i + 1) * {n} AND y >= k * {m} // {b} AND y * {b} < (k + 1) * {m} GROUP BY 1, 2, 3, 4"
_AREA = _AREA.replace("(-(-(i + 1) * {n} // {a})", "(((i + 1) * {n} + {a} - 1) // {a}").replace("(-(-(k + 1) * {m} // {b})", "(((k + 1) * {m} + {b} - 1) // {b}")


def _bilinear(src: str, n: int, m: int, a: int, b: int) -> str:
    """src (clip, frame, x, y, v) brought from n x m to a x b pixels."""
    axis = lambda o, n, m: f"SELECT o, u.i AS i, CASE u.e WHEN 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS w FROM (SELECT o, greatest((o + 0.5e0) * {n} / {m} - 0.5e0, 0) AS p FROM range({m}) t(o)) q, LATERAL (SELECT least(floor(p) + e, {n - 1})::BIGINT AS i, e FROM range(2) z(e)) u"
    return f"SELECT clip, frame, wx.o AS x, wy.o AS y, sum(v * wx.w * wy.w) AS v FROM {src} JOIN ({axis('x', n, a)}) wx ON wx.i = x JOIN ({axis('y', m, b)}) wy ON wy.i = y WHERE wx.w > 0 AND wy.w > 0 GROUP BY 1, 2, 3, 4"


def _ones(spark, d):
    return v.mask_px(spark, d).withColumn("v", F.lit(1.0))


@query(f"WITH {v.MASK_SQL}, r AS ({_AREA.format(n=MW, m=MH, a=13, b=17)}) SELECT clip, frame, x, y, round(v, 6) AS v FROM r")
def resample_area(spark, d):
    return rounded(media.resample(_ones(spark, d), (MW, MH), (13, 17), "area", ["v"]), "v")


@query(f"WITH {v.MASK_SQL}, o AS (SELECT *, 1e0 AS v FROM px), r AS ({_bilinear('o', MW, MH, 60, 70)}) SELECT clip, frame, count(*) AS pixels, round(sum(v), 5) AS v, round(max(v), 6) AS most FROM r GROUP BY 1, 2")
def resample_bilinear(spark, d):
    r = media.resample(_ones(spark, d), (MW, MH), (60, 70), "bilinear", ["v"]).groupBy("clip", "frame").agg(F.count("*").alias("pixels"), F.sum("v").alias("v"), F.max("v").alias("most"))
    return r.withColumns({"v": F.round("v", 5), "most": F.round("most", 6)})


@query(f"WITH {v.MASK_SQL}, o AS (SELECT *, 1e0 AS v FROM px), r AS ({_bilinear('o', MW, MH, 60, 70)}) SELECT clip, frame, count(*) AS area FROM r WHERE v > 0.37e0 GROUP BY 1, 2")
def mask_cut_resized(spark, d):
    return media.cut_resized(_ones(spark, d), (MW, MH), (60, 70), 0.37).groupBy("clip", "frame").agg(F.count("*").alias("area"))


@query(f"WITH {v.MASK_SQL}, c AS ({_AREA.format(n=MW, m=MH, a=10, b=10)}), u AS ({_bilinear('c', 10, 10, MW, MH)}) SELECT clip, frame, count(*) AS pixels, round(sum(least(v, 1)), 5) AS weight FROM px JOIN u USING (clip, frame, x, y) GROUP BY 1, 2")
def mask_feather(spark, d):
    f = media.feather(v.mask_px(spark, d), MW, MH, 0.1).groupBy("clip", "frame").agg(F.count("*").alias("pixels"), F.sum("weight").alias("weight"))
    return f.withColumn("weight", F.round("weight", 5))


@query(f"""WITH {v.MASK_SQL}, c AS (SELECT l_suppkey % 3 AS clip, l_orderkey % 64 AS frame, l_partkey % 48 AS x, l_quantity::BIGINT - 1 AS y, l_quantity / 50e0 AS r FROM lineitem)
SELECT c.clip, c.frame, count(*) AS pixels, round(sum(CASE WHEN px.x IS NULL THEN 0 ELSE r END), 6) AS r FROM c LEFT JOIN px ON px.clip = c.clip AND px.frame = c.frame AND px.x = c.x AND px.y = c.y GROUP BY 1, 2""")
def mask_on_black(spark, d):
    c = v.table(spark, d, "lineitem").selectExpr("l_suppkey % 3 AS clip", "l_orderkey % 64 AS frame", "l_partkey % 48 AS x", "CAST(l_quantity AS BIGINT) - 1 AS y", "l_quantity / 50 AS r")
    return rounded(media.on_black(c, v.mask_px(spark, d), ("r",)).groupBy("clip", "frame").agg(F.count("*").alias("pixels"), F.sum("r").alias("r")), "r")


@query(f"WITH {v.MASK_SQL}, {v.BOXES_SQL} SELECT clip, frame, EXISTS (SELECT 1 FROM px WHERE px.clip = b.clip AND px.frame = b.frame) AS masked FROM boxes b")
def mask_present(spark, d):
    return media.present(v.boxes(spark, d), v.mask_px(spark, d))

"""Queries of poses that move between images, foreign layouts, heat maps and detector crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplane.operators import boxes as bx
from cliplane.operators import poses
from cliplane.plans.catalog import query, rounded
from cliplane.sources import views as v

W, H = v.WIDTH, v.HEIGHT


@query(f"""WITH {v.BOXES_SQL}, c AS (SELECT clip, frame, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM boxes)
SELECT clip, frame, round(w, 6) AS w, round(h, 6) AS h, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cx - floor(w / 2), 6) AS left_, round(cy + (h - floor(h / 2)), 6) AS bottom, round(x1 + w, 6) AS right_ FROM c""")
def box_forms(spark, d):
    b = v.boxes(spark, d).select("clip", "frame", F.array(*bx.CORNERS).alias("box"))
    xywh, ctwh = poses.convert_box(F.col("box"), "xyxy2xywh"), poses.convert_box(F.col("box"), "xyxy2ctwh")
    b = b.withColumns({"xywh": xywh, "ctwh": ctwh})
    back, corner = poses.convert_box(F.col("ctwh"), "ctwh2xyxy"), poses.convert_box(F.col("xywh"), "xywh2xyxy")
    cols = {"w": F.col("xywh")[2], "h": F.col("xywh")[3], "cx": F.col("ctwh")[0], "cy": F.col("ctwh")[1], "left_": back[0], "bottom": back[3], "right_": corner[2]}
    return rounded(b.select("clip", "frame", *[c.alias(k) for k, c in cols.items()]), *cols)


@query(f"""WITH {v.KP_SQL} SELECT clip, frame, round(coalesce(min(x) FILTER (WHERE c > 0.5), 0), 6) AS x0, round(coalesce(min(y) FILTER (WHERE c > 0.5), 0), 6) AS y0,
  round(coalesce(max(x) FILTER (WHERE c > 0.5), 0), 6) AS x1, round(coalesce(max(y) FILTER (WHERE c > 0.5), 0), 6) AS y1, count(*) FILTER (WHERE x >= 0 AND y >= 0 AND x <= 1280 AND y <= 720 AND c >= 0.6e0) AS valid
FROM kp GROUP BY clip, frame""")
def pose_bounds(spark, d):
    p = v.pose(spark, d).select("clip", "frame", poses.bounds(F.col("body")).alias("b"), F.size(F.filter("body", lambda q: poses.valid(q, W, H, 0.6))).cast("long").alias("valid"))
    return rounded(p.select("clip", "frame", "b.*", "valid"), "x0", "y0", "x1", "y1")


_SUMS = "round(sum(px), 4) AS x, round(sum(py), 4) AS y, round(max(px), 4) AS far, count(*) AS points"


def _sums(df, points):
    p = df.select("clip", "frame", F.explode(points).alias("p"))
    return p.groupBy("clip", "frame").agg(F.round(F.sum("p.x"), 4).alias("x"), F.round(F.sum("p.y"), 4).alias("y"), F.round(F.max("p.x"), 4).alias("far"), F.count("*").alias("points"))


@query(f"WITH {v.KP_SQL}, m AS (SELECT clip, frame, (x - 100) * 640 / 1000 AS px, (y - 40) * 360 / 600 AS py FROM kp) SELECT clip, frame, {_SUMS} FROM m GROUP BY clip, frame")
def pose_crop_resize(spark, d):
    """A crop from (100, 40) to (1100, 640), resized to 640 x 360."""
    cut = poses.mapped(F.col("body"), dx=-100.0, dy=-40.0)
    return _sums(v.pose(spark, d), poses.mapped(cut, 640 / 1000, 360 / 600))


@query(f"""WITH {v.KP_SQL}, {v.VIDEO_SQL}, s AS (SELECT video_id, video_id % 10 AS clip, width, height FROM video), f AS (SELECT *, height::DOUBLE / width > 1e0 AS tall FROM s),
t AS (SELECT video_id, clip, CASE WHEN tall THEN 512e0 / height ELSE 512e0 / width END AS k, CASE WHEN tall THEN floor((512 - floor(512e0 / height * width)) / 2) ELSE 0 END AS dx, CASE WHEN tall THEN 0 ELSE floor((512 - floor(512e0 / width * height)) / 2) END AS dy FROM f),
m AS (SELECT video_id, x * k + dx AS px, y * k + dy AS py FROM kp JOIN t USING (clip) WHERE frame = 0) SELECT video_id, {_SUMS} FROM m GROUP BY video_id""")
def pose_padding(spark, d):
    """The first pose of a clip as on an image of the size of each video, fitted into a square of 512."""
    size = v.videos(spark, d).select("video_id", (F.col("video_id") % 10).alias("clip"), poses.padding(F.col("width").cast("double"), F.col("height").cast("double"), 512, 512).alias("t"))
    p = v.pose(spark, d).where("frame = 0").join(size, "clip").withColumns({"clip": F.col("video_id"), "frame": F.lit(0)})
    found = _sums(p, poses.mapped(F.col("body"), F.col("t.scale"), F.col("t.scale"), F.col("t.dx"), F.col("t.dy")))
    return found.withColumnRenamed("clip", "video_id").drop("frame")


@query(f"""WITH {v.KP_SQL}, m AS (SELECT clip, frame, CASE WHEN c < 0.4e0 THEN 0 ELSE x / 1280 * 1280 END AS px, CASE WHEN c < 0.4e0 THEN 0 ELSE y / 720 * 720 END AS py, c FROM kp)
SELECT clip, frame, {_SUMS}, sum(CASE WHEN c < 0.4e0 THEN 0 ELSE 1 END)::BIGINT AS known FROM m GROUP BY clip, frame""")
def pose_listed(spark, d):
    """Bodies as lists of relative points with gaps, back in pixels."""
    listed = F.transform("body", lambda p: F.when(p["c"] >= 0.4, F.struct((p["x"] / W).alias("x"), (p["y"] / H).alias("y"))))
    p = v.pose(spark, d).select("clip", "frame", poses.from_listed_body(listed, F.lit(float(W)), F.lit(float(H))).alias("body"))
    known = p.select("clip", "frame", F.size(F.filter("body", lambda q: q["c"] == 1)).cast("long").alias("known"))
    return _sums(p, F.col("body")).join(known, ["clip", "frame"])


@query(f"""WITH {v.BOXES_SQL}, s AS (SELECT clip, frame, (x1 + x2) / 2 + 0.1234567e0 AS cx, (y1 + y2) / 2 + 0.1234567e0 AS cy, greatest(x2 - x1, y2 - y1) / 200 * 1.25e0 AS k FROM boxes),
m AS (SELECT *, 224 / (200 * k) AS a, 224 * (0.5e0 - cx / (200 * k)) AS tx, 224 * (0.5e0 - cy / (200 * k)) AS ty FROM s),
u AS (SELECT clip, frame, round_even((0 - tx) / a, 0)::BIGINT AS x0, round_even((0 - ty) / a, 0)::BIGINT AS y0, round_even((224 - tx) / a, 0)::BIGINT AS x1, round_even((224 - ty) / a, 0)::BIGINT AS y1 FROM m)
SELECT *, greatest(0, -x0) AS nx0, least(x1, 1280) - x0 AS nx1, greatest(0, x0) AS ox0, least(1280, x1) AS ox1, greatest(0, -y0) AS ny0, least(y1, 720) - y0 AS ny1, greatest(0, y0) AS oy0, least(720, y1) AS oy1, x1 - x0 AS w, y1 - y0 AS h FROM u""")
def pose_crop_window(spark, d):
    """The part of each frame that the crop about its box shows. Boxes stand a little off whole pixels, so that rounding is clear."""
    b = v.boxes(spark, d)
    b = b.withColumns({c: F.col(c) + 0.1234567 for c in bx.CORNERS})
    centre, scale = poses.detector_crop([F.col(c) for c in bx.CORNERS])
    return b.select("clip", "frame", poses.crop_window(centre, scale, poses.CROP, W, H).alias("w")).select("clip", "frame", "w.*")


_CELLS = """f AS (SELECT label::BIGINT AS clip, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS frame, embedding AS e FROM embeddings),
u AS (SELECT clip, frame, i % 8 AS x, i // 8 AS y, e[i + 1]::DOUBLE AS v FROM f, range(64) t(i)),
pk AS (SELECT clip, frame, arg_max(x, v - (y * 8 + x) * 0e0) AS x, arg_max(y, v) AS y, max(v) AS peak FROM u GROUP BY 1, 2),
n AS (SELECT pk.clip, pk.frame, pk.x, pk.y, peak, {cols} FROM pk LEFT JOIN u ON u.clip = pk.clip AND u.frame = pk.frame GROUP BY ALL)"""


def _cells(*steps) -> str:
    cols = ", ".join(f"max(u.v) FILTER (WHERE u.x = pk.x + ({i}) AND u.y = pk.y + ({j})) AS h{k}" for k, (i, j) in enumerate(steps))
    return _CELLS.format(cols=cols)


@query(f"""WITH {_cells((1, 0), (-1, 0), (0, 1), (0, -1))}, g AS (SELECT *, x > 1 AND x < 7 AND y > 1 AND y < 7 AS inner_ FROM n),
q AS (SELECT clip, frame, x + CASE WHEN inner_ THEN sign(h0 - h1) * 0.25e0 ELSE 0 END AS px, y + CASE WHEN inner_ THEN sign(h2 - h3) * 0.25e0 ELSE 0 END AS py, peak FROM g)
SELECT clip, frame, round(px * 200 / 8 + 640 - 100, 6) AS x, round(py * 400 / 8 + 360 - 200, 6) AS y, round(px * 200 / 7 + 640 - 100, 6) AS ux, round(peak, 6) AS peak FROM q""")
def heatmap_keypoints(spark, d):
    """Peaks of the raw vectors as 8 x 8 heat maps, nudged to their higher neighbours, in an image of 1280 x 720."""
    p = v.pose(spark, d).select("clip", "frame", F.transform("e", lambda x: x.cast("double")).alias("cells"))
    x, y, top = poses.peak(F.col("cells"), 8)
    p = p.withColumns({"x": x, "y": y, "peak": top})
    nx, ny = poses.nudged(F.col("cells"), F.col("x"), F.col("y"), 8, 8)
    at = lambda udp: poses.to_image(nx, ny, (F.lit(640.0), F.lit(360.0)), (F.lit(200.0), F.lit(400.0)), (8, 8), udp)
    return rounded(p.select("clip", "frame", at(False)[0].alias("x"), at(False)[1].alias("y"), at(True)[0].alias("ux"), "peak"), "x", "y", "ux", "peak")


_RING = ((1, 0), (-1, 0), (0, 1), (0, -1), (2, 0), (-2, 0), (0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1))


@query(f"""WITH {_cells(*_RING)}, k AS (SELECT *, 0.5e0 * (h0 - h1) AS dx, 0.5e0 * (h2 - h3) AS dy, 0.25e0 * (h4 - 2 * peak + h5) AS dxx, 0.25e0 * (h6 - 2 * peak + h7) AS dyy, 0.25e0 * (h8 - h9 - h10 + h11) AS dxy FROM n)
SELECT clip, frame, round(x + CASE WHEN x > 1 AND x < 6 AND y > 1 AND y < 6 THEN -(dyy * dx - dxy * dy) / (dxx * dyy - dxy * dxy) ELSE 0 END, 5) AS x,
  round(y + CASE WHEN x > 1 AND x < 6 AND y > 1 AND y < 6 THEN -(dxx * dy - dxy * dx) / (dxx * dyy - dxy * dxy) ELSE 0 END, 5) AS y FROM k""")
def heatmap_taylor(spark, d):
    p = v.pose(spark, d).select("clip", "frame", F.transform("e", lambda x: x.cast("double")).alias("cells"))
    x, y, _ = poses.peak(F.col("cells"), 8)
    p = p.withColumns({"x": x, "y": y})
    tx, ty = poses.taylor(F.col("cells"), F.col("x"), F.col("y"), 8, 8)
    return p.select("clip", "frame", F.round(tx, 5).alias("x"), F.round(ty, 5).alias("y"))


def _blur_sql(kernel: int, mirror: bool) -> str:
    """b (clip, frame, x, y, l): log heat of the blurred maps of 8 x 8 cells; pk: their peaks."""
    weights = ", ".join(f"({k - kernel // 2}, {w!r}e0)" for k, w in enumerate(poses.gaussian(kernel)))
    to = lambda c: f"CASE WHEN {c} + d < 0 THEN -({c} + d) WHEN {c} + d > 7 THEN 14 - ({c} + d) ELSE {c} + d END" if mirror else f"{c} + d"
    scaled = "v" if mirror else "v * top / max(v) OVER (PARTITION BY clip, frame)"
    return f"""f AS (SELECT label::BIGINT AS clip, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS frame, embedding AS e FROM embeddings),
u AS (SELECT clip, frame, i % 8 AS x, i // 8 AS y, e[i + 1]::DOUBLE AS v, max(e[i + 1]::DOUBLE) OVER (PARTITION BY clip, frame) AS top FROM f, range(64) t(i)), w(d, w) AS (VALUES {weights}),
r AS (SELECT a.clip, a.frame, a.x, a.y, sum(w.w * b.v) AS v FROM u a, w JOIN u b ON b.clip = a.clip AND b.frame = a.frame AND b.y = a.y AND b.x = {to("a.x")} GROUP BY ALL),
c AS (SELECT a.clip, a.frame, a.x, a.y, a.top, sum(w.w * b.v) AS v FROM u a, w JOIN r b ON b.clip = a.clip AND b.frame = a.frame AND b.x = a.x AND b.y = {to("a.y")} GROUP BY ALL),
s AS (SELECT clip, frame, x, y, {scaled} AS v FROM c), b AS (SELECT clip, frame, x, y, ln(least(50e0, greatest(0.001e0, round(v, 9)))) AS l FROM s), pk AS (SELECT clip, frame, arg_max(x, v) AS x, arg_max(y, v) AS y, max(v) AS peak FROM u GROUP BY 1, 2)"""


_PLACES = {"c": (0, 0), "e": (1, 0), "w": (-1, 0), "s": (0, 1), "n": (0, -1), "se": (1, 1), "nw": (-1, -1)}


def _refined_sql(kernel: int, mirror: bool, select: str) -> str:
    near = ", ".join(f"max(l) FILTER (WHERE b.x = least(7, greatest(0, pk.x + ({i}))) AND b.y = least(7, greatest(0, pk.y + ({j})))) AS {k}" for k, (i, j) in _PLACES.items())
    eps = f"{2.0**-23!r}"
    return f"""WITH {_blur_sql(kernel, mirror)}, h AS (SELECT pk.clip, pk.frame, pk.x, pk.y, peak, {near} FROM pk JOIN b ON b.clip = pk.clip AND b.frame = pk.frame GROUP BY ALL),
d AS (SELECT *, 0.5e0 * (e - w) AS dx, 0.5e0 * (s - n) AS dy, e - 2 * c + w + {eps} AS dxx, s - 2 * c + n + {eps} AS dyy, 0.5e0 * (se - e - s + 2 * c - w - n + nw) AS dxy FROM h),
q AS (SELECT clip, frame, peak, x - (dyy * dx - dxy * dy) / (dxx * dyy - dxy * dxy) AS px, y - (dxx * dy - dxy * dx) / (dxx * dyy - dxy * dxy) AS py FROM d) {select}"""


def _refined(spark, d, kernel, mirror):
    p = v.pose(spark, d).select("clip", "frame", F.transform("e", lambda x: x.cast("double")).alias("cells"))
    x, y, top = poses.peak(F.col("cells"), 8)
    p = p.withColumns({"x": x, "y": y, "peak": top, "blurred": poses.blurred(F.col("cells"), 8, 8, kernel, mirror)})
    # whole billionths, so that the order of sums, which flat maps would magnify, doesn't tell
    p = p.withColumn("logs", poses.log_heat(F.transform("blurred", lambda x: F.round(x, 9))))
    rx, ry = poses.refined(F.col("logs"), F.col("x"), F.col("y"), 8, 8)
    return p.withColumns({"rx": rx, "ry": ry})


@query(_refined_sql(11, False, "SELECT clip, frame, round(px * 200 / 7 + 640 - 100, 5) AS x, round(py * 400 / 7 + 360 - 200, 5) AS y, round(peak, 6) AS peak FROM q"))
def heatmap_dark_udp(spark, d):
    """Peaks refined on maps blurred with a cold border, in an image of 1280 x 720."""
    p = _refined(spark, d, 11, False)
    x, y = poses.to_image(F.col("rx"), F.col("ry"), (F.lit(640.0), F.lit(360.0)), (F.lit(200.0), F.lit(400.0)), (8, 8), True)
    return p.select("clip", "frame", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round("peak", 6).alias("peak"))


@query(_refined_sql(3, True, "SELECT clip, frame, round(px, 5) AS x, round(py, 5) AS y FROM q"))
def heatmap_dark_mirror(spark, d):
    p = _refined(spark, d, 3, True)
    return p.select("clip", "frame", F.round("rx", 5).alias("x"), F.round("ry", 5).alias("y"))

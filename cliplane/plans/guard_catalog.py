"""Queries of draw rules, keypoint layouts, mask readings and the guards' reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.operators import boxes as bx
from cliplane.operators import draw, guards, masks, pose, sequence
from cliplane.plans.catalog import _FLAGS, _GROWN, _dist, _measures, _pts, labelled, query, rounded
from cliplane.sources import views as v

W, H, MW, MH = v.WIDTH, v.HEIGHT, 48, 50

# ---------------------------------------------------------------- draw rules

_ARMS = f"{_pts(3, 4, 6, 7)}, arm AS (SELECT clip, frame, c3 >= 0.5 AND c4 >= 0.5 AS r, c6 >= 0.5 AND c7 >= 0.5 AS l FROM pt)"
_DUP = f"""WITH {v.KP_SQL}, {v.HANDS_SQL}, {_ARMS}, h AS (SELECT clip, frame, count(*) FILTER (WHERE lc >= 0.5 AND rc >= 0.5) AS n, quantile_cont(sqrt(power(lx - rx, 2) + power(ly - ry, 2)), 0.5) FILTER (WHERE lc >= 0.5 AND rc >= 0.5) AS m,
  greatest(1, sqrt(power(max(lx) FILTER (WHERE lc >= 0.5) - min(lx) FILTER (WHERE lc >= 0.5), 2) + power(max(ly) FILTER (WHERE lc >= 0.5) - min(ly) FILTER (WHERE lc >= 0.5), 2)),
    sqrt(power(max(rx) FILTER (WHERE rc >= 0.5) - min(rx) FILTER (WHERE rc >= 0.5), 2) + power(max(ry) FILTER (WHERE rc >= 0.5) - min(ry) FILTER (WHERE rc >= 0.5), 2))) AS size FROM hands GROUP BY clip, frame),
nb AS (SELECT *, lag(r) OVER w AS r0, lead(r) OVER w AS r1, lag(l) OVER w AS l0, lead(l) OVER w AS l1 FROM arm WINDOW w AS (PARTITION BY clip ORDER BY frame)),
dup AS (SELECT clip, frame, CASE WHEN r THEN 'left' ELSE 'right' END AS side FROM nb JOIN h USING (clip, frame)
  WHERE r <> l AND n >= 3 AND m / size < 0.6 AND CASE WHEN r THEN coalesce(NOT l0, false) OR coalesce(NOT l1, false) ELSE coalesce(NOT r0, false) OR coalesce(NOT r1, false) END)"""


@query(_DUP + " SELECT clip, frame, side FROM dup")
def hand_duplicate(spark, d):
    return draw.duplicate_hands(v.parts(spark, d))


_BACK = f"""bk AS (SELECT p.clip, p.frame FROM (SELECT clip, frame, max(x) FILTER (WHERE j = 5) < max(x) FILTER (WHERE j = 2) AS behind, bool_or(c >= 0.5 AND j IN (0, 14, 15)) AS seen FROM kp GROUP BY 1, 2) p
  JOIN (SELECT clip, frame, avg(c) FILTER (WHERE j BETWEEN 1 AND 17) AS jaw FROM face GROUP BY 1, 2) f ON f.clip = p.clip AND f.frame = p.frame WHERE behind AND seen AND jaw < 0.835e0)"""


@query(f"WITH {v.KP_SQL}, {v.FACE_SQL}, {_BACK} SELECT clip, frame FROM bk")
def face_back_view(spark, d):
    return draw.back_view_faces(v.parts(spark, d))


_LONG = """ar AS (SELECT k.clip, k.frame, CASE WHEN k.j = 3 THEN 'right' ELSE 'left' END AS side, sqrt(power(k.x - w.x, 2) + power(k.y - w.y, 2)) AS n FROM kp k JOIN kp w ON w.clip = k.clip AND w.frame = k.frame AND w.j = k.j + 1 WHERE k.j IN (3, 6) AND k.c >= 0.5 AND w.c >= 0.5),
ov AS (SELECT clip, frame, side FROM (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY clip, side) AS m FROM ar) WHERE n > 1.4e0 * m)"""

_MIRROR = f"""{_pts(0, 1, 2, 3, 4, 5, 6, 7, 8, 11).replace("pt AS", "pm AS", 1)}, mi AS (SELECT clip, frame, CASE WHEN c3 + c4 < c6 + c7 THEN 'right' ELSE 'left' END AS side FROM (SELECT *, greatest({_dist(2, 5)}, {_dist(8, 11)}, 1.5e0 * {_dist(1, 0)}, 1e0) * 0.2e0 AS reach FROM pm)
  WHERE {_dist(3, 6)} < reach AND {_dist(4, 7)} < reach AND c3 + c4 <> c6 + c7 AND ((c3 >= 0.5 AND c4 >= 0.5 AND (c6 >= 0.5 OR c7 >= 0.5)) OR (c6 >= 0.5 AND c7 >= 0.5 AND (c3 >= 0.5 OR c4 >= 0.5))))"""


@query(f"""{_DUP}, {v.FACE_SQL}, {_BACK}, {_LONG}, {_MIRROR}, a AS (SELECT clip, frame, 'limb_dedup' AS rule, side, false AS arm FROM dup UNION ALL SELECT clip, frame, 'limb_dedup', side, true FROM mi UNION ALL SELECT clip, frame, 'forearm_rule', side, false FROM ov UNION ALL SELECT clip, frame, 'back_view_face', 'head', false FROM bk),
b AS (SELECT DISTINCT clip, frame, unnest(CASE WHEN rule = 'back_view_face' THEN [0, 14, 15] WHEN rule = 'forearm_rule' THEN [CASE WHEN side = 'left' THEN 7 ELSE 4 END] WHEN arm AND side = 'left' THEN [6, 7] WHEN arm THEN [3, 4] ELSE [] END) AS j FROM a)
SELECT clip, frame, coalesce((SELECT string_agg(j::VARCHAR, ',' ORDER BY j) FROM b WHERE b.clip = a.clip AND b.frame = a.frame), '') AS body, coalesce(string_agg(DISTINCT CASE WHEN side <> 'head' THEN side END, ',' ORDER BY CASE WHEN side <> 'head' THEN side END), '') AS hands,
  count(DISTINCT rule) AS rules FROM a GROUP BY clip, frame""")
def draw_hidden(spark, d):
    p = v.parts(spark, d)
    found = draw.hidden_parts(draw.duplicate_hands(p), pose.mirrored_arms(p), pose.overlong_forearms(p, 1.4), draw.back_view_faces(p))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("clip", "frame", text("body").alias("body"), text("hands").alias("hands"), F.size("rules").cast("long").alias("rules"))


_KEYS = ", ".join(f"({k}, {j})" for k, j in enumerate(draw.KEY_POINTS))


@query(f"""WITH {v.KP_SQL}, k(place, j) AS (VALUES {_KEYS}), p AS (SELECT clip, place, trunc(x)::BIGINT AS x, trunc(y)::BIGINT AS y FROM kp JOIN k USING (j) WHERE frame = 0 AND c >= 0.5),
g AS (SELECT clip, string_agg('{{"x": ' || x || ', "y": ' || y || '}}', ', ' ORDER BY place) AS t FROM p WHERE x >= 0 AND x < 1280 AND y >= 0 AND y < 720 GROUP BY clip)
SELECT clip, '[' || coalesce(t, '') || ']' AS points FROM (SELECT DISTINCT clip FROM kp) LEFT JOIN g USING (clip)""")
def key_points_json(spark, d):
    return draw.key_points_json(v.pose(spark, d), W, H)


_WHOLE = ", ".join(f"({k}, {'NULL' if j is None else j})" for k, j in enumerate(draw.whole_from_70()))
_WHOLE_SQL = f"WITH {v.FACE_SQL}, ix(k, j) AS (VALUES {_WHOLE}), wb AS (SELECT f.clip, f.frame, k, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(c, 0) AS c FROM (SELECT DISTINCT clip, frame FROM face) f CROSS JOIN ix LEFT JOIN face USING (clip, frame, j))"


@query(f"{_WHOLE_SQL} SELECT clip, frame, k::BIGINT AS point, round(x, 6) AS x, round(y, 6) AS y, round(c, 6) AS c FROM wb")
def coco_remap(spark, d):
    p = v.parts(spark, d).select("clip", "frame", F.posexplode(draw.whole_body(F.col("points"))).alias("point", "p"))
    return rounded(p.select("clip", "frame", F.col("point").cast("long").alias("point"), "p.x", "p.y", "p.c"), "x", "y", "c")


_PAIRS = ", ".join(f"('body', {j}, {a}, {b})" for j, (a, b) in enumerate(zip(draw.BODY_FIRST, draw.BODY_SECOND, strict=True)))
_PAIRS += "".join(f", ('{k}', {j}, {first + j}, {first + j})" for k, (first, n) in draw.PARTS.items() for j in range(n))


@query(f"""{_WHOLE_SQL}, pr(part, point, a, b) AS (VALUES {_PAIRS}), ls AS (SELECT clip, frame, list({{'x': x, 'y': y, 'c': c}} ORDER BY k) AS p FROM wb GROUP BY 1, 2)
SELECT clip, frame, part, point::BIGINT AS point, round((p[a + 1].x + p[b + 1].x) / 2, 6) AS x, round((p[a + 1].y + p[b + 1].y) / 2, 6) AS y, round((p[a + 1].c + p[b + 1].c) / 2, 6) AS c FROM ls CROSS JOIN pr""")
def aa_split(spark, d):
    df = v.parts(spark, d).select("clip", "frame", draw.whole_body(F.col("points")).alias("p"))
    parts = F.array(*[F.struct(F.lit(k).alias("part"), a.alias("points")) for k, a in draw.body_layout(F.col("p")).items()])
    df = df.select("clip", "frame", F.explode(parts).alias("s")).select("clip", "frame", "s.part", F.posexplode("s.points").alias("point", "p"))
    return rounded(df.select("clip", "frame", "part", F.col("point").cast("long").alias("point"), "p.x", "p.y", "p.c"), "x", "y", "c")


# ---------------------------------------------------------------- planning


@query(f"WITH {v.VIDEO_SQL} SELECT video_id, count(*) AS frames, min(i)::BIGINT AS first, max(i)::BIGINT AS last FROM video, range(1100) t(i) WHERE i >= 10 AND i < 10 + (frames - 11) // 4 * 4 + 1 GROUP BY video_id")
def loaded_frames(spark, d):
    # the videos are few bytes and their frames are not: they are dealt out before they grow, to tasks that aren't put together again
    videos = v.videos(spark, d).select("video_id", F.col("frames").alias("n")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id")
    kept = videos.select("video_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("out")).withColumn("frame", F.col("out"))
    return sequence.loaded_frames(kept, 11, None, 4).groupBy("video_id").agg(F.count("*").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


@query(f"""WITH {v.BOXES_SQL}, u AS (SELECT *, least(2e0, 704 / (x2 - x1), 1280 / (y2 - y1)) AS used FROM boxes WHERE score >= 0), s AS (SELECT *, round_even(704 / used, 0) AS w, round_even(1280 / used, 0) AS h FROM u),
p AS (SELECT *, round_even((x1 + x2) / 2 - w / 2, 0) AS x, round_even(y1 - least(greatest(h - (y2 - y1), 0) / 2, 0.4e0 * (y2 - y1)), 0) AS y FROM s)
SELECT clip, frame, least(greatest(x, least(0, 1280 - w)), greatest(0, 1280 - w))::BIGINT AS x, least(greatest(y, least(0, 720 - h)), greatest(0, 720 - h))::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h, round(used, 6) AS used FROM p""")
def face_crop_window(spark, d):
    return rounded(sequence.face_window(v.boxes(spark, d).where("score >= 0"), (W, H), (704, 1280), 2.0), "used")


# ---------------------------------------------------------------- masks


def _bounds(n: int) -> str:
    m = n
    for _ in range(3):
        m = (m + 1) // 2
    return ", ".join(f"({i}, {i * n // m}, {-(-(i + 1) * n // m)})" for i in range(m))


@query(f"""{_GROWN}, h AS (SELECT clip, frame, x // 2 AS x, y // 2 AS y FROM g GROUP BY 1, 2, 3, 4 HAVING count(*) = 4), bx(i, a, b) AS (VALUES {_bounds(MW // 2)}), by_(k, a, b) AS (VALUES {_bounds(MH // 2)})
SELECT clip, frame, i::BIGINT AS x, k::BIGINT AS y FROM h JOIN bx ON x >= bx.a AND x < bx.b JOIN by_ ON y >= by_.a AND y < by_.b GROUP BY clip, frame, i, k, bx.a, bx.b, by_.a, by_.b HAVING count(*) >= 0.5 * (bx.b - bx.a) * (by_.b - by_.a)""")
def mask_cells(spark, d):
    return masks.cells(masks.dilate(v.mask_px(spark, d), 3, MW, MH), MW, MH)


@query(f"""WITH {v.MASK_SQL}, {v.KP_SQL}, s AS (SELECT clip, frame, trunc(greatest(0, least(47, x * 48 / 1280)))::BIGINT AS x, trunc(greatest(0, least(49, y * 50 / 720)))::BIGINT AS y, c >= 0.5 AS sure FROM kp)
SELECT s.clip, s.frame, round(coalesce(avg(CASE WHEN sure THEN CASE WHEN px.x IS NULL THEN 0e0 ELSE 1e0 END END), 1), 6) AS recall FROM s LEFT JOIN px ON px.clip = s.clip AND px.frame = s.frame AND px.x = s.x AND px.y = s.y GROUP BY 1, 2""")
def keypoint_recall(spark, d):
    p = v.pose(spark, d).select("clip", "frame", F.explode("body").alias("p")).select("clip", "frame", (F.col("p.x") * MW / W).alias("x"), (F.col("p.y") * MH / H).alias("y"), "p.c")
    return rounded(masks.keypoint_recall(v.mask_px(spark, d), p, MW, MH), "recall")


@query(f"""WITH {v.MASK_SQL}, c AS (SELECT l_suppkey % 3 AS clip, l_orderkey % 64 AS frame, l_partkey % 48 AS x, l_quantity::BIGINT - 1 AS y, l_quantity / 50e0 AS r FROM lineitem)
SELECT c.clip, c.frame, count(*) AS pixels, count(px.x) AS painted, round(avg(CASE WHEN px.x IS NULL THEN r ELSE 0 END), 6) AS r FROM c LEFT JOIN px ON px.clip = c.clip AND px.frame = c.frame AND px.x = c.x AND px.y = c.y GROUP BY 1, 2""")
def mask_paint(spark, d):
    c = v.table(spark, d, "lineitem").selectExpr("l_suppkey % 3 AS clip", "l_orderkey % 64 AS frame", "l_partkey % 48 AS x", "CAST(l_quantity AS BIGINT) - 1 AS y", "l_quantity / 50 AS r", "1D AS g", "1D AS b")
    p = masks.paint(c, v.mask_px(spark, d))
    return rounded(p.groupBy("clip", "frame").agg(F.count("*").alias("pixels"), F.count(F.when(F.col("g") == 0, 1)).alias("painted"), F.avg("r").alias("r")), "r")


@query(f"""WITH {v.MASK_SQL}, n AS (SELECT clip, count(*) FILTER (WHERE frame = 0 AND (x IN (0, 47) OR y IN (0, 49))) AS on_ FROM px GROUP BY clip)
SELECT clip, CASE WHEN 192 - on_ > 96 THEN CASE WHEN clip % 2 = 0 THEN 'replacement' ELSE 'animation' END END AS mode FROM n""")
def mask_convention(spark, d):
    px = v.mask_px(spark, d)
    at = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    grid = px.select("clip").distinct().select("clip", F.explode(at(MW)).alias("x")).select("clip", "x", F.explode(at(MH)).alias("y"))
    on = px.where("frame = 0").select("clip", "x", "y", F.lit(1).alias("on"))
    back = (F.col("clip") % 2 == 0).cast("double")
    other = F.when(F.col("on").isNotNull(), 0.0).otherwise(back)
    coloured = grid.join(on, ["clip", "x", "y"], "left").select("clip", "x", "y", other.alias("r"), other.alias("g"), F.when(F.col("on").isNotNull(), 1.0).otherwise(back).alias("b"))
    return masks.convention(coloured, MW, MH, {"animation": "black", "replacement": "white"})


#: Holes of one or two pixels, which is all that a hundredth of a mask of under 300 pixels can be.
_HOLES = f"""ar AS (SELECT clip, frame, count(*) AS n FROM px GROUP BY 1, 2), bg AS (SELECT clip, frame, x, y FROM (SELECT clip, frame, a.x, c.y FROM ar, range({MW}) a(x), range({MH}) c(y)) ANTI JOIN px USING (clip, frame, x, y)),
st(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), nb AS (SELECT bg.clip, bg.frame, bg.x, bg.y, count(px.x) AS on_ FROM bg CROSS JOIN st LEFT JOIN px ON px.clip = bg.clip AND px.frame = bg.frame AND px.x = bg.x + dx AND px.y = bg.y + dy
  WHERE bg.x BETWEEN 1 AND {MW - 2} AND bg.y BETWEEN 1 AND {MH - 2} GROUP BY 1, 2, 3, 4), h1 AS (SELECT * FROM nb WHERE on_ = 4),
h2 AS (SELECT a.* FROM nb a JOIN nb b ON a.clip = b.clip AND a.frame = b.frame AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE a.on_ = 3 AND b.on_ = 3),
fp AS (SELECT clip, frame, x, y FROM px UNION SELECT clip, frame, x, y FROM h1 JOIN ar USING (clip, frame) WHERE 1 <= 0.01e0 * n UNION SELECT clip, frame, x, y FROM h2 JOIN ar USING (clip, frame) WHERE 2 <= 0.01e0 * n)"""


@query(f"WITH RECURSIVE {v.MASK_SQL}, {_HOLES}, {labelled('fp', True)} SELECT p.clip, p.frame, sum(p.area)::BIGINT AS area FROM pc p JOIN pc m ON m.clip = p.clip AND m.frame = p.frame AND m.piece = 0 WHERE p.area >= 0.2e0 * m.area GROUP BY 1, 2")
def mask_clean(spark, d):
    return masks.clean(v.mask_px(spark, d), MW, MH, 0.01, 0.2).groupBy("clip", "frame").agg(F.count("*").alias("area"))


@query(f"""WITH RECURSIVE {v.MASK_SQL}, {labelled('px', True)} SELECT p.clip, p.frame, round(p.area / m.area::DOUBLE, 4) AS share FROM pc p JOIN pc m ON m.clip = p.clip AND m.frame = p.frame AND m.piece = 0
WHERE p.piece > 0 AND round(p.area / m.area::DOUBLE, 4) >= 0.01e0 AND NOT (p.x0 = 0 AND m.x0 = 0 OR p.y0 = 0 AND m.y0 = 0 OR p.x1 = {MW} AND m.x1 = {MW} OR p.y1 = {MH} AND m.y1 = {MH})""")
def mask_fragments(spark, d):
    return masks.fragments(v.mask_px(spark, d), MW, MH)


# ---------------------------------------------------------------- guards


def _frames(spark, d) -> DataFrame:
    """Boxes, envelopes and poses scaled to the masks' canvas, of the clips that have all."""
    fx, fy = MW / W, MH / H
    b = v.boxes(spark, d).withColumns({c: F.col(c) * (fx if c[0] == "x" else fy) for c in bx.CORNERS})
    p = v.pose(spark, d).select("clip", "frame", F.transform("body", lambda p: F.struct((p["x"] * fx).alias("x"), (p["y"] * fy).alias("y"), p["c"].alias("c"))).alias("body"))
    return bx.envelope(b, MW, MH).join(p, ["clip", "frame"])


_MASK_GUARD = f"""WITH {v.BOXES_SQL}, {v.KP_SQL}, {v.MASK_SQL}, sb AS (SELECT clip, frame, score, x1 * 0.0375e0 AS x1, y1 * (50e0 / 720e0) AS y1, x2 * 0.0375e0 AS x2, y2 * (50e0 / 720e0) AS y2 FROM boxes),
g AS (SELECT *, CASE WHEN score > 0 THEN greatest(0e0, x1 - 0.1e0 * greatest(x2 - x1, 1e0)) END AS a, CASE WHEN score > 0 THEN greatest(0e0, y1 - 0.1e0 * greatest(y2 - y1, 1e0)) END AS b, CASE WHEN score > 0 THEN least(48e0, x2 + 0.1e0 * greatest(x2 - x1, 1e0)) END AS c, CASE WHEN score > 0 THEN least(50e0, y2 + 0.1e0 * greatest(y2 - y1, 1e0)) END AS e FROM sb),
en AS (SELECT *, trunc(coalesce(min(a) OVER w, 0)) AS ex1, trunc(coalesce(min(b) OVER w, 0)) AS ey1, trunc(coalesce(max(c) OVER w, 48)) AS ex2, trunc(coalesce(max(e) OVER w, 50)) AS ey2 FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
sure AS (SELECT clip, frame, count(*) FILTER (WHERE c >= 0.5) AS n, avg(c) FILTER (WHERE c >= 0.5) AS m FROM kp GROUP BY 1, 2), fr AS (SELECT en.*, greatest(x2 - x1, 1) AS bw, greatest(y2 - y1, 1) AS bh, score > 0 AND n >= 8 AND coalesce(m, 0) >= 0.5 AS ok FROM en JOIN sure USING (clip, frame)),
ar AS (SELECT fr.clip, fr.frame, count(px.x) AS area, count(px.x) FILTER (WHERE px.x >= ex1 AND px.x < ex2 AND px.y >= ey1 AND px.y < ey2) AS ins FROM fr LEFT JOIN px ON px.clip = fr.clip AND px.frame = fr.frame GROUP BY 1, 2),
nm(j, name) AS (VALUES (0, 'nose'), (14, 'r_eye'), (15, 'l_eye'), (16, 'r_ear'), (17, 'l_ear')), hd AS (SELECT fr.clip, fr.frame, j, name, trunc(x * 0.0375e0) AS hx, trunc(y * (50e0 / 720e0)) AS hy FROM kp JOIN nm USING (j) JOIN fr ON fr.clip = kp.clip AND fr.frame = kp.frame WHERE kp.c >= 0.5 AND x >= 0 AND x < 1280 AND y >= 0 AND y < 720),
ho AS (SELECT clip, frame, j, name FROM hd JOIN ar USING (clip, frame) WHERE area > 0 AND NOT EXISTS (SELECT 1 FROM px WHERE px.clip = hd.clip AND px.frame = hd.frame AND abs(px.x - hx) <= 1 AND abs(px.y - hy) <= 1)),
ms AS (SELECT fr.clip, fr.frame, ok, area, area / (bw * bh) AS to_box, CASE WHEN area > 0 THEN (area - ins) / area::DOUBLE ELSE 0 END AS outside, coalesce(h.names, '') AS head_out, coalesce(h.nose, false) AS nose, coalesce(h.n, 0) AS others FROM fr JOIN ar USING (clip, frame)
  LEFT JOIN (SELECT clip, frame, string_agg(name, ',' ORDER BY j) AS names, bool_or(j = 0) AS nose, count(*) FILTER (WHERE j > 0) AS n FROM ho GROUP BY 1, 2) h ON h.clip = fr.clip AND h.frame = fr.frame),
mf AS (SELECT clip, 'mask_empty' AS "check", frame FROM ms WHERE ok AND (area = 0 OR to_box < 0.15e0) UNION ALL SELECT clip, 'mask_leak', frame FROM ms WHERE ok AND area > 0 AND to_box >= 0.15e0 AND outside > 0.1e0 UNION ALL SELECT clip, 'mask_head_out', frame FROM ms WHERE area > 0 AND (nose OR others >= 2))"""


@query(_MASK_GUARD + " SELECT clip, frame, round(area / 2400e0, 6) AS mask_area, round(to_box, 6) AS mask_to_box, ok AS box_reliable, round(outside, 6) AS outside, head_out FROM ms")
def guard_mask_measures(spark, d):
    m = guards.mask_measures(_frames(spark, d), v.mask_px(spark, d), MW, MH)
    return rounded(m.withColumn("head_out", F.array_join("head_out", ",")), "mask_area", "mask_to_box", "outside")


@query(_MASK_GUARD + ' SELECT clip, "check", frame FROM mf')
def guard_mask_flags(spark, d):
    return guards.mask_flags(guards.mask_measures(_frames(spark, d), v.mask_px(spark, d), MW, MH))


@query(f"""WITH RECURSIVE {v.COARSE_SQL}, {v.TORN_SQL}, fr AS (SELECT clip, frame FROM px GROUP BY 1, 2), a AS (SELECT clip, frame, count(*) AS n FROM big WHERE clip < 3 GROUP BY 1, 2)
SELECT clip, 'no_driving_person' AS "check", frame FROM fr WHERE clip = 3 UNION ALL SELECT clip, 'driving_empty', frame FROM fr LEFT JOIN a USING (clip, frame) WHERE clip < 3 AND n IS NULL UNION ALL SELECT clip, 'driving_fragmented', frame FROM tn WHERE clip < 3 AND torn""")
def guard_driving_flags(spark, d):
    """The last clip has nobody; the others have whole, torn and empty frames."""
    coarse = v.coarse_px(spark, d).where("clip < 3")
    every = v.mask_px(spark, d).select("clip", "frame").distinct()
    areas = every.join(masks.areas(coarse).select("clip", "frame", "area"), ["clip", "frame"], "left").withColumn("area", F.coalesce("area", F.lit(0)))
    return guards.driving_flags(areas, masks.fragments(coarse, MW, MH), posed=False)


def _report_sql(flags: str, title: str, missed: str = "") -> str:
    """The report of the flags fl (clip, check, frame) over the clips fn (clip, n)."""
    kind = "CASE WHEN \"check\" IN ('pose_jump', 'pose_spike', 'subject_switch', 'mask_leak') THEN 'warning' ELSE 'fail' END"
    order = "CASE \"check\" " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(guards.CHECKS)) + " END"
    return f"""{flags}, r AS (SELECT clip, "check", min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT *, frame - row_number() OVER (PARTITION BY clip, "check" ORDER BY frame) AS g FROM fl) GROUP BY clip, "check", g),
tx AS (SELECT clip, "check", sum(n)::BIGINT AS n, min(first) AS seen, max(n) AS longest, string_agg(CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END, ', ' ORDER BY first) AS frames FROM r GROUP BY clip, "check"),
ln AS (SELECT clip, string_agg(chr(10) || '- ' || "check" || ' (' || {kind} || '): ' || n || ' frame(s), longest run ' || longest || ': ' || frames{missed}, '' ORDER BY seen, {order}) AS lines FROM tx GROUP BY clip),
bad AS (SELECT clip, count(DISTINCT "check") AS checks, count(DISTINCT frame) AS frames FROM fl WHERE {kind} = 'fail' GROUP BY clip)
SELECT clip, coalesce(checks, 0) = 0 AS passed, '{title}: ' || CASE WHEN coalesce(checks, 0) > 0 THEN 'FAILED' ELSE 'passed' END || ' - ' || coalesce(checks, 0) || ' check(s) failed on ' || coalesce(bad.frames, 0) || '/' || fn.n || ' frames' || coalesce(lines, '') AS report
FROM fn LEFT JOIN ln USING (clip) LEFT JOIN bad USING (clip)"""


@query(_report_sql(_FLAGS + ", fn AS (SELECT clip, count(*) AS n FROM q GROUP BY clip)", "Pose guard"))
def guard_report(spark, d):
    m = _measures(spark, d)
    return guards.report(guards.pose_flags(m), m.groupBy("clip").agg(F.count("*").alias("n")), "Pose guard", set())


_MISSED = """ || CASE WHEN "check" = 'mask_head_out' THEN ' | missed: ' || (SELECT string_agg(name || ' x' || k, ', ' ORDER BY k DESC, f, j) FROM (SELECT name, count(*) AS k, min(ho.frame) AS f, min(j) AS j FROM ho JOIN fl z ON z.clip = ho.clip AND z.frame = ho.frame AND z."check" = 'mask_head_out' WHERE ho.clip = tx.clip GROUP BY name)) ELSE '' END"""


@query(_report_sql(_MASK_GUARD + ", fl AS (SELECT * FROM mf), fn AS (SELECT clip, count(*) AS n FROM fr GROUP BY clip)", "Mask guard", _MISSED))
def guard_mask_report(spark, d):
    m = guards.mask_measures(_frames(spark, d), v.mask_px(spark, d), MW, MH)
    names = m.select("clip", F.lit("mask_head_out").alias("check"), "frame", F.posexplode("head_out").alias("place", "name"))
    return guards.report(guards.mask_flags(m), m.groupBy("clip").agg(F.count("*").alias("n")), "Mask guard", {"mask_empty", "mask_head_out"}, names)


_BOTH = _MASK_GUARD + ", " + _FLAGS.replace(f"WITH {v.BOXES_SQL}, ", "", 1).replace(f"{v.KP_SQL}, ", "", 1).replace("fl AS (", "pf AS (", 1)
_BOTH += """, fl AS (SELECT pf.clip, pf."check", pf.frame FROM pf JOIN fr ON fr.clip = pf.clip AND fr.frame = pf.frame UNION ALL SELECT * FROM mf),
fn AS (SELECT clip, count(*) AS n FROM fr GROUP BY clip)"""


@query(_report_sql(_BOTH, "Preprocess guard"))
def guard_combine(spark, d):
    """Both guards over the frames that have a box and a pose; combine raises where one of them lacks a frame."""
    frames = _frames(spark, d)
    own = _measures(spark, d).join(frames.select("clip", "frame"), ["clip", "frame"], "left_semi")
    mask = guards.mask_measures(frames, v.mask_px(spark, d), MW, MH).join(own.select("clip", "frame", "box_iou_prev"), ["clip", "frame"])
    both = guards.combine(own, mask, ["box_iou_prev"])
    flags = guards.pose_flags(both).unionByName(guards.mask_flags(both))
    return guards.report(flags, both.groupBy("clip").agg(F.count("*").alias("n")), "Preprocess guard", {"mask_empty", "mask_head_out"})

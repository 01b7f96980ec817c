"""Queries of the tracker's prompts, anchors and memory, of lost limbs and regions, and of references and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplane.operators import depths, guards, leaks, losses, masks, repairs, sequence, tracking
from cliplane.plans.catalog import _dist, _pts, query, rounded
from cliplane.plans.guard_catalog import _frames
from cliplane.sources import views as v

W, H, MW, MH = v.WIDTH, v.HEIGHT, 48, 50
_FX, _FY = "0.0375e0", "(50e0 / 720e0)"

# ---------------------------------------------------------------- prompts

_PROMPT = ", ".join(str(j) for j in tracking.PROMPTS)
_BETWEEN = ", ".join(f"({a}, {b})" for a, b in tracking.BETWEEN)
_POSITIVE = f"""{_pts(2, 5, 8, 11)}, tp AS (SELECT *, (x2 + x5) / 2 AS sx, (y2 + y5) / 2 AS sy, CASE WHEN c8 >= 0.5 AND c11 >= 0.5 THEN (x8 + x11) / 2 WHEN c8 >= 0.5 THEN x8 WHEN c11 >= 0.5 THEN x11 END AS hx,
  CASE WHEN c8 >= 0.5 AND c11 >= 0.5 THEN (y8 + y11) / 2 WHEN c8 >= 0.5 THEN y8 WHEN c11 >= 0.5 THEN y11 END AS hy FROM pt WHERE c2 >= 0.5 AND c5 >= 0.5),
po AS (SELECT clip, frame, x, y FROM kp WHERE c >= 0.5 AND j IN ({_PROMPT})
  UNION ALL SELECT clip, frame, CASE WHEN hx IS NULL THEN sx ELSE sx + (CASE k WHEN 1 THEN 0.35e0 ELSE 0.65e0 END) * (hx - sx) END, CASE WHEN hx IS NULL THEN least(sy + k * CASE WHEN x2 = x5 THEN 192e0 ELSE abs(x2 - x5) END, 712.8e0) ELSE sy + (CASE k WHEN 1 THEN 0.35e0 ELSE 0.65e0 END) * (hy - sy) END FROM tp, range(1, 3) t(k)
  UNION ALL SELECT p.clip, p.frame, (p.x + q.x) / 2, (p.y + q.y) / 2 FROM (VALUES {_BETWEEN}) l(a, b) JOIN kp p ON p.j = a JOIN kp q ON q.j = b AND q.clip = p.clip AND q.frame = p.frame WHERE p.c >= 0.5 AND q.c >= 0.5)"""


@query(f"WITH {v.KP_SQL}, {_POSITIVE} SELECT k.clip, k.frame, count(po.x) AS points, round(coalesce(sum(po.x / 1280 * 1008), 0), 6) AS x, round(coalesce(sum(po.y / 720 * 1008), 0), 6) AS y FROM (SELECT DISTINCT clip, frame FROM kp) k LEFT JOIN po USING (clip, frame) GROUP BY 1, 2")
def prompt_points(spark, d):
    p = v.pose(spark, d).withColumn("p", tracking.to_square(tracking.positive_points(W, H), W, H))
    total = lambda c: F.round(F.aggregate("p", F.lit(0.0), lambda a, q: a + q[c]), 6).alias(c)
    return p.select("clip", "frame", F.size("p").cast("long").alias("points"), total("x"), total("y"))


@query(f"""WITH {v.KP_SQL}, {_POSITIVE}, {v.BOXES_SQL}, bd AS (SELECT clip, frame, 0.04e0 * sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS reach FROM boxes WHERE frame % 3 = 0)
SELECT clip, frame, count(*) AS points FROM po LEFT JOIN bd USING (clip, frame) WHERE reach IS NULL OR sqrt(power(x - 640, 2) + power(y - 360, 2)) > reach GROUP BY 1, 2""")
def prompt_hand_clearance(spark, d):
    b = v.boxes(spark, d)
    p = v.pose(spark, d).select("clip", "frame", F.posexplode(tracking.positive_points(W, H)).alias("place", "p")).select("clip", "frame", "place", F.lit(1).alias("label"), "p.x", "p.y")
    hand = b.where("frame % 3 = 0").select("clip", "frame", F.lit(0).alias("label"), F.lit(640.0).alias("x"), F.lit(360.0).alias("y"))
    return tracking.clear_of_hand(p, hand, b).groupBy("clip", "frame").agg(F.count("*").alias("points"))


@query(f"""WITH {v.BOXES_SQL}, {v.MASK_SQL}, sb AS (SELECT clip, frame, trunc(greatest(0, least(x1 * {_FX}, 48)))::BIGINT AS x1, trunc(greatest(0, least(y1 * {_FY}, 50)))::BIGINT AS y1, trunc(greatest(0, least(x2 * {_FX}, 48)))::BIGINT AS x2, trunc(greatest(0, least(y2 * {_FY}, 50)))::BIGINT AS y2 FROM boxes WHERE score > 0),
b AS (SELECT *, trunc(0.08e0 * sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))) AS r FROM sb WHERE x2 - x1 >= 8 AND y2 - y1 >= 8), m AS (SELECT b.clip, b.frame, px.x, px.y FROM b JOIN px ON px.clip = b.clip AND px.frame = b.frame - 1 AND px.x >= x1 AND px.x < x2 AND px.y >= y1 AND px.y < y2),
fr AS (SELECT b.*, x, y FROM b, range(48) a(x), range(50) c(y) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 AND EXISTS (SELECT 1 FROM m WHERE m.clip = b.clip AND m.frame = b.frame) AND NOT EXISTS (SELECT 1 FROM m WHERE m.clip = b.clip AND m.frame = b.frame AND power(m.x - a.x, 2) + power(m.y - c.y, 2) <= r * r)),
ce AS (SELECT fr.*, i, k, row_number() OVER (PARTITION BY clip, frame, i, k ORDER BY y, x) - 1 AS n, count(*) OVER (PARTITION BY clip, frame, i, k) AS of FROM fr, range(3) p(i), range(3) q(k) WHERE x - x1 >= i * (x2 - x1) // 3 AND x - x1 < (i + 1) * (x2 - x1) // 3 AND y - y1 >= k * (y2 - y1) // 3 AND y - y1 < (k + 1) * (y2 - y1) // 3),
pk AS (SELECT *, (row_number() OVER (PARTITION BY clip, frame ORDER BY k, i) - 1)::BIGINT AS place FROM ce WHERE n = of // 2) SELECT clip, frame, place, x, y FROM pk WHERE place < 8""")
def prompt_background(spark, d):
    fx, fy = MW / W, MH / H
    b = v.boxes(spark, d).withColumns({c: F.col(c) * (fx if c[0] == "x" else fy) for c in ("x1", "y1", "x2", "y2")})
    return tracking.background_points(b, v.mask_px(spark, d), MW, MH, 8, 0.08)


@query("""SELECT p_partkey AS video_id, (CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END)::BIGINT AS points, (CASE p_partkey % 4 WHEN 2 THEN p_size + p_partkey % 100 WHEN 3 THEN 640 ELSE 0 END)::DOUBLE AS x, (CASE p_partkey % 4 WHEN 2 THEN 17.5e0 WHEN 3 THEN 180 ELSE 0 END)::DOUBLE AS y FROM part""")
def prompt_parse(spark, d):
    listed = F.format_string('[{"x": %d, "y": 10.5}, {"x": %d, "y": 7}]', "p_size", F.col("p_partkey") % 100)
    text = F.when(F.col("p_partkey") % 4 == 1, " ").when(F.col("p_partkey") % 4 == 2, listed).when(F.col("p_partkey") % 4 == 3, '{"points": [[0.5, 0.25]]}')
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("video_id"), tracking.parse_points(text, W, H).alias("p"))
    total = lambda c: F.aggregate("p", F.lit(0.0), lambda a, q: a + q[c]).alias(c)
    return p.select("video_id", F.size("p").cast("long").alias("points"), total("x"), total("y"))


@query(f"WITH {v.BOXES_SQL}, {v.KP_SQL}, s AS (SELECT clip, frame, count(*) FILTER (WHERE c >= 0.5) AS n, avg(c) FILTER (WHERE c >= 0.5) AS m FROM kp GROUP BY 1, 2) SELECT clip, frame, n AS sure_points, score > 0 AND n >= greatest(8, 0.9e0 * 11) AND coalesce(m, 0) >= 0.5 AS is_anchor FROM s JOIN boxes USING (clip, frame)")
def anchor_frames(spark, d):
    return tracking.anchors(v.boxes(spark, d), v.pose(spark, d), reference=11)


# ---------------------------------------------------------------- detections and tracks


@query(f"WITH {v.OVERLAP_SQL} SELECT clip, frame, track, min(detection) AS detection FROM ov WHERE score >= 0.3 AND overlap >= 0.5 GROUP BY 1, 2, 3")
def anchors_shared(spark, d):
    return tracking.match_anchors(v.overlaps(spark, d), True, 0.3, 0.5)


@query(f"WITH {v.OVERLAP_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY clip, frame, detection ORDER BY overlap DESC, track) AS n FROM ov) SELECT clip, frame, track, max(detection) AS detection FROM b WHERE n = 1 AND score >= 0.3 AND overlap >= 0.5 GROUP BY 1, 2, 3")
def anchors_exclusive(spark, d):
    return tracking.match_anchors(v.overlaps(spark, d), False, 0.3, 0.5)


_OBJECTS = f"""WITH {v.MASK_SQL}, n AS (SELECT clip, frame, count(*) AS n FROM px GROUP BY 1, 2), io AS (SELECT p.frame, p.clip AS a, q.clip AS b, count(*)::DOUBLE / (any_value(na.n) + any_value(nb.n) - count(*)) AS iou FROM px p JOIN px q ON q.frame = p.frame AND q.x = p.x AND q.y = p.y AND q.clip > p.clip
  JOIN n na ON na.clip = p.clip AND na.frame = p.frame JOIN n nb ON nb.clip = q.clip AND nb.frame = q.frame GROUP BY 1, 2, 3)"""


@query(_OBJECTS + " SELECT frame, a, b, round(iou, 6) AS iou FROM io")
def object_iou(spark, d):
    return rounded(tracking.object_iou(v.mask_px(spark, d)), "iou")


@query(_OBJECTS + ", l AS (SELECT clip, frame, (clip * 7 + frame * 3) % 6 - 1 AS last FROM n) SELECT DISTINCT CASE WHEN p.last > q.last THEN a ELSE b END AS clip, io.frame FROM io JOIN l p ON p.frame = io.frame AND p.clip = a JOIN l q ON q.frame = io.frame AND q.clip = b WHERE iou >= 0.02e0 AND p.last > -1 AND q.last > -1 AND p.last <> q.last")
def object_give_way(spark, d):
    px = v.mask_px(spark, d)
    return tracking.give_way(px, px.selectExpr("clip", "frame", "(clip * 7 + frame * 3) % 6 - 1 AS last").distinct(), 0.02)


# ---------------------------------------------------------------- memory

_MEMORY = f"WITH {v.BOXES_SQL}, ms AS (SELECT clip, frame, avg(CASE WHEN g > 0 THEN (2 / (1 + exp(-g)) - 1) * greatest(score, 0) ELSE 0 END) AS score FROM (SELECT clip, frame, score, ((frame * 7 + clip + o * 5) % 11 - 6)::DOUBLE AS g FROM boxes, range(2) t(o)) GROUP BY 1, 2)"


def _memory(spark, d):
    return tracking.memory_score(v.boxes(spark, d).selectExpr("clip", "frame", "greatest(score, 0D) AS iou", "explode(array(0, 1)) AS o").selectExpr("clip", "frame", "iou", "CAST((frame * 7 + clip + o * 5) % 11 - 6 AS DOUBLE) AS logit"))


@query(_MEMORY + " SELECT clip, frame, round(score, 6) AS score FROM ms")
def memory_score(spark, d):
    return rounded(_memory(spark, d), "score")


@query(_MEMORY + """, p AS (SELECT m.clip, m.frame, s.frame AS t, row_number() OVER (PARTITION BY m.clip, m.frame ORDER BY s.frame DESC) AS n FROM ms m JOIN ms s ON s.clip = m.clip AND s.frame < m.frame AND s.frame > 0 AND s.score > 0.01e0),
u AS (SELECT clip, frame, t FROM p WHERE n <= 4 UNION SELECT clip, frame, frame - 1 FROM ms WHERE frame > 0) SELECT clip, frame, string_agg(t::VARCHAR, ',' ORDER BY t DESC) AS read FROM u GROUP BY 1, 2""")
def memory_frames(spark, d):
    m = _memory(spark, d)
    return tracking.memory_frames(m, m, 4).groupBy("clip", "frame").agg(F.array_join(F.reverse(F.array_sort(F.collect_list("t"))), ",").alias("read"))


@query(f"WITH {v.BOXES_SQL}, g AS (SELECT clip, frame AS t FROM boxes WHERE frame % 45 = 28) SELECT b.clip, b.frame, CASE WHEN min(abs(b.frame - t)) = 0 THEN 'refined' WHEN min(abs(b.frame - t)) <= 16 THEN 'demoted' ELSE 'kept' END AS state FROM boxes b LEFT JOIN g USING (clip) WHERE b.frame % 7 = 0 GROUP BY 1, 2")
def conditioning_demoted(spark, d):
    b = v.boxes(spark, d)
    return tracking.demote(b.where("frame % 7 = 0"), b.where("frame % 45 = 28"))


@query(f"WITH {v.BOXES_SQL}, c AS (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY frame) AS k, row_number() OVER (PARTITION BY clip ORDER BY frame DESC) AS r, count(*) OVER (PARTITION BY clip) AS n FROM boxes WHERE frame % 7 = 0) SELECT clip, frame FROM c WHERE n <= 4 OR k = 1 OR r <= 3")
def conditioning_kept(spark, d):
    return tracking.keep_conditioning(v.boxes(spark, d).where("frame % 7 = 0"), 4, True)


@query()
def annex_memory(spark, d):
    p = v.pose(spark, d).select("clip", "frame", F.explode("body").alias("p")).where("p.c >= 0.5")
    place = lambda c, n, full: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(f"p.{c}") * n / full)).cast("long").alias(c)
    px = v.mask_px(spark, d)
    return tracking.annexed(px, p.select("clip", "frame", place("x", MW, W), place("y", MH, H)), MW, MH, 0.02).groupBy("clip", "frame").agg(F.count("*").alias("pixels"))


# ---------------------------------------------------------------- losses

_HANGS = ", ".join(f"({j}, {o})" for js, part in losses.HANGS for j in js for o in part)
_LOSABLE = ", ".join(f"({k}, '{name}', {j})" for k, (name, js) in enumerate(losses.LOSABLE.items()) for j in js)
_LIMBS = f"""WITH {v.KP_SQL}, {v.HANDS_SQL}, {v.MASK_SQL}, al AS (SELECT clip, frame, j, x * {_FX} AS x, y * {_FY} AS y, c FROM kp UNION ALL SELECT clip, frame, j + 20, lx * {_FX}, ly * {_FY}, lc FROM hands WHERE lx * {_FX} >= 1 AND ly * {_FY} >= 1 UNION ALL SELECT clip, frame, j + 41, rx * {_FX}, ry * {_FY}, rc FROM hands WHERE rx * {_FX} >= 1 AND ry * {_FY} >= 1),
dr AS (SELECT clip, frame, j, trunc(x)::BIGINT AS x, trunc(y)::BIGINT AS y FROM al WHERE c >= 0.5 AND x >= 0 AND x < 48 AND y >= 0 AND y < 50), ds AS (SELECT dr.*, min(sqrt(power(px.x - dr.x, 2) + power(px.y - dr.y, 2))) OVER (PARTITION BY dr.clip, dr.frame, j) AS far, row_number() OVER (PARTITION BY dr.clip, dr.frame, j) AS n FROM dr JOIN px ON px.clip = dr.clip AND px.frame = dr.frame),
pt AS (SELECT * FROM ds WHERE n = 1), hg(j, o) AS (VALUES {_HANGS}), q AS (SELECT p.clip, p.frame, p.j FROM pt p JOIN hg USING (j) JOIN pt o ON o.clip = p.clip AND o.frame = p.frame AND o.j = hg.o WHERE p.far >= 3.36e0 GROUP BY 1, 2, 3 HAVING 10 * count(*) FILTER (WHERE o.far > 0) >= 9 * count(*)),
lm(k, name, j) AS (VALUES {_LOSABLE}), lo AS (SELECT clip, frame, k, name FROM q JOIN lm USING (j) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)"""


def _limbs_out(spark, d):
    moved = lambda c: F.transform(c, lambda p: F.struct((p["x"] * (MW / W)).alias("x"), (p["y"] * (MH / H)).alias("y"), p["c"].alias("c"))).alias(c)
    p = v.parts(spark, d).select("clip", "frame", *[moved(c) for c in ("body", "left_hand", "right_hand")])
    return losses.limbs_out(p, v.mask_px(spark, d), MW, MH, far=3.36)


@query(_LIMBS + " SELECT clip, frame, string_agg(name, ',' ORDER BY k) AS limbs, (SELECT count(*) FROM q JOIN lm USING (j) JOIN lo l USING (clip, frame, k) WHERE q.clip = lo.clip AND q.frame = lo.frame) AS points FROM lo GROUP BY 1, 2")
def limbs_out(spark, d):
    return _limbs_out(spark, d).select("clip", "frame", F.array_join("limbs", ",").alias("limbs"), F.size("points").cast("long").alias("points"))


def _lengths(spark, d):
    return v.table(spark, d, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("n"))


@query()
def mask_loss(spark, d):
    """Without a pose: closed runs alone."""
    return rounded(losses.mask_losses(v.figures(spark, d), _lengths(spark, d), 32, 24, grow=1, block=4), "mask_loss")


def _ending(spark, d):
    """Figures without a hand on the first frames of some clips and on the last ones of others, and their lengths."""
    n = _lengths(spark, d)
    gone = ((F.col("clip") % 4 == 1) & (F.col("frame") < 12) | (F.col("clip") % 4 == 2) & (F.col("frame") >= F.col("n") - 15))
    body = F.filter("on", lambda p: p % 32 < 10)
    return v.figures(spark, d).join(n, "clip").select("clip", "frame", F.when(gone, body).otherwise(F.col("on")).alias("on")), n


@query()
def mask_loss_posed(spark, d):
    """With a pose: limbs as evidence, and runs of any length that a clip begins or ends with."""
    px, n = _ending(spark, d)
    limbs = losses.limb_evidence(v.figure_pose(spark, d), 32, 24)
    return rounded(losses.mask_losses(px, n, 32, 24, grow=1, block=4, limbs=limbs), "mask_loss")


def _dropped(spark, d):
    px, n = _ending(spark, d)
    return px, n, losses.dropped_parts(px, n, 32, 24, losses.final_reader(1, 4))


@query()
def dropped_parts(spark, d):
    return rounded(_dropped(spark, d)[2].select("clip", "start", "length", "share", F.size("region").cast("long").alias("pixels")), "share")


@query()
def repair_frames(spark, d):
    """The frames to repair: points well inside every dropped part, and the frames around it that hold it."""
    px, _, parts = _dropped(spark, d)
    return _repaired(px, parts)


def _repaired(px, parts):
    births = px.groupBy("clip").agg(F.min("frame").alias("birth"))
    frames = repairs.region_frames(depths.regions_points(parts, 32, 24), births, px)
    return frames.select("clip", "frame", F.size("points").cast("long").alias("points"), repairs.held_words(F.col("holding")).alias("words"))


@query()
def repair_frames_posed(spark, d):
    """The frames to repair by the rule with a pose: regions that closed runs lose and limbs cross."""
    px, n = _ending(spark, d)
    limbs = losses.limb_evidence(v.figure_pose(spark, d), 32, 24)
    return _repaired(px, losses.lost_regions(px, n, 32, 24, losses.final_reader(1, 4), limbs=limbs))


_LOG = f"""WITH {v.OVERLAP_SQL}, sl AS (SELECT clip, frame, avg(score) * 1.6e0 AS logit FROM ov GROUP BY 1, 2), a AS (SELECT clip, frame, detection, score, overlap FROM ov WHERE track = 0 AND (clip + frame) % 6 > 0),
pk AS (SELECT sl.clip, sl.frame, logit, min(detection) FILTER (WHERE score >= 0.3 AND overlap >= 0.5) AS anchor, arg_min(detection, {{{{'o': -overlap, 'd': detection}}}}) AS best FROM sl LEFT JOIN a USING (clip, frame) GROUP BY 1, 2, 3),
sh AS (SELECT *, coalesce(anchor, best) AS detection, anchor IS NOT NULL AND logit > 0.8 AS fired FROM pk), {v.MASK_SQL},
ms AS (SELECT px.clip, px.frame, px.x, px.y FROM px JOIN sh ON sh.clip = px.clip AND sh.frame = px.frame WHERE sh.detection IS NOT NULL AND NOT (px.x < 40 AND (px.x + px.y + sh.detection) % 3 > 0)), mc AS (SELECT clip, frame, count(*) AS n FROM ms GROUP BY 1, 2)"""


def _slots(spark, d):
    every = v.overlaps(spark, d)
    slots = every.groupBy("clip", "frame").agg((F.avg("score") * 1.6).alias("logit"))
    own = every.where("track = 0 AND (clip + frame) % 6 > 0").select("clip", "frame", "detection", "score", "overlap")
    px = v.mask_px(spark, d)
    found = lambda asked: px.join(asked, ["clip", "frame"]).where("x < 40 AND (x + y + detection) % 3 > 0")
    return depths.anchor_log(slots, own, px, found, MW, MH, 0.3, 0.5)


@query(_LOG.replace("{{", "{").replace("}}", "}") + """ SELECT sh.clip, sh.frame, fired, CASE WHEN fired THEN NULL WHEN best IS NULL THEN 'no det' WHEN anchor IS NULL THEN 'gate' ELSE 'track score' END AS why,
round(a.score, 4) AS det_score, round(a.overlap, 4) AS iou, round(logit, 4) AS track_logit, CASE WHEN sh.detection IS NOT NULL THEN coalesce(mc.n, 0) END AS missed_px FROM sh LEFT JOIN a ON a.clip = sh.clip AND a.frame = sh.frame AND a.detection = sh.detection LEFT JOIN mc ON mc.clip = sh.clip AND mc.frame = sh.frame""")
def anchor_log(spark, d):
    """Slots of which some have no detection, some no anchor, and some a track that isn't sure."""
    return _slots(spark, d).drop("missed_largest_px", "missed_radius")


@query()
def anchor_log_missed(spark, d):
    """The largest piece that the logged detection misses, and how deep it is."""
    return _slots(spark, d).where("missed_px > 0").select("clip", "frame", "missed_px", "missed_largest_px", "missed_radius")


def _parts(spark, d):
    moved = lambda c: F.transform(c, lambda p: F.struct((p["x"] * (MW / W)).alias("x"), (p["y"] * (MH / H)).alias("y"), p["c"].alias("c"))).alias(c)
    p = v.parts(spark, d).select("clip", "frame", *[moved(c) for c in ("body", "left_hand", "right_hand", "face")])
    return leaks.person_parts(leaks.pose_frames(p, MW, MH), v.mask_px(spark, d), MW, MH)


@query()
def mask_person_parts(spark, d):
    p = rounded(_parts(spark, d), "attached_leak")
    return p.select("clip", "frame", F.size("fragments").cast("long").alias("fragments"), F.round(F.get("fragments", 0), 4).alias("largest"), "attached_leak")


@query()
def guard_mask_all_flags(spark, d):
    px, frames = v.mask_px(spark, d), _frames(spark, d)
    n = px.groupBy("clip").agg((F.max("frame") + 1).alias("n"))
    posed = v.pose(spark, d).select("clip", "frame", F.transform("body", lambda p: F.struct((p["x"] * (MW / W)).alias("x"), (p["y"] * (MH / H)).alias("y"), p["c"].alias("c"))).alias("body"))
    lost = losses.mask_losses(px, n, MW, MH, grow=1, block=4, limbs=losses.limb_evidence(posed, MW, MH))
    parts = _parts(spark, d)
    torn = parts.select("clip", "frame", F.explode("fragments").alias("share"))
    return guards.mask_flags(guards.mask_measures(frames, px, MW, MH), torn, limbs=_limbs_out(spark, d), losses=lost, leaks=parts)


# ---------------------------------------------------------------- references and windows

_PUT = f"WITH {v.MASK_SQL}, pc AS (SELECT * FROM px WHERE y >= 12 AND y < 38), pu AS (SELECT clip, frame, i AS x, k AS y FROM pc, range(32) a(i), range(17) b(k) WHERE floor((i + 0.5e0) * 48 / 32) = x AND floor((k + 0.5e0) * 26 / 17) = y - 12)"


@query(_PUT + " SELECT clip, frame, count(*) AS pixels, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y FROM pu GROUP BY 1, 2")
def mask_placed(spark, d):
    return masks.placed(v.mask_px(spark, d), (MW, MH), (32, 17)).groupBy("clip", "frame").agg(F.count("*").alias("pixels"), F.sum("x").alias("x"), F.sum("y").alias("y"))


_FIT = _PUT + """, o AS (SELECT clip, count(*) AS own, count(*) FILTER (WHERE y >= 12 AND y < 38) AS kept FROM px WHERE frame = 0 GROUP BY 1), p AS (SELECT * FROM pu WHERE frame = 0), t AS (SELECT * FROM px WHERE frame = 1 AND x < 32 AND y < 17),
s AS (SELECT clip, coalesce((SELECT count(*) FROM p WHERE p.clip = o.clip), 0) AS put, (SELECT max(y) - min(y) + 1 FROM p WHERE p.clip = o.clip) AS ph, coalesce((SELECT count(*) FROM t WHERE t.clip = o.clip), 0) AS oth, (SELECT max(y) - min(y) + 1 FROM t WHERE t.clip = o.clip) AS th, coalesce((SELECT count(*) FROM p JOIN t USING (clip, x, y) WHERE p.clip = o.clip), 0) AS com FROM o),
f AS (SELECT *, CASE WHEN put > 0 AND oth > 0 THEN com::DOUBLE / (put + oth - com) END AS iou FROM s JOIN o USING (clip))"""


@query(_FIT + """ SELECT clip, round(own / 2400e0, 6) AS area, round(1 - kept / own::DOUBLE, 6) AS cropped, round(iou, 6) AS iou, round(ph / th::DOUBLE, 6) AS scale, CASE WHEN iou < 0.4 THEN 'reference_misaligned' ELSE '' END AS flags FROM f""")
def reference_fit(spark, d):
    px = v.mask_px(spark, d)
    fit = guards.reference_fit(px.where("frame = 0"), (MW, MH), px.where("frame = 1 AND x < 32 AND y < 17"), (32, 17))
    return rounded(fit.withColumn("flags", F.array_join("flags", ",")), "area", "cropped", "iou", "scale")


@query(_FIT + """ SELECT clip, 'reference image: area ' || format('{:.3f}', round((own / 2400e0)::DECIMAL(18, 9), 3)::DOUBLE) || ', cropped ' || format('{:.3f}', round((1 - kept / own::DOUBLE)::DECIMAL(18, 9), 3)::DOUBLE) || ', IoU with mask frame 0 ' || coalesce(format('{:.3f}', round((iou)::DECIMAL(18, 9), 3)::DOUBLE), 'n/a')
|| ', scale vs mask frame 0 ' || coalesce(format('{:.3f}', round((ph / th::DOUBLE)::DECIMAL(18, 9), 3)::DOUBLE), 'n/a') || CASE WHEN iou < 0.4 THEN chr(10) || '- reference_misaligned (warning)' ELSE '' END AS report FROM f""")
def reference_report(spark, d):
    px = v.mask_px(spark, d)
    return guards.reference_line(guards.reference_fit(px.where("frame = 0"), (MW, MH), px.where("frame = 1 AND x < 32 AND y < 17"), (32, 17)), set())


_WINDOW = f"WITH {v.MASK_SQL}, n AS (SELECT clip, max(frame) + 1 AS n FROM px GROUP BY 1), wn AS (SELECT clip, frame - 50 AS out, x, y FROM px WHERE frame >= 50 AND frame < 71 UNION ALL SELECT clip, f - 50, x, y FROM n, range(50, 71) t(f), range(48) a(x), range(50) b(y) WHERE f >= n)"


def _window(spark, d):
    px = v.mask_px(spark, d)
    return masks.window(px, (MW, MH), px.groupBy("clip").agg((F.max("frame") + 1).alias("n")), 50, 21)


@query(_WINDOW + " SELECT clip, out, count(*) AS pixels FROM wn GROUP BY 1, 2")
def mask_window(spark, d):
    return _window(spark, d).groupBy("clip", "out").agg(F.count("*").alias("pixels"))


@query(_WINDOW + ", r AS (SELECT clip, r AS row FROM wn, range(4) t(r) WHERE out = 0 AND false UNION ALL SELECT clip, out + 3 FROM wn WHERE out >= 5) SELECT clip, row, count(*) AS pixels FROM r GROUP BY 1, 2")
def mask_latent_rows(spark, d):
    return masks.latent_rows(_window(spark, d), 5).groupBy("clip", "row").agg(F.count("*").alias("pixels"))


@query(f"""WITH {v.BOXES_SQL}, s AS (SELECT *, (x2 - x1) * 1.25e0 AS w, (y2 - y1) * 1.25e0 AS h FROM boxes), t AS (SELECT *, greatest(w, h * 0.75e0) AS sx, greatest(h, w / 0.75e0) AS sy FROM s)
SELECT clip, frame, round((x1 + x2) * 0.5e0, 6) AS cx, round((y1 + y2) * 0.5e0, 6) AS cy, round(sx, 6) AS sx, round(sy, 6) AS sy, round(767 / sx, 6) AS ax, round(1023 / sy, 6) AS ay, round(767 / sx * (0.5e0 * sx - (x1 + x2) * 0.5e0), 6) AS bx, round(1023 / sy * (0.5e0 * sy - (y1 + y2) * 0.5e0), 6) AS by FROM t""")
def udp_crop(spark, d):
    return rounded(sequence.udp_crop(v.boxes(spark, d)), "cx", "cy", "sx", "sy", "ax", "ay", "bx", "by")


@query()
def sigma_schedule(spark, d):
    rows = [(n, float(s), k, x) for n in (4, 6, 8) for s in (3, 5, 8) for k, x in enumerate(sequence.beta_sigmas(n, s))]
    return rounded(spark.createDataFrame(rows, "steps int, shift double, step int, sigma double"), "sigma")

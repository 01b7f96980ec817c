"""The query catalogue: every query over the supplied tables, and the SQL that gives the same rows in another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplane.functions import columns as fn
from cliplane.operators import boxes as bx
from cliplane.operators import colour, guards, masks, media, pose, sequence
from cliplane.session import shared_dir
from cliplane.sources import views as v
from cliplane.streaming import ordered, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
W, H = v.WIDTH, v.HEIGHT


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---------------------------------------------------------------- boxes

_IOU_SQL = f"""WITH {v.BOXES_SQL}, p AS (
  SELECT clip, frame, x1, y1, x2, y2, score, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2, lag(score) OVER w AS s FROM boxes WINDOW w AS (PARTITION BY clip ORDER BY frame)
), i AS (SELECT *, greatest(0e0, least(x2, a2) - greatest(x1, a1)) * greatest(0e0, least(y2, b2) - greatest(y1, b1)) AS inter FROM p),
iou AS (SELECT clip, frame, CASE WHEN score > 0 AND s > 0 THEN inter / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter) END AS v FROM i)"""


@query(_IOU_SQL + " SELECT clip, frame, round(v, 6) AS box_iou_prev FROM iou")
def box_iou_prev(spark, d):
    return rounded(bx.iou_with_previous(v.boxes(spark, d)).select("clip", "frame", "box_iou_prev"), "box_iou_prev")


_RUNS_SQL = """r AS (SELECT clip, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS g FROM f) GROUP BY clip, g)"""


@query(_IOU_SQL + f", f AS (SELECT clip, frame FROM iou WHERE v < 0.3), {_RUNS_SQL} SELECT clip, sum(n)::BIGINT AS flagged, max(n) AS longest, count(*) AS runs FROM r GROUP BY clip")
def guard_subject_switch(spark, d):
    flags = bx.iou_with_previous(v.boxes(spark, d)).where("box_iou_prev < 0.3").select("clip", F.lit("subject_switch").alias("check"), "frame")
    return guards.runs(flags).groupBy("clip").agg(F.sum("length").alias("flagged"), F.max("length").alias("longest"), F.count("*").alias("runs"))


@query(_IOU_SQL + f""", f AS (SELECT clip, frame FROM iou WHERE v < 0.3), {_RUNS_SQL}
SELECT clip, string_agg(CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END, ', ' ORDER BY first) AS frames, sum(n)::BIGINT AS count, max(n) AS longest FROM r GROUP BY clip""")
def frame_ranges_text(spark, d):
    flags = bx.iou_with_previous(v.boxes(spark, d)).where("box_iou_prev < 0.3").select("clip", "frame")
    return guards.ranges_text(flags, ("clip",))


@query(f"""WITH {v.BOXES_SQL}, u AS (
  SELECT *, min(CASE WHEN score > 0 THEN x1 END) OVER w AS a, min(CASE WHEN score > 0 THEN y1 END) OVER w AS b, max(CASE WHEN score > 0 THEN x2 END) OVER w AS c, max(CASE WHEN score > 0 THEN y2 END) OVER w AS e
  FROM boxes WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT clip, frame, score, persons, CASE WHEN score > 0 THEN a ELSE x1 END AS x1, CASE WHEN score > 0 THEN b ELSE y1 END AS y1, CASE WHEN score > 0 THEN c ELSE x2 END AS x2, CASE WHEN score > 0 THEN e ELSE y2 END AS y2 FROM u""")
def box_widen(spark, d):
    return bx.widen(v.boxes(spark, d), 3)


@query(f"""WITH {v.BOXES_SQL}, g AS (
  SELECT clip, frame, CASE WHEN score > 0 THEN greatest(0e0, x1 - 0.1e0 * greatest(x2 - x1, 1e0)) END AS a, CASE WHEN score > 0 THEN greatest(0e0, y1 - 0.1e0 * greatest(y2 - y1, 1e0)) END AS b,
    CASE WHEN score > 0 THEN least(1280e0, x2 + 0.1e0 * greatest(x2 - x1, 1e0)) END AS c, CASE WHEN score > 0 THEN least(720e0, y2 + 0.1e0 * greatest(y2 - y1, 1e0)) END AS e FROM boxes)
SELECT clip, frame, round(coalesce(min(a) OVER w, 0), 6) AS ex1, round(coalesce(min(b) OVER w, 0), 6) AS ey1, round(coalesce(max(c) OVER w, 1280), 6) AS ex2, round(coalesce(max(e) OVER w, 720), 6) AS ey2
FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def box_envelope(spark, d):
    return rounded(bx.envelope(v.boxes(spark, d), W, H).select("clip", "frame", "ex1", "ey1", "ex2", "ey2"), "ex1", "ey1", "ex2", "ey2")


@query(f"""WITH {v.BOXES_SQL} SELECT clip, frame, score,
  CASE WHEN x1 < 15 * (x2 - x1) / 100 THEN 0 ELSE x1 END AS x1, CASE WHEN y1 < 15 * (y2 - y1) / 100 THEN 0 ELSE y1 END AS y1,
  CASE WHEN 1280 - x2 < 15 * (x2 - x1) / 100 THEN 1280 ELSE x2 END AS x2, CASE WHEN 720 - y2 < 15 * (y2 - y1) / 100 THEN 720 ELSE y2 END AS y2 FROM boxes""")
def box_snap(spark, d):
    return bx.snap(v.boxes(spark, d).drop("persons"), W, H)


@query(f"""WITH {v.BOXES_SQL}, b AS (SELECT *, score <= 0 OR x2 - x1 < 10 OR y2 - y1 < 10 AS bad FROM boxes)
SELECT clip, frame, CASE WHEN bad THEN 0 ELSE x1 END AS x1, CASE WHEN bad THEN 0 ELSE y1 END AS y1, CASE WHEN bad THEN 1280 ELSE x2 END AS x2, CASE WHEN bad THEN 720 ELSE y2 END AS y2,
  CASE WHEN bad THEN -1 ELSE score END AS score, CASE WHEN bad THEN 0 ELSE persons END AS persons FROM b""")
def box_fallback(spark, d):
    return bx.fallback(v.boxes(spark, d), W, H)


@query("""SELECT event_id, (100 + event_id % 50)::DOUBLE AS x1, 20e0 AS y1, (100 + event_id % 50 + event_id % 7)::DOUBLE AS x2, 20e0 + event_id % 5 AS y2 FROM events WHERE event_id % 7 > 0 AND event_id % 5 > 0 AND event_id % 3 < 2""")
def box_json_parse(spark, d):
    e = v.table(spark, d, "events")
    a, b, c, g = F.col("event_id") % 50 + 100, F.lit(20), F.col("event_id") % 50 + 100 + F.col("event_id") % 7, F.col("event_id") % 5 + 20
    text = F.when(F.col("event_id") % 3 == 0, F.format_string("[%d, %d, %d, %d, 9]", a, b, c, g)).when(F.col("event_id") % 3 == 1, F.format_string('{"startX": %d, "startY": %d, "endX": %d, "endY": %d}', c, g, a, b)).otherwise("no box")
    df = e.select("event_id", bx.parse(text).alias("box")).where("box IS NOT NULL")
    return df.select("event_id", *[F.col("box")[k].alias(n) for k, n in enumerate(bx.CORNERS)])


@query(f"WITH {v.KP_SQL} SELECT clip, frame, count(*) AS points, min(j)::BIGINT AS first FROM kp WHERE x >= 0 AND x < 1280 AND y >= 0 AND y < 720 GROUP BY clip, frame")
def point_in_frame(spark, d):
    p = v.pose(spark, d).select("clip", "frame", F.posexplode("body").alias("j", "p"))
    return p.where(bx.in_frame(F.col("p.x"), F.col("p.y"), W, H)).groupBy("clip", "frame").agg(F.count("*").alias("points"), F.min("j").cast("long").alias("first"))


@query("""WITH RECURSIVE b AS (SELECT user_id AS clip, event_id % 16 AS slot, event_id, 100 / pow(2, event_id * 7 % 4) AS w, (60 + event_id * 13 % 80) / pow(2, event_id * 7 % 4) AS h, 0.02e0 + value / 500 AS score FROM events),
c AS (SELECT *, w * h AS size, greatest(w, h) AS side, row_number() OVER (PARTITION BY clip, slot ORDER BY score DESC, event_id) AS n FROM b WHERE score > 0.05e0),
f AS (SELECT clip, slot, 0::BIGINT AS n, -1e0 AS size, max(side) AS side, NULL::BIGINT AS chosen FROM c GROUP BY 1, 2
  UNION ALL SELECT f.clip, f.slot, c.n, CASE WHEN c.size > f.size AND c.side >= f.side * 0.4e0 THEN c.size ELSE f.size END, CASE WHEN c.size > f.size AND c.side >= f.side * 0.4e0 THEN c.side ELSE f.side END,
    CASE WHEN c.size > f.size AND c.side >= f.side * 0.4e0 THEN c.event_id ELSE f.chosen END FROM f JOIN c ON c.clip = f.clip AND c.slot = f.slot AND c.n = f.n + 1)
SELECT clip, slot, arg_max(chosen, n) AS chosen FROM f WHERE chosen IS NOT NULL GROUP BY 1, 2""")
def person_select(spark, d):
    """Boxes whose sides halve up to three times, so that the bar falls with each box that takes over."""
    e = v.table(spark, d, "events")
    half = F.pow(F.lit(2.0), F.col("event_id") * 7 % 4)
    b = e.select(
        F.col("user_id").alias("clip"), (F.col("event_id") % 16).alias("slot"), "event_id", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"),
        (100 / half).alias("x2"), ((60 + F.col("event_id") * 13 % 80) / half).alias("y2"), (0.02 + F.col("value") / 500).alias("score"),
    )
    return bx.choose_person(b, ["clip", "slot"], "event_id").select("clip", "slot", "chosen")


@query(f"""WITH RECURSIVE {v.BOXES_SQL}, cand AS (SELECT b.clip, date_trunc('day', e.ts) AS slot, e.event_id, x1, y1, x2, y2, score,
    row_number() OVER (PARTITION BY b.clip, date_trunc('day', e.ts) ORDER BY score DESC, e.event_id) AS n
  FROM boxes b JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) e ON e.user_id = b.clip AND e.frame = b.frame WHERE score > 0),
o AS (SELECT a.clip, a.slot, a.n, list(b.n) AS before FROM cand a JOIN cand b ON a.clip = b.clip AND a.slot = b.slot AND b.n < a.n
  WHERE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
    >= ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) / 10 GROUP BY 1, 2, 3),
r AS (SELECT clip, slot, 0::BIGINT AS n, []::BIGINT[] AS kept FROM (SELECT DISTINCT clip, slot FROM cand)
  UNION ALL SELECT r.clip, r.slot, c.n, CASE WHEN o.before IS NULL OR NOT list_has_any(r.kept, o.before) THEN list_append(r.kept, c.n) ELSE r.kept END
    FROM r JOIN cand c ON c.clip = r.clip AND c.slot = r.slot AND c.n = r.n + 1 LEFT JOIN o ON o.clip = c.clip AND o.slot = c.slot AND o.n = c.n),
l AS (SELECT clip, slot, arg_max(kept, n) AS kept FROM r GROUP BY 1, 2)
SELECT c.clip, c.event_id, round(c.score, 6) AS score FROM cand c JOIN l ON l.clip = c.clip AND l.slot = c.slot WHERE list_contains(l.kept, c.n)""")
def nms_greedy(spark, d):
    return bx.suppress(v.candidates(spark, d)).select("clip", "event_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- planning

_DOWN, _UP = "greatest(5, (({0}) - 1) // 4 * 4 + 1)", "greatest(5, (({0}) + 2) // 4 * 4 + 1)"


def _plan_sql(length: str) -> str:
    full = _DOWN.format("frames_per_chunk")
    return f"""WITH RECURSIVE {v.RUN_SQL}, r AS (SELECT video_id, total_frames, overlap, {full} AS c FROM req), p AS (
  SELECT video_id, total_frames, overlap, c, 0::BIGINT AS chunk, {length.format(need="total_frames")} AS length, {length.format(need="total_frames")} AS produced FROM r
  UNION ALL SELECT video_id, total_frames, overlap, c, chunk + 1, {length.format(need="total_frames - produced + overlap")}, produced + {length.format(need="total_frames - produced + overlap")} - overlap FROM p WHERE produced < total_frames)"""


_FIT = f"least(c, {_UP.format('{need}')})"
_PLANS = {"fit": _FIT, "full": "c", "min29": f"least(c, greatest({_FIT}, 29))"}


@query(_plan_sql(_PLANS["fit"]) + " SELECT video_id, chunk, length::BIGINT AS length FROM p")
def chunk_plan_fit(spark, d):
    return sequence.plan_chunks(v.run_requests(spark, d), "fit").select("video_id", "chunk", "length")


@query(_plan_sql(_PLANS["full"]) + " SELECT video_id, chunk, length::BIGINT AS length FROM p")
def chunk_plan_full(spark, d):
    return sequence.plan_chunks(v.run_requests(spark, d), "full").select("video_id", "chunk", "length")


@query(_plan_sql(_PLANS["min29"]) + " SELECT video_id, chunk, length::BIGINT AS length FROM p")
def chunk_plan_min29(spark, d):
    return sequence.plan_chunks(v.run_requests(spark, d), "min29").select("video_id", "chunk", "length")


@query(_plan_sql(_PLANS["fit"]) + """ SELECT video_id, max(produced)::BIGINT AS produced,
  string_agg(length::VARCHAR, ' + ' ORDER BY chunk) || ' -> ' || max(produced) || ' produced -> ' || any_value(total_frames) || ' frames (pose ' || any_value(total_frames) || ', overlap ' || any_value(overlap) || ')' AS plan FROM p GROUP BY video_id""")
def chunk_plan_text(spark, d):
    return sequence.plan_text(sequence.plan_chunks(v.run_requests(spark, d), "fit"))


@query(f"WITH {v.RUN_SQL} SELECT video_id, ({_DOWN.format('total_frames')})::BIGINT AS down, ({_UP.format('total_frames')})::BIGINT AS up, (CASE WHEN overlap <= 0 THEN 0 ELSE (overlap - 1) // 4 * 4 + 1 END)::BIGINT AS trimmed FROM req")
def snap_grid(spark, d):
    return v.run_requests(spark, d).select("video_id", fn.grid_down(F.col("total_frames")).cast("long").alias("down"), fn.grid_up(F.col("total_frames")).cast("long").alias("up"), fn.overlap_of_motion(F.col("overlap")).cast("long").alias("trimmed"))


@query("SELECT v AS video, i AS out, least(i, v - 1) AS hold, CASE WHEN v = 1 THEN 0 WHEN i % (2 * v - 2) < v THEN i % (2 * v - 2) ELSE 2 * v - 2 - i % (2 * v - 2) END AS ping_pong FROM (SELECT n_nationkey::BIGINT + 1 AS v FROM nation), range(80) t(i)")
def tail_padding(spark, d):
    n = v.table(spark, d, "nation").select((F.col("n_nationkey").cast("long") + 1).alias("video"))
    df = n.select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(79).cast("long"))).alias("out"))
    return df.select("video", "out", sequence.hold_tail(F.col("out"), F.col("video")).alias("hold"), F.when(F.col("video") == 1, 0).otherwise(sequence.ping_pong_tail(F.col("out"), F.col("video"))).cast("long").alias("ping_pong"))


_GRID = f"""WITH RECURSIVE {v.VIDEO_SQL}, g AS (SELECT video_id, -1::BIGINT AS frame, 0e0 AS time, false AS hit, fps, rate, frames FROM video
  UNION ALL SELECT video_id, CASE WHEN time >= 1 / rate THEN frame ELSE frame + 1 END, CASE WHEN time >= 1 / rate THEN time - 1 / rate WHEN frame < 0 THEN time + 1 / rate ELSE time + 1 / fps END, time >= 1 / rate, fps, rate, frames
    FROM g WHERE time >= 1 / rate OR frame < frames - 1),
tg AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame, time DESC) - 1 AS out, frame FROM g WHERE hit)"""


@query(_GRID + " SELECT video_id, out, frame FROM tg")
def time_grid(spark, d):
    return sequence.time_grid(v.videos(spark, d))


_LOADED = _GRID + ", nl AS (SELECT video_id, (count(*) - 4 - 1) // 4 * 4 + 1 AS n FROM tg GROUP BY 1), ld AS (SELECT video_id, out - 4 AS out, frame FROM tg JOIN nl USING (video_id) WHERE out >= 4 AND out - 4 < n)"


@query(_LOADED + " SELECT video_id, count(*) AS n, sum(frame)::BIGINT AS frames, max(frame) AS last FROM ld GROUP BY 1")
def frame_indices(spark, d):
    """Every video from its fifth frame on, cut to 4 n + 1."""
    found = sequence.frame_indices(v.videos(spark, d), 5, None, 4)
    return found.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("frame").alias("frames"), F.max("frame").alias("last"))


@query(_LOADED + """, z AS (SELECT *, CASE WHEN height > width THEN 720 ELSE 1280 END AS w, CASE WHEN height > width THEN 1280 ELSE 720 END AS h FROM video JOIN nl USING (video_id))
SELECT video_id, 'Wan' AS model, '720p' AS resolution, CASE WHEN h > w THEN 'portrait' ELSE 'landscape' END AS orientation, fps AS source_fps, frames AS source_frame_count, round(frames / fps, 6) AS source_duration, width AS source_width,
  height AS source_height, rate AS loaded_fps, n AS loaded_frame_count, round(n * (1 / rate), 6) AS loaded_duration, w::BIGINT AS loaded_width, h::BIGINT AS loaded_height FROM z""")
def video_info(spark, d):
    videos = v.videos(spark, d)
    n = sequence.frame_indices(videos, 5, None, 4).groupBy("video_id").agg(F.count("*").alias("n"))
    size = media.load_size(videos, F.lit("Wan"), F.lit("720p"), F.lit("auto")).select("video_id", F.lit("Wan").alias("model"), F.lit("720p").alias("resolution"), "to_width", "to_height")
    return rounded(sequence.video_info(videos, n, size), "source_duration", "loaded_duration")


@query(f"""WITH {v.VIDEO_SQL}, l(label, w, h) AS (VALUES ('480p', 480, 854), ('720p', 720, 1280), ('1080p', 1080, 1920)),
b AS (SELECT video_id, width, height, arg_min({{'label': label, 'w': w, 'h': h}}, abs(ln(w::DOUBLE / least(width, height)))) AS s FROM video, l GROUP BY ALL)
SELECT video_id, s.label AS label, (CASE WHEN height > width THEN s.w ELSE s.h END)::BIGINT AS to_width, (CASE WHEN height > width THEN s.h ELSE s.w END)::BIGINT AS to_height FROM b""")
def conform_size(spark, d):
    return sequence.conform(v.videos(spark, d))


_ASPECT = "(1280e0 / 720e0)"


@query(f"""WITH {v.VIDEO_SQL}, s AS (SELECT *, width::DOUBLE / height > {_ASPECT} AS wide FROM video),
t AS (SELECT video_id, width, height, CASE WHEN wide THEN round_even(height * {_ASPECT}, 0) ELSE width END::BIGINT AS w, CASE WHEN wide THEN height ELSE round_even(width / {_ASPECT}, 0) END::BIGINT AS h FROM s)
SELECT video_id, ((width - w) // 2)::BIGINT AS x, ((height - h) // 2)::BIGINT AS y, w, h FROM t""")
def crop_box(spark, d):
    return sequence.crop_box(v.videos(spark, d), 1280, 720)


@query(f"""WITH {v.VIDEO_SQL}, s AS (SELECT *, width::DOUBLE / height AS a FROM video)
SELECT video_id, CASE WHEN a > {_ASPECT} THEN round_even((width - width * ({_ASPECT} / a)) / 2, 0) ELSE 0 END::BIGINT AS x, CASE WHEN a < {_ASPECT} THEN round_even((height - height * (a / {_ASPECT})) / 2, 0) ELSE 0 END::BIGINT AS y FROM s""")
def center_crop(spark, d):
    return sequence.center_crop(v.videos(spark, d), 1280, 720)


@query(f"""WITH {v.VIDEO_SQL}, s AS (SELECT video_id, width, height, least(1280e0 / width, 720e0 / height) AS r FROM video), t AS (SELECT video_id, round_even(width * r, 0)::BIGINT AS w, round_even(height * r, 0)::BIGINT AS h FROM s)
SELECT video_id, ((1280 - w) // 2)::BIGINT AS x, ((720 - h) // 2)::BIGINT AS y, w, h FROM t""")
def contain_box(spark, d):
    return sequence.contain_box(v.videos(spark, d), 1280, 720)


# ---------------------------------------------------------------- pose

_ON = "(c >= 0.5)"
_LIMBS = ", ".join(f"({a}, {b})" for a, b in pose.LIMBS)


def _pts(*js: int) -> str:
    """Named keypoints side by side for each frame."""
    cols = ", ".join(f"max(CASE WHEN j = {j} THEN {c} END) AS {c}{j}" for j in js for c in "xyc")
    return f"pt AS (SELECT clip, frame, {cols} FROM kp GROUP BY clip, frame)"


def _dist(a: int, b: int) -> str:
    return f"sqrt((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b}))"


@query(f"""WITH {v.KP_SQL}, o AS (SELECT *, {_ON} AS on_ FROM kp), l(a, b) AS (VALUES {_LIMBS}),
m AS (SELECT p.clip, p.frame, count(*) AS limbs FROM o p JOIN l ON p.j = l.a JOIN o q ON q.j = l.b AND q.clip = p.clip AND q.frame = p.frame WHERE p.on_ AND q.on_ GROUP BY 1, 2)
SELECT o.clip, o.frame, round(avg(c), 6) AS pose_conf, sum(on_::INT)::BIGINT AS drawn_keypoints, coalesce(any_value(limbs), 0) AS drawn_limbs FROM o LEFT JOIN m ON o.clip = m.clip AND o.frame = m.frame GROUP BY o.clip, o.frame""")
def drawn_counts(spark, d):
    return rounded(pose.counts(v.pose(spark, d)), "pose_conf")


_SCALE = f"greatest(CASE WHEN c2 >= 0.5 AND c5 >= 0.5 THEN {_dist(2, 5)} ELSE 0 END, CASE WHEN c8 >= 0.5 AND c11 >= 0.5 THEN {_dist(8, 11)} ELSE 0 END, CASE WHEN c1 >= 0.5 AND c0 >= 0.5 THEN 1.5e0 * {_dist(1, 0)} ELSE 0 END, 1e0)"


@query(f"WITH {v.KP_SQL}, {_pts(0, 1, 2, 5, 8, 11)} SELECT clip, frame, round({_SCALE}, 6) AS scale FROM pt")
def body_scale(spark, d):
    return rounded(v.pose(spark, d).select("clip", "frame", pose.body_scale().alias("scale")), "scale")


@query(f"""WITH {v.KP_SQL}, {_pts(0, 1, 2, 5, 8, 11)}, s AS (SELECT clip, frame, {_SCALE} AS scale FROM pt), l(a, b) AS (VALUES {_LIMBS}),
e AS (SELECT p.clip, p.frame, a, b, p.c >= 0.5 AS da, q.c >= 0.5 AS db, CASE WHEN p.c >= 0.5 THEN q.x ELSE p.x END AS x, CASE WHEN p.c >= 0.5 THEN q.y ELSE p.y END AS y FROM kp p JOIN l ON p.j = a JOIN kp q ON q.j = b AND q.clip = p.clip AND q.frame = p.frame)
SELECT clip, frame, a::BIGINT AS a, b::BIGINT AS b FROM e JOIN s USING (clip, frame) WHERE da <> db AND least(x, 1279 - x, y, 719 - y) < 0.25e0 * scale""")
def out_of_shot(spark, d):
    return pose.out_of_shot(v.pose(spark, d), W, H)


_TORSO = f"""WITH {v.KP_SQL}, t AS (SELECT clip, frame, j, x, y, {_ON} AS on_, lag(x) OVER w AS px, lag(y) OVER w AS py, lag({_ON}) OVER w AS pon FROM kp WHERE j IN (0, 1, 2, 5, 8, 11) WINDOW w AS (PARTITION BY clip, j ORDER BY frame)),
m AS (SELECT clip, frame, coalesce(max(CASE WHEN on_ AND pon THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) END), 0) AS move FROM t GROUP BY clip, frame)"""


@query(_TORSO + " SELECT clip, frame, round(move, 6) AS torso_move FROM m")
def torso_move(spark, d):
    return rounded(pose.torso_move(v.pose(spark, d)), "torso_move")


def _measures(spark, d) -> DataFrame:
    """Measures of the frames of boxes and poses; a frame that one side lacks has nulls for what it takes from there."""
    b = bx.iou_with_previous(v.boxes(spark, d))
    m = pose.torso_move(v.pose(spark, d))
    spikes = pose.limb_spikes(v.pose(spark, d), H).groupBy("clip", "frame").agg(F.count("*").alias("limb_spikes"))
    diagonal = F.hypot(F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0)))
    df = b.join(m, ["clip", "frame"], "full").join(spikes, ["clip", "frame"], "left")
    return df.select("clip", "frame", "box_iou_prev", (F.col("torso_move") / diagonal).alias("torso_jump"), F.coalesce("limb_spikes", F.lit(0)).alias("limb_spikes"))


_SPIKES = """k AS (SELECT *, c >= 0.5 AS on_ FROM kp WHERE j IN (3, 4, 6, 7, 9, 10, 12, 13, 18, 19)),
sk AS (SELECT a.clip, a.j, a.frame, min(b.frame - a.frame) AS back FROM k a JOIN k p ON p.clip = a.clip AND p.j = a.j AND p.frame = a.frame - 1 JOIN k b ON b.clip = a.clip AND b.j = a.j AND b.frame BETWEEN a.frame + 1 AND a.frame + 3
  WHERE a.on_ AND p.on_ AND b.on_ AND sqrt(power(a.x - p.x, 2) + power(a.y - p.y, 2)) > 0.08e0 * 720 AND sqrt(power(b.x - p.x, 2) + power(b.y - p.y, 2)) < 0.08e0 * 720 / 2 GROUP BY 1, 2, 3),
sp AS (SELECT DISTINCT clip, unnest(range(frame, frame + back)) AS frame, j::BIGINT AS keypoint FROM sk)"""
_FLAGS = _IOU_SQL + _TORSO.replace("WITH ", ", ", 1) + f""", {_SPIKES}, d AS (SELECT clip, frame, sqrt(power(greatest(x2 - x1, 1), 2) + power(greatest(y2 - y1, 1), 2)) AS diag FROM boxes),
q AS (SELECT clip, frame, v, move / diag AS torso_jump FROM iou LEFT JOIN d USING (clip, frame) FULL JOIN m USING (clip, frame)),
fl AS (SELECT clip, 'pose_jump' AS "check", frame FROM q WHERE v > 0.5 AND torso_jump > 0.25e0 UNION ALL SELECT DISTINCT clip, 'pose_spike', frame FROM sp UNION ALL SELECT clip, 'subject_switch', frame FROM q WHERE v < 0.3)"""


@query(_FLAGS + ' SELECT clip, "check", frame FROM fl')
def guard_pose_flags(spark, d):
    return guards.pose_flags(_measures(spark, d))


@query()
def guard_metrics_json(spark, d):
    m = rounded(_measures(spark, d), "box_iou_prev", "torso_jump")
    return guards.metrics_json(m, ["box_iou_prev", "torso_jump", "limb_spikes"])


@query(f"WITH {v.KP_SQL}, {_SPIKES} SELECT clip, frame, keypoint FROM sp")
def guard_pose_spike(spark, d):
    return pose.limb_spikes(v.pose(spark, d), H)


@query(f"""WITH {v.KP_SQL}, {_pts(0, 1, 2, 3, 4, 5, 6, 7, 8, 11)}, s AS (SELECT *, greatest({_dist(2, 5)}, {_dist(8, 11)}, 1.5e0 * {_dist(1, 0)}, 1e0) * 0.2e0 AS reach FROM pt)
SELECT clip, frame, CASE WHEN c3 + c4 < c6 + c7 THEN 'right' ELSE 'left' END AS side FROM s WHERE {_dist(3, 6)} < reach AND {_dist(4, 7)} < reach AND c3 + c4 <> c6 + c7
  AND ((c3 >= 0.5 AND c4 >= 0.5 AND (c6 >= 0.5 OR c7 >= 0.5)) OR (c6 >= 0.5 AND c7 >= 0.5 AND (c3 >= 0.5 OR c4 >= 0.5)))""")
def arm_mirror(spark, d):
    return pose.mirrored_arms(v.pose(spark, d))


@query(f"""WITH {v.KP_SQL}, {_pts(3, 4, 6, 7)}, a AS (SELECT clip, frame, 'left' AS side, {_dist(6, 7)} AS n FROM pt WHERE c6 >= 0.5 AND c7 >= 0.5 UNION ALL SELECT clip, frame, 'right', {_dist(3, 4)} FROM pt WHERE c3 >= 0.5 AND c4 >= 0.5),
m AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY clip, side) AS median FROM a) SELECT clip, side, frame, round(median, 6) AS median, round(n / median, 6) AS ratio FROM m WHERE n > 1.4e0 * median""")
def forearm_overlong(spark, d):
    return rounded(pose.overlong_forearms(v.pose(spark, d), 1.4), "median", "ratio")


@query(f"""WITH {v.KP_SQL}, b AS (SELECT clip, frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM kp WHERE j >= 1 GROUP BY clip, frame),
s AS (SELECT clip, frame, CASE WHEN x1 - x0 < 36 THEN (x0 + x1) / 2 - 18 ELSE x0 END AS x0, CASE WHEN x1 - x0 < 36 THEN (x0 + x1) / 2 + 18 ELSE x1 END AS x1, CASE WHEN y1 - y0 < 36 THEN (y0 + y1) / 2 - 18 ELSE y0 END AS y0, CASE WHEN y1 - y0 < 36 THEN (y0 + y1) / 2 + 18 ELSE y1 END AS y1 FROM b),
n AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM s), e AS (SELECT *, (sqrt(w * h * 1.3e0 * (w / h)) - w) / 2 AS dx, (sqrt(w * h * 1.3e0 * (h / w)) - h) / 4 AS dy FROM n)
SELECT clip, frame, trunc(greatest(x0 - dx, 0))::BIGINT AS x1, trunc(least(x1 + dx, 1280))::BIGINT AS x2, trunc(greatest(y0 - 3 * dy, 0))::BIGINT AS y1, trunc(least(y1 + dy, 720))::BIGINT AS y2 FROM e""")
def face_box(spark, d):
    p = v.pose(spark, d)
    return p.select("clip", "frame", pose.face_box(F.slice("body", 2, 19), W, H).alias("box")).select("clip", "frame", "box.*")


@query(f"""WITH {v.BOXES_SQL} SELECT clip, frame, {", ".join(f"trunc(greatest(0, least({1280 if c[0] == 'x' else 720}, CASE WHEN score > 0 THEN quantile_cont(CASE WHEN score > 0 THEN {c} END, 0.5) OVER w ELSE {c} END)))::BIGINT AS {c}" for c in bx.CORNERS)}
FROM boxes WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def face_smooth_median(spark, d):
    return pose.smooth_median(v.boxes(spark, d), W, H)


#: Sides of the view are whole; moved off them, what is cut to whole pixels doesn't hang on the last digit.
_OFF = 0.3717


@query(f"""WITH {v.BOXES_SQL.replace("boxes AS", "whole AS", 1)}, boxes AS (SELECT clip, frame, score, {", ".join(f"CASE WHEN score > 0 THEN {c} + {_OFF}e0 ELSE {c} END AS {c}" for c in bx.CORNERS)} FROM whole), k AS (SELECT a.clip, a.frame, sum(exp(-0.5e0 * power((b.frame - a.frame) / 2e0, 2))) AS t, sum(exp(-0.5e0 * power((b.frame - a.frame) / 2e0, 2)) * ln(greatest(b.x2 - b.x1, 1))) AS w, sum(exp(-0.5e0 * power((b.frame - a.frame) / 2e0, 2)) * ln(greatest(b.y2 - b.y1, 1))) AS h
  FROM boxes a JOIN boxes b ON a.clip = b.clip AND b.frame BETWEEN a.frame - 6 AND a.frame + 6 AND b.score > 0 GROUP BY 1, 2),
s AS (SELECT b.clip, b.frame, score, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, exp(coalesce(k.w / k.t, ln(greatest(x2 - x1, 1)))) / 2 AS hw, exp(coalesce(k.h / k.t, ln(greatest(y2 - y1, 1)))) / 2 AS hh FROM boxes b LEFT JOIN k USING (clip, frame))
SELECT clip, frame, {', '.join(f'trunc(greatest(0, least({1280 if c[0] == chr(120) else 720}, CASE WHEN score > 0 THEN {e} ELSE {c} END)))::BIGINT AS {c}' for c, e in zip(bx.CORNERS, ('cx - hw', 'cy - hh', 'cx + hw', 'cy + hh'), strict=True))} FROM s""")
def face_smooth_gauss(spark, d):
    moved = v.boxes(spark, d).withColumns({c: F.when(F.col("score") > 0, F.col(c) + _OFF).otherwise(F.col(c)) for c in bx.CORNERS})
    return pose.smooth_size(moved, W, H)


# ---------------------------------------------------------------- masks


@query(f"WITH {v.MASK_SQL} SELECT clip, frame, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px GROUP BY clip, frame")
def mask_area(spark, d):
    return masks.areas(v.mask_px(spark, d))


@query(f"""WITH {v.MASK_SQL}, a AS (SELECT clip, frame, count(*) AS n FROM px GROUP BY 1, 2), c AS (SELECT p.clip, p.frame, count(*) AS common FROM px p JOIN px q ON q.clip = p.clip AND q.frame = p.frame - 1 AND q.x = p.x AND q.y = p.y GROUP BY 1, 2)
SELECT a.clip, a.frame, round(coalesce(common, 0)::DOUBLE / (a.n + b.n - coalesce(common, 0)), 6) AS iou FROM a LEFT JOIN a b ON b.clip = a.clip AND b.frame = a.frame - 1 LEFT JOIN c ON c.clip = a.clip AND c.frame = a.frame""")
def mask_iou_prev(spark, d):
    return rounded(masks.iou_with_previous(v.mask_px(spark, d)), "iou")


_GROWN = f"WITH {v.MASK_SQL}, g AS (SELECT DISTINCT clip, frame, x + dx AS x, y + dy AS y FROM px, range(-3, 4) a(dx), range(-3, 4) b(dy) WHERE abs(dx) + abs(dy) <= 3 AND x + dx BETWEEN 0 AND 47 AND y + dy BETWEEN 0 AND 49)"


_FINAL = _GROWN + """, b AS (SELECT clip, frame, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM g GROUP BY 1, 2),
n AS (SELECT *, greatest(1, (x1 - x0) // 8) AS nx, greatest(1, (y1 - y0) // 8) AS ny FROM b), i AS (SELECT n.*, least((x - x0) // ((x1 - x0) // nx), nx - 1) AS i, least((y - y0) // ((y1 - y0) // ny), ny - 1) AS k FROM g JOIN n USING (clip, frame)),
fb AS (SELECT DISTINCT clip, frame, (x0 + i * ((x1 - x0) // nx))::BIGINT AS bx0, (y0 + k * ((y1 - y0) // ny))::BIGINT AS by0, (CASE WHEN i = nx - 1 THEN x1 ELSE x0 + (i + 1) * ((x1 - x0) // nx) END)::BIGINT AS bx1, (CASE WHEN k = ny - 1 THEN y1 ELSE y0 + (k + 1) * ((y1 - y0) // ny) END)::BIGINT AS by1 FROM i)"""


@query(_FINAL + " SELECT * FROM fb")
def mask_final(spark, d):
    return masks.final_blocks(v.mask_px(spark, d), 3, 8, 48, 50)


@query(_FINAL + " SELECT clip, frame, sum((bx1 - bx0) * (by1 - by0))::BIGINT AS area, sum((by1 - by0) * (bx0 + bx1 - 1) * (bx1 - bx0) / 2)::BIGINT AS x FROM fb GROUP BY 1, 2")
def mask_final_pixels(spark, d):
    return masks.final_mask(v.mask_px(spark, d), 3, 8, 48, 50).groupBy("clip", "frame").agg(F.count("*").alias("area"), F.sum("x").alias("x"))


@query(_GROWN + " SELECT clip, frame, count(*) AS area FROM g GROUP BY clip, frame")
def mask_dilate(spark, d):
    return masks.dilate(v.mask_px(spark, d), 3, 48, 50).groupBy("clip", "frame").agg(F.count("*").alias("area"))


@query(f"WITH {v.MASK_SQL} SELECT clip, frame, count(*) AS area, round(avg(CASE WHEN x BETWEEN 10 AND 39 AND y BETWEEN 5 AND 44 THEN 0e0 ELSE 1e0 END), 6) AS outside FROM px GROUP BY clip, frame")
def mask_outside_box(spark, d):
    return rounded(masks.outside_box(v.mask_px(spark, d), (10, 5, 40, 45)), "outside")


@query(f"WITH {v.MASK_SQL} SELECT arg_min(clip, clip - 100 * (clip * 3 % 4)) AS clip, frame, x, y FROM px GROUP BY frame, x, y")
def mask_non_overlap(spark, d):
    return masks.without_overlap(v.mask_px(spark, d), F.col("clip") * 3 % 4)


@query(f"""WITH {v.MASK_SQL}, w AS (SELECT arg_min(clip, clip - 100 * (clip * 3 % 4)) AS clip, frame, x, y FROM px GROUP BY frame, x, y),
l AS (SELECT clip, frame, count(*) AS n FROM w GROUP BY 1, 2), a AS (SELECT clip, frame, count(*) AS area FROM px GROUP BY 1, 2)
SELECT a.clip, a.frame, area, (CASE WHEN coalesce(n, 0) >= 0.9e0 * area THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS kept FROM a LEFT JOIN l USING (clip, frame)""")
def mask_suppress_shrunk(spark, d):
    return masks.suppress_shrunk(v.mask_px(spark, d), 0.9, F.col("clip") * 3 % 4)


def labelled(pixels: str, corners: bool) -> str:
    """RECURSIVE parts of a query that number each pixel's piece by its first pixel in scan order: lb (clip, frame, x, y, root)."""
    beside = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1" if corners else "abs(a.x - b.x) + abs(a.y - b.y) <= 1"
    return f"""ed AS (SELECT a.clip, a.frame, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM {pixels} a JOIN {pixels} b ON a.clip = b.clip AND a.frame = b.frame AND {beside}),
rc AS (SELECT clip, frame, x, y, y * 1000 + x AS root FROM {pixels} UNION SELECT ed.clip, ed.frame, ed.bx, ed.by, rc.root FROM rc JOIN ed ON ed.clip = rc.clip AND ed.frame = rc.frame AND ed.ax = rc.x AND ed.ay = rc.y AND rc.root < ed.by * 1000 + ed.bx),
lb AS (SELECT clip, frame, x, y, min(root) AS root FROM rc GROUP BY 1, 2, 3, 4), pc AS (SELECT clip, frame, root, row_number() OVER (PARTITION BY clip, frame ORDER BY count(*) DESC, root) - 1 AS piece, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM lb GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {v.MASK_SQL}, {labelled('px', False)} SELECT clip, frame, piece, area, x0, y0, x1, y1 FROM pc")
def mask_pieces(spark, d):
    return masks.pieces(v.mask_px(spark, d))


#: The identity colours of the first four persons (blue, red, green, magenta).
PALETTE = ((0, 0, 1), (1, 0, 0), (0, 1, 0), (1, 0, 1))
_PALETTE_SQL = ", ".join(f"({k}, {c[0]}, {c[1]}, {c[2]})" for k, c in enumerate(PALETTE))


@query(f"""WITH {v.MASK_SQL}, pal(clip, r, g, b) AS (VALUES {_PALETTE_SQL}), n AS (SELECT clip, frame, count(*) AS n FROM px GROUP BY 1, 2)
SELECT n.clip, frame, (n * r + (48 * 50 - n))::BIGINT AS red, (n * g + (48 * 50 - n))::BIGINT AS green, (n * b + (48 * 50 - n))::BIGINT AS blue FROM n JOIN pal USING (clip)""")
def mask_identity(spark, d):
    px = v.mask_px(spark, d)
    colour = F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]) for c in PALETTE]), (F.col("clip") + 1).cast("int"))
    full = masks.render_identity(px, px, 48, 50, colour, F.array(F.lit(1), F.lit(1), F.lit(1)))
    return full.groupBy("clip", "frame").agg(*[F.sum(F.col("rgb")[k]).cast("long").alias(n) for k, n in enumerate(("red", "green", "blue"))])


# ---------------------------------------------------------------- colour


def _lab_sql(r: str, g: str, b: str) -> str:
    lin = lambda c: f"(CASE WHEN {c} <= 0.04045e0 THEN {c} / 12.92e0 ELSE power(({c} + 0.055e0) / 1.055e0, 2.4e0) END)"
    f = []
    for row, white in zip(fn.TO_XYZ, fn.D65, strict=True):
        t = "((" + " + ".join(f"{lin(c)} * {k!r}e0" for c, k in zip((r, g, b), row, strict=True)) + f") / {white!r}e0)"
        f.append(f"(CASE WHEN {t} > {fn.DELTA**3!r}e0 THEN power({t}, 1e0 / 3e0) ELSE {t} / {3 * fn.DELTA**2!r}e0 + 4e0 / 29e0 END)")
    return f"116e0 * {f[1]} - 16e0 AS l, 500e0 * ({f[0]} - {f[1]}) AS a, 200e0 * ({f[1]} - {f[2]}) AS b_"


_LAB = f"WITH {v.RGB_SQL}, lab AS (SELECT clip, weight, r, g, b, {_lab_sql('r', 'g', 'b')} FROM rgb)"


@query(_LAB + " SELECT clip, count(*) AS pixels, round(avg(l), 6) AS l, round(avg(a), 6) AS a, round(avg(b_), 6) AS b FROM lab GROUP BY clip")
def lab_forward(spark, d):
    df = v.frame_rgb(spark, d)
    for n, c in zip("LAB", fn.lab(F.col("r"), F.col("g"), F.col("b")), strict=True):
        df = df.withColumn(f"lab_{n}", c)
    return rounded(df.groupBy("clip").agg(F.count("*").alias("pixels"), F.avg("lab_L").alias("l"), F.avg("lab_A").alias("a"), F.avg("lab_B").alias("b")), "l", "a", "b")


@query(f"WITH {v.RGB_SQL} SELECT round(r, 4) AS r, round(g, 4) AS g, round(b, 4) AS b, count(*) AS n FROM rgb GROUP BY 1, 2, 3")
def lab_roundtrip(spark, d):
    df = v.frame_rgb(spark, d).select("r", "g", "b").withColumns(dict(zip(("p", "q", "s"), fn.lab(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    back = fn.srgb(F.col("p"), F.col("q"), F.col("s"))
    return df.select(*[F.round(c, 4).alias(n) for n, c in zip("rgb", back, strict=True)]).groupBy("r", "g", "b").agg(F.count("*").alias("n"))


@query(_LAB + """, m AS (SELECT clip, sum(l * weight) / sum(weight) AS ml, sum(a * weight) / sum(weight) AS ma, sum(b_ * weight) / sum(weight) AS mb FROM lab GROUP BY clip),
s AS (SELECT clip, any_value(ml) AS ml, any_value(ma) AS ma, any_value(mb) AS mb, sqrt(sum(power(l - ml, 2) * weight) / sum(weight)) AS sl, sqrt(sum(power(a - ma, 2) * weight) / sum(weight)) AS sa, sqrt(sum(power(b_ - mb, 2) * weight) / sum(weight)) AS sb FROM lab JOIN m USING (clip) GROUP BY clip)
SELECT s.clip, round(s.ml, 6) AS mean_l, round(t.ml, 6) AS to_l, round(least(greatest(t.sl / greatest(s.sl, 1e-6), 0.5e0), 2e0), 6) AS ratio_l, round(least(greatest(t.sa / greatest(s.sa, 1e-6), 0.5e0), 2e0), 6) AS ratio_a, round(least(greatest(t.sb / greatest(s.sb, 1e-6), 0.5e0), 2e0), 6) AS ratio_b
FROM s JOIN s t ON t.clip = 'N'""")
def lab_transfer(spark, d):
    found = colour.statistics(v.frame_rgb(spark, d))
    to = found.where("clip = 'N'").drop("clip")
    # the statistics of one clip for all: a row a clip on both sides
    target = found.select("clip").join(to, F.lit(True))
    out = colour.transfer(found, target).select("clip", F.col("from_l").alias("mean_l"), "to_l", "ratio_l", "ratio_a", "ratio_b")
    return rounded(out, "mean_l", "to_l", "ratio_l", "ratio_a", "ratio_b")


@query(f"WITH {v.RGB_SQL} SELECT clip, round(sum(round_even((r * 0.37e0 + 0.011e0) * 255, 0)) / 255, 6) AS r FROM rgb GROUP BY clip")
def level_requantized(spark, d):
    df = v.frame_rgb(spark, d).select("clip", colour.requantized(F.col("r") * 0.37 + 0.011).alias("r"))
    return rounded(df.groupBy("clip").agg(F.sum("r").alias("r")), "r")


def _srgb_sql(light: str, a: str, b: str) -> list[str]:
    f = [f"({light} + 16e0) / 116e0 + {a} / 500e0", f"({light} + 16e0) / 116e0", f"({light} + 16e0) / 116e0 - {b} / 200e0"]
    xyz = [f"(CASE WHEN {t} > {fn.DELTA!r}e0 THEN power({t}, 3) ELSE {3 * fn.DELTA**2!r}e0 * ({t} - 4e0 / 29) END * {w!r}e0)" for t, w in zip(f, fn.D65, strict=True)]
    out = []
    for row in fn.inverse(fn.TO_XYZ):
        u = "least(1e0, greatest(0e0, " + " + ".join(f"{x} * ({k!r}e0)" for x, k in zip(xyz, row, strict=True)) + "))"
        out.append(f"(CASE WHEN {u} <= 0.0031308e0 THEN {u} * 12.92e0 ELSE 1.055e0 * power({u}, 1 / 2.4e0) - 0.055e0 END)")
    return out


_STATS = """, m AS (SELECT clip, sum(l * weight) / sum(weight) AS ml, sum(a * weight) / sum(weight) AS ma, sum(b_ * weight) / sum(weight) AS mb FROM lab GROUP BY clip),
s AS (SELECT clip, any_value(ml) AS ml, any_value(ma) AS ma, any_value(mb) AS mb, sqrt(sum(power(l - ml, 2) * weight) / sum(weight)) AS sl, sqrt(sum(power(a - ma, 2) * weight) / sum(weight)) AS sa, sqrt(sum(power(b_ - mb, 2) * weight) / sum(weight)) AS sb FROM lab JOIN m USING (clip) GROUP BY clip)"""


def _apply_sql(after: str, strength: str) -> str:
    """Every clip's colours moved to those of the clip named by after."""
    move = lambda c, k: f"({c} - s.m{k}) * least(greatest(t.s{k} / greatest(s.s{k}, 1e-6), 0.5e0), 2e0) + t.m{k}"
    moved = ", ".join(f"{move(c, k)} AS n{k}" for c, k in (("l", "l"), ("a", "a"), ("b_", "b")))
    new = ", ".join(f"round(avg(least(1e0, greatest(0e0, {c} + {strength} * ({x} - {c})))), 5) AS {c}" for c, x in zip("rgb", _srgb_sql("nl", "na", "nb"), strict=True))
    return _LAB + _STATS + f", mv AS (SELECT lab.*, {moved} FROM lab JOIN s USING (clip) JOIN s t ON t.clip = {after}) SELECT clip, count(*) AS pixels, {new} FROM mv GROUP BY clip"


def _applied(spark, d, after, strength, weight=1.0):
    px = v.frame_rgb(spark, d)
    found = colour.statistics(px)
    target = found.join(found.select("clip", after.alias("of")).withColumnsRenamed({"clip": "own", "of": "clip"}), "clip")
    out = colour.apply_transfer(px, colour.transfer(found, target.drop("clip").withColumnRenamed("own", "clip")), strength, weight)
    return out.groupBy("clip").agg(F.count("*").alias("pixels"), *[F.round(F.avg(c), 5).alias(c) for c in "rgb"])


_NEXT = {"A": "N", "N": "R", "R": "A"}
_NEXT_SQL = "CASE s.clip " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _NEXT.items()) + " END"


def _next():
    return F.element_at(F.create_map(*[F.lit(x) for pair in _NEXT.items() for x in pair]), F.col("clip"))


@query(_apply_sql("s.clip", "1e0"))
def lab_apply_same(spark, d):
    """A transfer from a clip to itself leaves its colours where they are."""
    return _applied(spark, d, F.col("clip"), 1.0)


@query(_apply_sql(_NEXT_SQL, "0.8e0 * weight"))
def lab_apply(spark, d):
    """Every clip with the colours of the next one, at four fifths of the strength and weighted by place."""
    return _applied(spark, d, _next(), 0.8, F.col("weight"))


# ---------------------------------------------------------------- levels

_YUV = """y AS (SELECT clip, frame, x, y, r, b, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS luma FROM rgb)"""


@query(f"WITH {v.RGB_SQL}, {_YUV} SELECT clip, frame, round(avg(least(floor(876e0 * luma + 64 + 0.5e0), 1023)), 6) AS luma FROM y GROUP BY clip, frame")
def luma_10bit(spark, d):
    level = fn.half_up_10bit(fn.TV_10BIT["luma"] * fn.luma(F.col("r"), F.col("g"), F.col("b")) + fn.TV_10BIT["black"])
    return rounded(v.frame_rgb(spark, d).groupBy("clip", "frame").agg(F.avg(level).alias("luma")), "luma")


@query(f"""WITH {v.RGB_SQL}, {_YUV.replace("FROM rgb", "FROM (SELECT clip, frame, x, y, r * 0.97e0 + 0.0113e0 AS r, g * 0.97e0 + 0.0071e0 AS g, b * 0.97e0 + 0.0157e0 AS b FROM rgb)")}, bl AS (SELECT clip, frame, x // 2 AS bx, y // 2 AS by, avg(b - luma) AS cb, avg(r - luma) AS cr FROM y GROUP BY 1, 2, 3, 4)
SELECT clip, frame, count(*) AS blocks, sum(floor(cb * (896 / (2 * (1 - 0.0722e0))) + 512e0 + 0.5e0))::BIGINT AS cb, sum(floor(cr * (896 / (2 * (1 - 0.2126e0))) + 512e0 + 0.5e0))::BIGINT AS cr FROM bl GROUP BY 1, 2""")
def chroma_10bit(spark, d):
    """Colours moved off those whose levels are halves, which two engines may round either way."""
    df = v.frame_rgb(spark, d).withColumns({c: F.col(c) * 0.97 + k for c, k in (("r", 0.0113), ("g", 0.0071), ("b", 0.0157))})
    df = df.withColumn("luma", fn.luma(F.col("r"), F.col("g"), F.col("b")))
    blocks = df.groupBy("clip", "frame", F.expr("x div 2"), F.expr("y div 2")).agg(F.avg(F.col("b") - F.col("luma")).alias("cb"), F.avg(F.col("r") - F.col("luma")).alias("cr"))
    level = {c: fn.half_up_10bit(F.col(c) * (fn.TV_10BIT["chroma"] / (2 * (1 - k))) + fn.TV_10BIT["zero"]) for c, k in (("cb", fn.KB), ("cr", fn.KR))}
    return blocks.groupBy("clip", "frame").agg(F.count("*").alias("blocks"), *[F.sum(x).alias(c) for c, x in level.items()])


# ---------------------------------------------------------------- other


@query("""WITH f AS (SELECT label::BIGINT AS clip, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS frame, embedding AS e FROM embeddings), u AS (SELECT clip, frame, i, e[i + 1]::DOUBLE AS v FROM f, range(64) t(i))
SELECT clip, frame, CASE WHEN any_value(m) > 0 THEN (min(i) FILTER (WHERE v = m) % 8)::BIGINT ELSE -1 END AS x, CASE WHEN any_value(m) > 0 THEN (min(i) FILTER (WHERE v = m) // 8)::BIGINT ELSE -1 END AS y, round(any_value(m), 6) AS peak FROM (SELECT *, max(v) OVER (PARTITION BY clip, frame) AS m FROM u) GROUP BY clip, frame""")
def heatmap_peak(spark, d):
    p = v.pose(spark, d).withColumn("peak", F.array_max("e")).withColumn("at", F.array_position("e", F.col("peak")) - 1)
    on = lambda c: F.when(F.col("peak") > 0, c).otherwise(-1).cast("long")
    return p.select("clip", "frame", on(F.col("at") % 8).alias("x"), on(F.floor(F.col("at") / 8)).alias("y"), F.round(F.col("peak").cast("double"), 6).alias("peak"))


@query(f"""WITH {v.BOXES_SQL}, c AS (SELECT clip, frame AS t FROM boxes WHERE frame % 7 = 0),
n AS (SELECT b.clip, b.frame, t, t = max(t) FILTER (WHERE t < b.frame) OVER w OR t = min(t) FILTER (WHERE t >= b.frame) OVER w AS near FROM boxes b JOIN c USING (clip) WINDOW w AS (PARTITION BY b.clip, b.frame)),
k AS (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY coalesce(near, false) DESC, abs(t - frame), t) AS place FROM n)
SELECT clip, frame, string_agg(t::VARCHAR, ',' ORDER BY t) AS chosen FROM k WHERE place <= 3 GROUP BY clip, frame""")
def closest_conditioning(spark, d):
    b = v.boxes(spark, d).select("clip", "frame")
    near = sequence.closest_conditioning(b, b.where("frame % 7 = 0"), 3)
    return near.groupBy("clip", "frame").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("chosen"))


@query(_IOU_SQL + " SELECT clip, count(*) AS flagged FROM iou WHERE v < 0.3 GROUP BY clip")
def stream_subject_switch(spark, d):
    return twin.subject_switch(spark, f"{d}/events.parquet")


@query(_IOU_SQL + " SELECT clip, count(*) AS flagged FROM iou WHERE v < 0.3 GROUP BY clip")
def stream_subject_switch_ordered(spark, d):
    """The same by event time: the events come in files that mix all times, and a closing event lets the watermark pass them."""
    events = v.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg((F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).alias("s"), F.max("ts").alias("last")).first()
    folder = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    events.repartition(3, F.xxhash64("event_id")).write.parquet(folder)
    closing = events.limit(1).select(*[F.lit(-1).cast("long").alias(c) if c in ("user_id", "event_id") else F.col(c) for c in events.columns])
    ahead = F.timestamp_seconds(F.unix_seconds(F.lit(span["last"])) + 2 * span["s"] + 60)
    closing.withColumn("ts", ahead).coalesce(1).write.mode("append").parquet(folder)
    found, _ = ordered.judged(spark, folder, events.schema, f"{span['s'] + 1} seconds", files=2)
    return found.where("switched").groupBy("clip").agg(F.count("*").alias("flagged"))

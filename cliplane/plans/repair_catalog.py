"""Queries of the rules that repair tracks, and of the driving masks of animation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplane.operators import depths, driving, masks, repairs
from cliplane.plans.catalog import query, rounded
from cliplane.sources import views as v

MW, MH = 48, 50


def _births(px):
    return px.groupBy("clip").agg(F.min("frame").alias("birth")), px.groupBy("clip").agg((F.max("frame") + 1).alias("n"))


@query()
def track_gained(spark, d):
    px = v.figures(spark, d)
    births, n = _births(px)
    return rounded(repairs.gained(px, births, n, 32, 24), "share")


@query()
def track_lost_for_good(spark, d):
    px = v.figures(spark, d)
    return rounded(repairs.lost_for_good(px, _births(px)[0], 32, 24), "share")


@query()
def region_points(spark, d):
    return depths.region_points(v.figures(spark, d), 32, 24)


_STORED = "st AS (SELECT user_id % 10 AS clip, event_id % 200 AS frame, max(value) / 490 AS score FROM events WHERE event_id % 3 > 0 GROUP BY 1, 2), fr AS (SELECT DISTINCT user_id % 10 AS clip, event_id % 200 AS frame FROM events)"


def _stored(spark, d):
    e = v.table(spark, d, "events").selectExpr("user_id % 10 AS clip", "event_id % 200 AS frame", "event_id", "value")
    return e.select("clip", "frame").distinct(), e.where("event_id % 3 > 0").groupBy("clip", "frame").agg(((F.max("value") / 490 - 0.5) * 2).alias("score"))


_KEPT = f"""WITH {_STORED.replace("max(value) / 490", "(max(value) / 490 - 0.5e0) * 2")}, ps AS (SELECT * FROM st WHERE score > 0.01e0 AND frame > 0),
rk AS (SELECT fr.clip, fr.frame, ps.frame AS t, row_number() OVER (PARTITION BY fr.clip, fr.frame ORDER BY ps.frame DESC) AS k FROM fr JOIN ps ON ps.clip = fr.clip AND ps.frame <= fr.frame),
kp AS (SELECT clip, frame, t FROM rk WHERE k <= 4 UNION SELECT fr.clip, fr.frame, st.frame FROM fr JOIN st ON st.clip = fr.clip AND st.frame BETWEEN fr.frame - 6 AND fr.frame)"""


@query(_KEPT + " SELECT clip, frame, t FROM kp")
def memory_kept(spark, d):
    frames, stored = _stored(spark, d)
    return repairs.kept_memory(frames, stored, 6, 4)


@query(_KEPT + """ SELECT clip, frame, t, frame - row_number() OVER w AS place, row_number() OVER w < count(*) OVER (PARTITION BY clip, frame) AS pointer FROM kp WINDOW w AS (PARTITION BY clip, frame ORDER BY t DESC)""")
def memory_places(spark, d):
    frames, stored = _stored(spark, d)
    return repairs.memory_places(repairs.kept_memory(frames, stored, 6, 4))


def _conditions(spark, d):
    frames, _ = _stored(spark, d)
    base = frames.where("frame % 17 = clip")
    return frames, base, base.where("frame % 5 > 0 OR frame < 40"), base.where("frame % 51 = clip AND clip % 2 = 0")


_SEEN = f"""WITH {_STORED}, cb AS (SELECT clip, frame AS t FROM fr WHERE frame % 17 = clip), cc AS (SELECT * FROM cb WHERE t % 5 > 0 OR t < 40),
nb AS (SELECT fr.clip, fr.frame, 1 AS pass, t FROM fr JOIN cc USING (clip) UNION ALL SELECT fr.clip, fr.frame, 2, t FROM fr JOIN cb USING (clip)),
nr AS (SELECT *, coalesce(t = max(t) FILTER (WHERE t < frame) OVER w OR t = min(t) FILTER (WHERE t >= frame) OVER w, false) AS beside FROM nb WINDOW w AS (PARTITION BY clip, frame, pass)),
ch AS (SELECT *, row_number() OVER (PARTITION BY clip, frame, pass ORDER BY beside DESC, abs(t - frame), t) <= 4 AS chosen FROM nr),
vw AS (SELECT clip, frame, pass, coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (WHERE chosen), '') AS c, coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (WHERE NOT chosen AND t < frame), '') AS m FROM ch GROUP BY 1, 2, 3)"""


@query(_SEEN + " SELECT clip, frame, c AS conditions, m AS memory FROM vw WHERE pass = 1")
def second_pass_view(spark, d):
    frames, _, conditions, _ = _conditions(spark, d)
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda t: t.cast("string")), ",").alias(c)
    return repairs.second_view(frames, conditions, 4, False).select("clip", "frame", text("conditions"), text("memory"))


@query(_SEEN + """, rf AS (SELECT clip, frame AS t FROM fr WHERE frame % 51 = clip AND clip % 2 = 0),
tc AS (SELECT DISTINCT nr.clip, nr.frame FROM nr JOIN ch USING (clip, frame, pass, t) JOIN rf USING (clip, t) WHERE pass = 1 AND (chosen OR t < nr.frame)),
df AS (SELECT a.clip, a.frame FROM vw a JOIN vw b ON a.clip = b.clip AND a.frame = b.frame AND a.pass = 1 AND b.pass = 2 WHERE a.c <> b.c OR a.m <> b.m)
SELECT clip, min(frame) AS frame FROM (SELECT * FROM tc UNION ALL SELECT * FROM df) GROUP BY clip""")
def first_influenced(spark, d):
    """Even clips have refined frames among their conditioning frames, some of which come before the first other view."""
    frames, base, conditions, refined = _conditions(spark, d)
    return repairs.first_influenced(frames, conditions, base, refined, 4)


# ---------------------------------------------------------------- driving masks


@query(f"""WITH {v.MASK_SQL}, h AS (SELECT clip, frame, x // 2 AS x, y // 2 AS y FROM px GROUP BY 1, 2, 3, 4 HAVING count(*) = 4), k AS (SELECT clip, frame, 4 * count(*) AS kept FROM h GROUP BY 1, 2), a AS (SELECT clip, frame, count(*) AS n FROM px GROUP BY 1, 2)
SELECT a.clip, a.frame, round(coalesce(kept, 0) / n::DOUBLE, 6) AS latent_kept FROM a LEFT JOIN k USING (clip, frame)""")
def driving_kept(spark, d):
    return rounded(driving.latent_kept(v.mask_px(spark, d)), "latent_kept")


#: The figure's half-size pixels that are whole, and the two by two cells of 8 x 6 of those, which are 16 x 12 pixels each.
_FIGURE = """fr AS (SELECT user_id AS clip, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS frame FROM events),
fg AS (SELECT clip, frame, x, y FROM fr, range(22) a(x), range(20) c(y) WHERE x BETWEEN 2 AND 9 OR x >= 10 AND y BETWEEN 2 AND 13 AND (frame + clip) % 13 NOT IN (5, 6)),
hf AS (SELECT clip, frame, x // 2 AS x, y // 2 AS y FROM fg GROUP BY 1, 2, 3, 4 HAVING count(*) = 4), cl AS (SELECT clip, frame, x // 8 AS i, y // 6 AS k FROM hf GROUP BY 1, 2, 3, 4 HAVING count(*) >= 24)"""


@query(f"WITH {_FIGURE} SELECT clip, frame, 192 * count(*) AS pixels FROM cl GROUP BY 1, 2")
def driving_reading(spark, d):
    return driving.readings(v.figures(spark, d), 32, 24).select("clip", "frame", F.size("on").cast("long").alias("pixels"))


_DRIVING = f"""WITH {v.MASK_SQL}, n AS (SELECT clip, frame, count(*) AS n FROM px GROUP BY 1, 2)"""


@query(_DRIVING + " SELECT clip, frame, CASE WHEN clip % 2 = 0 THEN 'animation' ELSE 'replacement' END AS mode, (CASE WHEN clip % 2 = 0 THEN 0 ELSE 2400 - n END)::BIGINT AS red, (CASE WHEN clip % 2 = 0 THEN n ELSE 2400 END)::BIGINT AS blue FROM n")
def driving_colours(spark, d):
    """Even clips in animation mode (person on black), odd ones in replacement mode (person on white)."""
    px = v.mask_px(spark, d)
    mode = F.when(F.col("clip") % 2 == 0, "animation").otherwise("replacement")
    full = driving.coloured(px, px, MW, MH, mode)
    return full.groupBy("clip", "frame", "mode").agg(F.sum(F.col("rgb")[0]).cast("long").alias("red"), F.sum(F.col("rgb")[2]).cast("long").alias("blue"))


@query(f"""WITH RECURSIVE {v.COARSE_SQL}, {v.TORN_SQL}, r AS (SELECT clip, frame FROM px WHERE frame > 0 GROUP BY 1, 2), a AS (SELECT clip, frame, count(*) AS n FROM big GROUP BY 1, 2)
SELECT r.clip, r.frame AS "index", round(coalesce(n, 0) / 2400e0, 6) AS area, CASE WHEN n IS NULL THEN 'reference_empty' WHEN torn THEN 'reference_fragmented' ELSE '' END AS flags FROM r LEFT JOIN a USING (clip, frame) LEFT JOIN tn USING (clip, frame)""")
def extra_references(spark, d):
    """Each frame but the first as an extra reference: some whole, some torn, some empty."""
    coarse = v.coarse_px(spark, d).where("frame > 0")
    frames = v.mask_px(spark, d).where("frame > 0").select("clip", "frame").distinct()
    found = driving.extra_references(coarse, frames, masks.fragments(coarse, MW, MH), MW, MH)
    return rounded(found.withColumn("flags", F.array_join("flags", ",")), "area")

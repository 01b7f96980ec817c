"""Queries of the driving guard as a whole: driving frames, reference, extra references, report and record."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplane.operators import driving_guard as dg

from cliplane.plans.catalog import query, rounded
from cliplane.plans.guard_catalog import _frames, _report_sql
from cliplane.sources import views as v

MW, MH = 48, 50
W, H = v.WIDTH, v.HEIGHT


def _clips(spark, d):
    """Even clips in animation mode, odd ones in replacement mode."""
    every = v.mask_px(spark, d).select("clip", "frame").distinct()
    return every, every.select("clip").distinct().withColumn("mode", F.when(F.col("clip") % 2 == 0, "animation").otherwise("replacement"))


def _parts(spark, d, posed=None):
    """Clip 3 has nobody on its driving frames; the reference is frame 3 of a clip, extra references are its frames 5 to 8."""
    coarse = v.coarse_px(spark, d)
    every, clips = _clips(spark, d)
    driving = coarse.where("clip < 3")
    rows = dg.driving_rows(driving, every, MW, MH, posed)
    first = driving.where("frame = 0").select("clip", "x", "y")
    reference = dg.reference_record(coarse.where("frame = 3").select("clip", "x", "y"), clips, (MW, MH), first, (MW, MH))
    number = F.col("frame") - 4
    extra = dg.extra_records(coarse.where("frame BETWEEN 5 AND 8").withColumn("frame", number), every.where("frame BETWEEN 5 AND 8").withColumn("frame", number), (MW, MH))
    return rows, reference, extra


#: Pieces of every frame with their shares of the largest, as fragments are reported.
_PARTS = f"""WITH RECURSIVE {v.COARSE_SQL}, {v.TORN_SQL}, fg AS (SELECT p.clip, p.frame, round(p.n / m.n::DOUBLE, 4) AS share FROM pc p JOIN pc m ON m.clip = p.clip AND m.frame = p.frame AND m.k = 1
  WHERE p.k > 1 AND NOT (p.lft AND m.lft) AND NOT (p.tp AND m.tp) AND round(p.n / m.n::DOUBLE, 4) >= 0.01e0),
sh AS (SELECT clip, frame, '[' || string_agg(share::VARCHAR, ', ' ORDER BY share DESC) || ']' AS shares, max(share) AS top FROM fg GROUP BY 1, 2), every AS (SELECT clip, frame FROM px GROUP BY 1, 2), ar AS (SELECT clip, frame, count(*) AS n FROM big GROUP BY 1, 2),
hf AS (SELECT clip, frame, 4 * count(*) AS kept FROM (SELECT clip, frame, x // 2 AS x, y // 2 AS y FROM big GROUP BY 1, 2, 3, 4 HAVING count(*) = 4) GROUP BY 1, 2),
fl AS (SELECT clip, 'no_driving_person' AS "check", frame FROM every WHERE clip = 3 UNION ALL SELECT clip, 'driving_empty', frame FROM every LEFT JOIN ar USING (clip, frame) WHERE clip < 3 AND n IS NULL UNION ALL SELECT clip, 'driving_fragmented', frame FROM tn WHERE clip < 3 AND torn),
fn AS (SELECT clip, count(*) AS n FROM every GROUP BY 1)"""
_DRIVING = _report_sql(_PARTS, "driving mask").replace("'mask_leak') THEN 'warning'", "'mask_leak', 'driving_empty') THEN 'warning'")
_HEAD, _LAST = _DRIVING.split("\nSELECT clip, coalesce(checks, 0) = 0 AS passed")
_SAYS = "CASE f WHEN 'reference_empty' THEN 'no pixel of the mask is the character''s (blue)' WHEN 'reference_fragmented' THEN 'a detached region of ' || format('{:.3f}', round(top::DECIMAL(18, 9), 3)::DOUBLE) || ' of the character''s largest one' ELSE 'IoU ' || format('{:.3f}', round(iou::DECIMAL(18, 9), 3)::DOUBLE) || ' with the person on the first driving frame; replacement expects both posed and placed alike' END"
_NUMBER = lambda c: f"coalesce(format('{{:.3f}}', round({c}::DECIMAL(18, 9), 3)::DOUBLE), 'n/a')"
_REPORT = f"""{_HEAD}, rp AS (SELECT clip, coalesce(checks, 0) = 0 AS passed{_LAST}),
o AS (SELECT clip, count(*) AS own, max(y) - min(y) + 1 AS high FROM big WHERE frame = 3 GROUP BY 1), t AS (SELECT clip, count(*) AS oth, max(y) - min(y) + 1 AS high FROM big WHERE frame = 0 AND clip < 3 GROUP BY 1),
cm AS (SELECT a.clip, count(*) AS n FROM big a JOIN big b ON a.clip = b.clip AND a.x = b.x AND a.y = b.y WHERE a.frame = 3 AND b.frame = 0 GROUP BY 1),
rf AS (SELECT c.clip, CASE WHEN c.clip % 2 = 0 THEN 'animation' ELSE 'replacement' END AS mode, coalesce(own, 0) AS own, CASE WHEN own > 0 AND oth > 0 THEN coalesce(cm.n, 0) / (own + oth - coalesce(cm.n, 0))::DOUBLE END AS iou, o.high / t.high::DOUBLE AS scale, coalesce(shares, '[]') AS shares, top
  FROM fn c LEFT JOIN o USING (clip) LEFT JOIN t USING (clip) LEFT JOIN cm USING (clip) LEFT JOIN (SELECT * FROM sh WHERE frame = 3) USING (clip)),
fs AS (SELECT *, list_filter([CASE WHEN own = 0 THEN 'reference_empty' END, CASE WHEN top >= 0.05e0 THEN 'reference_fragmented' END, CASE WHEN mode = 'replacement' AND iou < 0.4e0 THEN 'reference_misaligned' END], lambda x: x IS NOT NULL) AS flags FROM rf),
fx AS (SELECT clip, string_agg(chr(10) || '- ' || f || CASE WHEN f = 'reference_empty' THEN ' (fail)' ELSE ' (warning)' END || ': reference 0: ' || {_SAYS}, '' ORDER BY i) AS lines FROM (SELECT *, unnest(flags) AS f, unnest(range(len(flags))) AS i FROM fs) GROUP BY 1),
ex AS (SELECT e.clip, e.frame - 4 AS i, coalesce(n, 0) AS n, coalesce(shares, '[]') AS shares, top FROM every e LEFT JOIN ar USING (clip, frame) LEFT JOIN sh USING (clip, frame) WHERE e.frame BETWEEN 5 AND 8),
el AS (SELECT clip, bool_or(n = 0) AS worse, string_agg(chr(10) || 'reference ' || i || ' mask (extra, on black): area ' || format('{{:.3f}}', round((n / 2400e0)::DECIMAL(18, 9), 3)::DOUBLE) || ', fragments ' || shares
  || CASE WHEN n = 0 THEN chr(10) || '- reference_empty (fail): reference ' || i || ': no pixel of the mask is the character''s (blue)' ELSE '' END
  || CASE WHEN top >= 0.05e0 THEN chr(10) || '- reference_fragmented (warning): reference ' || i || ': a detached region of ' || format('{{:.3f}}', round(top::DECIMAL(18, 9), 3)::DOUBLE) || ' of the character''s largest one' ELSE '' END, '' ORDER BY i) AS lines FROM ex GROUP BY 1),
al AS (SELECT *, rp.passed AND own > 0 AND NOT coalesce(worse, false) AS ok, fx.lines AS own_lines, el.lines AS extra_lines FROM fs JOIN rp USING (clip) LEFT JOIN fx USING (clip) LEFT JOIN el USING (clip))
SELECT clip, ok AS passed, 'Driving guard: ' || CASE WHEN ok THEN 'passed' ELSE 'FAILED' END || ' - ' || mode || ' mode (the primary reference mask''s border)' || chr(10) || report || chr(10)
  || '- without pose_data, not checked: mask_empty, mask_leak, mask_attached_leak, mask_head_out, mask_limb_out, mask_loss' || chr(10)
  || 'reference 0 mask (primary): area ' || format('{{:.3f}}', round((own / 2400e0)::DECIMAL(18, 9), 3)::DOUBLE) || ', fragments ' || shares || ', cropped 0.000, IoU with driving frame 0 ' || {_NUMBER("iou")} || ', scale vs driving frame 0 ' || {_NUMBER("scale")}
  || coalesce(own_lines, '') || coalesce(extra_lines, '') AS report FROM al"""


@query(_REPORT)
def guard_driving_report(spark, d):
    rows, reference, extra = _parts(spark, d)
    return dg.report(rows, dg.driving_checks(rows, False), reference, extra)


@query(_PARTS + """ SELECT e.clip, e.frame, round(CASE WHEN e.clip < 3 THEN coalesce(n, 0) ELSE 0 END / 2400e0, 6) AS mask_area, CASE WHEN e.clip < 3 THEN coalesce(shares, '[]') ELSE '[]' END AS fragments, round(CASE WHEN e.clip < 3 AND n > 0 THEN coalesce(kept, 0) / n::DOUBLE END, 6) AS latent_kept
FROM every e LEFT JOIN ar USING (clip, frame) LEFT JOIN sh USING (clip, frame) LEFT JOIN hf USING (clip, frame)""")
def driving_measures(spark, d):
    """The measures of driving frames that need no pose."""
    rows = _parts(spark, d)[0]
    return rounded(rows.select("clip", "frame", "mask_area", dg._shares("fragments").alias("fragments"), "latent_kept"), "mask_area", "latent_kept")


def _posed(spark, d):
    """The masks and poses of clips that have both, on the masks' canvas."""
    moved = lambda c: F.transform(c, lambda p: F.struct((p["x"] * (MW / W)).alias("x"), (p["y"] * (MH / H)).alias("y"), p["c"].alias("c"))).alias(c)
    parts = v.parts(spark, d).select("clip", "frame", *[moved(c) for c in ("body", "left_hand", "right_hand", "face")])
    frames = _frames(spark, d).withColumn("box_iou_prev", F.lit(None).cast("double"))
    return dg.Posed(frames, parts)


@query()
def guard_driving_posed(spark, d):
    """With poses: the mask checks by what the latent grid reads, in the report of every clip that has frames of both."""
    posed = _posed(spark, d)
    px = v.mask_px(spark, d)
    every = px.select("clip", "frame").distinct().join(posed.frames.select("clip", "frame"), ["clip", "frame"], "left_semi")
    rows = dg.driving_rows(px.join(every, ["clip", "frame"], "left_semi"), every, MW, MH, posed)
    _, clips = _clips(spark, d)
    reference = dg.reference_record(px.where("frame = 3").select("clip", "x", "y"), clips, (MW, MH), px.where("frame = 0").select("clip", "x", "y"), (MW, MH))
    return dg.report(rows, dg.driving_checks(rows, True), reference, posed=True)


@query()
def guard_driving_record(spark, d):
    rows, reference, extra = _parts(spark, d)
    limits = {"min_reference_iou": 0.4, "draw_threshold": None, "min_mask_area": 0.15, "max_outside": 0.10, "max_leak": 0.03, "head_sides": 2.0}
    return dg.record(rows, dg.driving_checks(rows, False), reference, limits, extra)



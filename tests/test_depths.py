"""Distances inside masks against all pairs, and the anchor log against a plain loop."""

import numpy as np
import pytest

from cliplane.operators import depths
from cliplane.operators.masks import regions


@pytest.mark.parametrize("edge", [True, False])
def test_depths_are_the_nearest_off_pixels(edge):
    rng = np.random.default_rng(1)
    for _ in range(200):
        h, w = rng.integers(1, 14, 2)
        mask = rng.random((h, w)) < rng.choice([0.5, 0.8, 0.95, 1.0])
        off = np.argwhere(~np.pad(mask, 1)) - 1 if edge else np.argwhere(~mask)
        want = [[((off - (y, x)) ** 2).sum(1).min() if mask[y, x] and len(off) else 0 for x in range(w)] for y in range(h)]
        assert (depths.squared_depths(mask, edge) == want).all()


def test_points_of_a_large_disc_are_few_and_apart():
    y, x = np.mgrid[:300, :300]
    points = depths.inner_points((y - 150) ** 2 + (x - 150) ** 2 < 140**2)
    assert points[0] == (150, 150) and 3 <= len(points) <= 16
    assert all(np.hypot(a[0] - b[0], a[1] - b[1]) > 69 for i, a in enumerate(points) for b in points[:i])
    assert depths.inner_points(np.zeros((3, 3), bool)) == []


def test_points_of_stacks_equal_those_of_frames():
    """Shallow and deep masks, empty and full ones; deep ones past the shifts go through the envelope."""
    rng = np.random.default_rng(9)
    for h, w in ((1, 1), (7, 12), (24, 32), (130, 140)):
        stack = rng.random((24, h, w)) < rng.choice([0.0, 0.5, 0.9, 0.999, 1.0], (24, 1, 1))
        stack[:5] = False
        stack[1:5, h // 4 : h, : w - w // 5] = True
        deep = depths.stack_depths(stack)
        assert all((a == depths.squared_depths(m)).all() for a, m in zip(deep, stack, strict=True))
        for count in (1, 3, 16):
            got = [[(p % w, p // w) for p in row.tolist() if p >= 0] for row in depths.stack_points(deep, count)]
            assert got == [depths.inner_points(m, count) for m in stack]
    assert deep.max() > depths.SHIFTS**2
    assert depths.stack_points(depths.stack_depths(np.zeros((0, 4, 5), bool))).shape == (0, 16)


def test_points_of_many_regions_take_few_steps_of_python(monkeypatch):
    """The steps are those of the points of one region, not of all."""
    steps = []
    monkeypatch.setattr(np, "divmod", lambda *a, f=np.divmod: steps.append(1) or f(*a))
    stack = np.random.default_rng(4).random((500, 24, 32)) < 0.9
    assert (depths.stack_points(depths.stack_depths(stack)) >= 0).sum() > 2000 and len(steps) <= 16


def test_anchor_log(spark):
    rng = np.random.default_rng(5)
    h, w, slots, overlaps, track, found, want = 12, 16, [], [], [], [], {}
    for f in range(60):
        logit, mask = float(rng.choice([0.5, 0.8, 2.0])), rng.random((h, w)) < 0.5
        slots.append((0, f, logit))
        track += [(0, f, int(x), int(y)) for y, x in np.argwhere(mask)]
        n = int(rng.integers(0, 4))
        dets = sorted(zip(rng.choice([0.7, 0.8, 0.95], n).tolist(), rng.choice([0.3, 0.8, 0.9], n).tolist()), reverse=True)
        pixels = [mask & (rng.random((h, w)) < 0.8) | (rng.random((h, w)) < 0.1) for _ in dets]
        overlaps += [(0, f, d, s, o) for d, (s, o) in enumerate(dets)]
        found += [(0, f, d, int(x), int(y)) for d, p in enumerate(pixels) for y, x in np.argwhere(p)]
        fits = [d for d, (s, o) in enumerate(dets) if s >= 0.8 and o >= 0.8]
        why = "no det" if not dets else "gate" if not fits else "track score" if logit <= 0.8 else None
        row = [why is None, why, None, None, logit, None, None, None]
        if dets:
            d = fits[0] if fits else max(range(len(dets)), key=lambda k: (dets[k][1], -k))
            missed = mask & ~pixels[d]
            row[2:4], row[5] = [round(v, 4) for v in dets[d]], int(missed.sum())
            if missed.any():
                label, n = regions(missed, False)
                size = np.bincount(label.ravel())[1:]
                piece = label == 1 + size.argmax()
                off = np.argwhere(~piece)
                row[6:] = [int(size.max()), round(max(np.sqrt(((off - p) ** 2).sum(1).min()) for p in np.argwhere(piece)), 1)]
        want[f] = row
    make = spark.createDataFrame
    log = depths.anchor_log(
        make(slots, "clip long, frame long, logit double"), make(overlaps, "clip long, frame long, detection long, score double, overlap double"),
        make(track, "clip long, frame long, x long, y long"), make(found, "clip long, frame long, detection long, x long, y long"), w, h,
    )
    got = {r.frame: [r.fired, r.why, r.det_score, r.iou, r.track_logit, r.missed_px, r.missed_largest_px, r.missed_radius] for r in log.collect()}
    assert got == want and {row[1] for row in want.values()} == {None, "no det", "gate", "track score"}
    # the later of two that qualify, and no question about the track's own score
    two = make([(0, 0, 0, 0.9, 0.9), (0, 0, 1, 0.85, 0.9)], "clip long, frame long, detection long, score double, overlap double")
    rest = [make([], "clip long, frame long, x long, y long"), make([], "clip long, frame long, detection long, x long, y long")]
    last = depths.anchor_log(make([(0, 0, 0.1)], "clip long, frame long, logit double"), two, *rest, w, h, sure=0.0, first=False).collect()[0]
    assert (last.fired, last.det_score, last.missed_px) == (True, 0.85, 0)


def test_pixels_are_made_of_the_logged_detection_only(spark):
    rng = np.random.default_rng(6)
    h, w, many = 6, 8, 300
    overlaps = [(0, f, d, 0.9, float(rng.random())) for f in range(3) for d in range(many)]
    track = [(0, f, x, y) for f in range(3) for y in range(h) for x in range(w) if rng.random() < 0.7]
    holds = lambda d, x, y: (x + 3 * y + d) % 4 > 0
    make, asked = spark.createDataFrame, []
    px = make(track, "clip long, frame long, x long, y long")

    def found(wanted):
        asked.extend(tuple(r) for r in wanted.collect())
        return px.join(wanted, ["clip", "frame"]).where("(x + 3 * y + detection) % 4 > 0")

    slots = make([(0, f, 2.0) for f in range(4)], "clip long, frame long, logit double")
    log = depths.anchor_log(slots, make(overlaps, "clip long, frame long, detection long, score double, overlap double"), px, found, w, h, overlap=2.0)
    best = {f: min((-o, d) for _, g, d, _, o in overlaps if g == f)[1] for f in range(3)}
    assert sorted(asked) == [(0, f, d) for f, d in best.items()]
    want = {f: sum(not holds(d, x, y) for _, g, x, y in track if g == f) for f, d in best.items()} | {3: None}
    assert {r.frame: r.missed_px for r in log.collect()} == want

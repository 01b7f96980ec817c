"""Integer planning: chunk grids, tails, time grids and sizes. All closed forms, row by row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.functions.columns import grid_down, grid_up, half_even

LEAST_LAST = 29
#: The ladder of portrait sizes.
LADDER = {"480p": (480, 854), "720p": (720, 1280), "1080p": (1080, 1920)}


def plan_chunks(requests: DataFrame, policy: str = "fit") -> DataFrame:
    """One row for each chunk: video_id, chunk, length. Policies: fit, full, min29.

    Until the last, every chunk has full length, so what is produced before a chunk has a closed form."""
    r = requests.withColumn("full", grid_down(F.col("frames_per_chunk")))
    bad = F.col("overlap") >= F.col("full")
    r = r.withColumn("full", F.when(bad, F.raise_error(F.lit("a chunk must exceed the overlap"))).otherwise(F.col("full")))
    more = F.ceil(F.greatest(F.lit(0), F.col("total_frames") - F.col("full")) / (F.col("full") - F.col("overlap")))
    r = r.select("*", F.explode(F.sequence(F.lit(0), more.cast("int"))).alias("chunk"))
    done = F.when(F.col("chunk") == 0, 0).otherwise(F.col("full") + (F.col("chunk") - 1) * (F.col("full") - F.col("overlap")))
    need = F.col("total_frames") - done + F.when(F.col("chunk") > 0, F.col("overlap")).otherwise(0)
    fit = F.least(F.col("full"), grid_up(need))
    length = {"fit": fit, "full": F.col("full"), "min29": F.least(F.col("full"), F.greatest(fit, F.lit(LEAST_LAST)))}[policy]
    return r.select("video_id", F.col("chunk").cast("long").alias("chunk"), length.cast("long").alias("length"), "total_frames", "overlap")


def plan_text(plan: DataFrame) -> DataFrame:
    """The plan of each video as one line."""
    g = plan.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "length"))).alias("parts"), F.first("total_frames").alias("total"), F.first("overlap").alias("overlap"), F.sum("length").alias("sum"), F.count("*").alias("n"))
    made = F.col("sum") - F.col("overlap") * (F.col("n") - 1)
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["length"].cast("string")), " + "), F.format_string(" -> %d produced -> %d frames (pose %d, overlap %d)", made, "total", "total", "overlap"))
    return g.select("video_id", made.alias("produced"), text.alias("plan"))


def hold_tail(i, n):
    return F.least(i, n - 1)


def ping_pong_tail(i, n):
    """Reflected index; the edges aren't repeated."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    m = F.pmod(i, period)
    return F.when(m < n, m).otherwise(period - m)


#: Source frames that a task holds of the videos it folds side by side (one video at least).
GRID_FRAMES = 1 << 20


def _grid(step: np.ndarray, grid: np.ndarray, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(video, frame) of the grids of some videos, in their order. Time is added and taken off one step at a time, which fixes its
    rounding; the videos go side by side, so the work in Python grows with the longest of them."""
    if not (np.isfinite(step) & np.isfinite(grid) & (grid > 0)).all():
        raise ValueError("rates of videos and grids must be finite and above 0")
    order = np.argsort(-frames, kind="stable")  # those that still have frames come first
    step, grid, frames = step[order], grid[order], frames[order]
    time = np.zeros(len(frames))
    taken = np.zeros((len(frames), int(frames.max(initial=0))), np.int64)
    live = np.searchsorted(-frames, -np.arange(taken.shape[1]), "left")  # videos with more frames than so many
    for k, n in enumerate(live.tolist()):
        time[:n] += step[:n] if k else grid[:n]
        more = np.flatnonzero(time[:n] >= grid[:n])
        while len(more):
            time[more] -= grid[more]
            taken[more, k] += 1
            more = more[time[more] >= grid[more]]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    taken = taken[back]
    video, frame = np.nonzero(taken)
    times = taken[video, frame]
    return np.repeat(video, times), np.repeat(frame, times)


def counted_grid(videos: DataFrame) -> DataFrame:
    """time_grid with n, the number of frames of the video's grid, on every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, grid, frames = (batch.column(c).to_numpy() for c in ("step", "grid", "frames"))
            low = 0
            while low < len(batch):
                longest = np.maximum.accumulate(frames[low:]) * np.arange(1, len(batch) - low + 1)
                high = low + max(1, int(np.searchsorted(longest, GRID_FRAMES, "right")))
                video, frame = _grid(step[low:high], grid[low:high], frames[low:high])
                first, last = (np.searchsorted(video, video, side) for side in ("left", "right"))
                yield pa.RecordBatch.from_arrays([batch.column("video_id").take(pa.array(low + video)), pa.array(np.arange(len(video)) - first), pa.array(frame), pa.array(last - first)], names=["video_id", "out", "frame", "n"])
                low = high

    whole = videos.where("frames > 0 AND fps IS NOT NULL AND rate IS NOT NULL")
    # the videos are few bytes and the grids are not: they are dealt out before they grow
    df = whole.select("video_id", (1 / F.col("fps")).cast("double").alias("step"), (1 / F.col("rate")).cast("double").alias("grid"), F.col("frames").cast("long").alias("frames"))
    return df.repartition(F.col("video_id")).mapInArrow(run, f"video_id {videos.schema['video_id'].dataType.simpleString()}, out long, frame long, n long")


def time_grid(videos: DataFrame) -> DataFrame:
    """video_id, out, frame: source frames of the grid of `rate`: each is shown as often as a whole step of the grid has passed.

    Time is a running float sum, in the order of the frames (a closed form differs), so it is a fold over each video's frames."""
    return counted_grid(videos).drop("n")


def frame_indices(videos: DataFrame, start: int, count: int | None, step: int) -> DataFrame:
    """video_id, out, frame: what is loaded of each video: the frames of its rate's grid from the 1-based start on, cut to step * n + 1."""
    return loaded_frames(counted_grid(videos), start, count, step)


def video_info(videos: DataFrame, loaded: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row a video: what its file has and what is loaded. videos: video_id, fps, frames, width, height, rate (null: the file's);
    loaded: video_id, n; sizes: video_id, model, resolution, to_width, to_height (null: the file's own)."""
    df = videos.join(loaded, "video_id").join(sizes, "video_id")
    rate = F.coalesce("rate", "fps")
    wide, high = F.coalesce("to_width", "width"), F.coalesce("to_height", "height")
    return df.select(
        "video_id", "model", "resolution", F.when(high > wide, "portrait").otherwise("landscape").alias("orientation"),
        F.col("fps").alias("source_fps"), F.col("frames").alias("source_frame_count"), (F.col("frames") / F.col("fps")).alias("source_duration"),
        F.col("width").alias("source_width"), F.col("height").alias("source_height"), rate.alias("loaded_fps"),
        F.col("n").alias("loaded_frame_count"), (F.col("n") * (1 / rate)).alias("loaded_duration"), wide.alias("loaded_width"), high.alias("loaded_height"),
    )


def conform(videos: DataFrame) -> DataFrame:
    """The ladder size whose short edge is nearest by ratio, turned as the frame."""
    short = F.least("width", "height").cast("double")
    best = F.array_min(F.array(*[F.struct(F.abs(F.log(F.lit(float(w)) / short)).alias("far"), F.lit(k).alias("label"), F.lit(w).alias("w"), F.lit(h).alias("h")) for k, (w, h) in LADDER.items()]))
    tall = F.col("height") > F.col("width")
    return videos.withColumn("best", best).select("video_id", F.col("best.label").alias("label"), F.when(tall, F.col("best.w")).otherwise(F.col("best.h")).cast("long").alias("to_width"), F.when(tall, F.col("best.h")).otherwise(F.col("best.w")).cast("long").alias("to_height"))


def crop_box(videos: DataFrame, to_width: int, to_height: int) -> DataFrame:
    aspect = to_width / to_height
    wider = F.col("width") / F.col("height") > aspect
    w = F.when(wider, half_even(F.col("height") * aspect)).otherwise(F.col("width")).cast("long")
    h = F.when(wider, F.col("height")).otherwise(half_even(F.col("width") / aspect)).cast("long")
    return videos.select("video_id", F.floor((F.col("width") - w) / 2).alias("x"), F.floor((F.col("height") - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def center_crop(videos: DataFrame, to_width: int, to_height: int) -> DataFrame:
    old, new = F.col("width") / F.col("height"), to_width / to_height
    x = F.when(old > new, half_even((F.col("width") - F.col("width") * (new / old)) / 2)).otherwise(0).cast("long")
    y = F.when(old < new, half_even((F.col("height") - F.col("height") * (old / new)) / 2)).otherwise(0).cast("long")
    return videos.select("video_id", x.alias("x"), y.alias("y"))


def contain_box(videos: DataFrame, to_width: int, to_height: int) -> DataFrame:
    ratio = F.least(to_width / F.col("width"), to_height / F.col("height"))
    w, h = half_even(F.col("width") * ratio).cast("long"), half_even(F.col("height") * ratio).cast("long")
    return videos.select("video_id", F.floor((to_width - w) / 2).alias("x"), F.floor((to_height - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def closest_conditioning(frames: DataFrame, conditioning: DataFrame, keep: int) -> DataFrame:
    """clip, frame, t: the conditioning frames that each frame uses: the closest before it, the closest at or after it, then the
    closest of the rest (ties: the earlier).

    They are among the keep nearest on either side, which are numbered, so each frame joins at most 2 * keep rows by equality."""
    w = Window.partitionBy("clip").orderBy("frame")
    numbered = conditioning.select("clip", F.col("frame").alias("t"), F.row_number().over(w).alias("number"))
    marks = frames.select("clip", "frame").join(conditioning.select("clip", "frame").withColumn("mark", F.lit(1)), ["clip", "frame"], "left")
    before = F.coalesce(F.sum("mark").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = marks.select("clip", "frame", before.cast("int").alias("before"))
    near = near.select("clip", "frame", "before", F.explode(F.sequence(F.col("before") - keep + 1, F.col("before") + keep)).alias("number")).join(numbered, ["clip", "number"])
    next_to = F.col("number").isin(F.col("before"), F.col("before") + 1)
    first = Window.partitionBy("clip", "frame").orderBy((~next_to).cast("int"), F.abs(F.col("t") - F.col("frame")), "t")
    return near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep).select("clip", "frame", "t")


def loaded_frames(kept: DataFrame, start: int, count: int | None, step: int) -> DataFrame:
    """video_id, out, frame of the frames that are loaded: so many of the kept ones from the 1-based start on (None: the rest), cut
    to step * n + 1. A range past a video's frames is an error. kept may tell n, the number of a video's kept frames."""
    if "n" not in kept.columns:
        # counted in one pass: frames that a view explodes look small to the planner, which broadcast them to a join with their counts
        kept = kept.withColumn("n", F.count("*").over(Window.partitionBy("video_id")))
    last = F.lit(start if count is None else start + count - 1)
    n = F.when(last > F.col("n"), F.raise_error(F.format_string("frames %d to %d of video %s, which has %d", F.lit(start), last, "video_id", "n")).cast("long"))
    n = n.otherwise((F.col("n") - start + 1) if count is None else F.lit(count).cast("long"))
    kept = kept.withColumn("n", F.floor((n - 1) / step) * step + 1)
    place = F.col("out") - (start - 1)
    return kept.where((place >= 0) & (place < F.col("n"))).select("video_id", place.alias("out"), "frame")


def face_window(boxes: DataFrame, image: tuple[int, int], size: tuple[int, int], factor: float, headroom: float = 0.4) -> DataFrame:
    """clip, frame, x, y, w, h, used: the window of an image around a face box (x1..y2) that is enlarged to size. The factor is
    lowered until the whole box fits; above the box there are at most headroom box heights; the window is moved into the image."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    used = F.least(F.lit(float(factor)), size[0] / wide, size[1] / high)
    w, h = half_even(size[0] / used), half_even(size[1] / used)
    x = half_even((F.col("x1") + F.col("x2")) / 2 - w / 2)
    y = half_even(F.col("y1") - F.least(F.greatest(h - high, F.lit(0.0)) / 2, headroom * high))
    inside = lambda start, side, limit: F.least(F.greatest(start, F.least(F.lit(0.0), limit - side)), F.greatest(F.lit(0.0), limit - side))
    out = {"x": inside(x, w, image[0]), "y": inside(y, h, image[1]), "w": w, "h": h}
    return boxes.select("clip", "frame", *[c.cast("long").alias(k) for k, c in out.items()], used.alias("used"))


def udp_crop(boxes: DataFrame, size: tuple[int, int] = (768, 1024), padding: float = 1.25) -> DataFrame:
    """clip, frame, cx, cy, sx, sy, ax, bx, ay, by: centre and sides of the padded crop with size's aspect around a box, and the map
    from frame to crop pixels (x * ax + bx, y * ay + by), which takes the crop's corners to the middles of the corner pixels."""
    w, h = (F.col("x2") - F.col("x1")) * padding, (F.col("y2") - F.col("y1")) * padding
    aspect = size[0] / size[1]
    wide = w > h * aspect
    df = boxes.select("clip", "frame", ((F.col("x1") + F.col("x2")) * 0.5).alias("cx"), ((F.col("y1") + F.col("y2")) * 0.5).alias("cy"), F.when(wide, w).otherwise(h * aspect).alias("sx"), F.when(wide, w / aspect).otherwise(h).alias("sy"))
    df = df.withColumns({"ax": F.try_divide(F.lit(size[0] - 1.0), "sx"), "ay": F.try_divide(F.lit(size[1] - 1.0), "sy")})
    return df.withColumns({"bx": F.col("ax") * (0.5 * F.col("sx") - F.col("cx")), "by": F.col("ay") * (0.5 * F.col("sy") - F.col("cy"))})


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its power series on the side of the middle where that closes fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > 0.5:
        return 1.0 - beta_share(1.0 - x, b, a)
    term, total = 1.0, 1.0 / a
    for n in range(1, 200):
        term *= (n - b) / n * x
        total += term / (a + n)
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * x**a * total


def beta_sigmas(steps: int, shift: float, denoise: float = 1.0, alpha: float = 0.6, beta: float = 0.6) -> list[float]:
    """Noise levels of a sampler: quantiles of the beta distribution between 1 and a thousandth that is shifted twice, then 0; with
    denoise under 1 the end of a longer schedule."""
    total = int(steps / denoise) if 0 < denoise < 1 else steps
    least = 1 / 1000
    for _ in range(2):
        least = shift * least / (1 + (shift - 1) * least)
    levels = []
    for k in range(total):
        q, lo, hi = 1 - k / (total - 1) if total > 1 else 1.0, 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if beta_share(mid, alpha, beta) < q else (lo, mid)
        levels.append(least + hi * (1 - least))
    return [*levels, 0.0][-(steps + 1) :]

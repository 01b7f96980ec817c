"""Frame sequences as files: a data source that reads and writes uncompressed pictures in ranges of frames.

A file holds binary PPM pictures one after the other. A segment is a stretch of a file with consecutive frames of one clip, all of one
size, so the place of every frame is known: a range of frames is read without what stands before it. A comment in each picture's head
holds the exact rate and how far the picture is turned. A task writes its segments one behind the other to few files, each with an
index of its segments beside it; the table's list names the files of tasks that succeeded, not their segments. Tasks read stretches of
bytes of a file, or several small files: the driver sees names and sizes and opens no picture. A file that no list names is a clip.

Reading gives (clip, frame, width, height, rate_num, rate_den, pixels); pixels are RGB bytes row by row. Options: `range_frames`,
frames that no two tasks share; `task_bytes`, about how many bytes a task reads; `file_bytes`, after how many a writing task begins a
new file; `upright`, whether turned pictures are turned back (default true); `info`, one row a segment without pixels instead of
frames. Files are opened through Arrow's file systems, so paths may be URIs of stores that those know.

    register(spark)
    frames.write.format("frame_sequence").mode("append").save(path)
    spark.read.format("frame_sequence").load(path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "clip bigint, frame bigint, width int, height int, rate_num bigint, rate_den bigint, pixels binary"
INFO = "path string, clip bigint, first bigint, frames bigint, width int, height int, rate_num bigint, rate_den bigint, turns int"
LISTING, SEGMENT, INDEX = "_segments.json", ".ppms", ".index"
RANGE_FRAMES = 64
#: Bytes that a task reads, and those after which a task that writes begins a new file (a range, and a picture, at least).
TASK_BYTES, FILE_BYTES = 8 << 20, 256 << 20
#: Bytes of pictures that a batch may hold (one picture at least).
BATCH_BYTES = 8 << 20
HEAD_BYTES = 256


@dataclass(frozen=True)
class Head:
    """What a segment's first picture says: sides, rate, quarter turns, and bytes of a picture with its head."""

    width: int
    height: int
    rate_num: int
    rate_den: int
    turns: int
    size: int
    step: int


def head(width: int, height: int, rate: tuple[int, int], turns: int = 0) -> bytes:
    return b"P6\n# rate %d/%d turns %d\n%d %d\n255\n" % (*rate, turns, width, height)


def read_head(raw: bytes, path: str = "") -> Head:
    """The head of a picture; without a rate it is 1/1, without turns it stands upright."""
    words, rate, turns, at = [], (1, 1), 0, 0
    while len(words) < 4:
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"{path}: not a sequence of binary pictures")
        line, at = raw[at:end], end + 1
        if line.startswith(b"#"):
            part = line[1:].split()
            if len(part) == 4 and part[0] == b"rate" and part[2] == b"turns":
                rate, turns = tuple(int(n) for n in part[1].split(b"/")), int(part[3]) % 4
            continue
        words += line.split()
    if words[0] != b"P6" or words[3] != b"255" or len(words) != 4:
        raise ValueError(f"{path}: pictures must be P6 with 255 levels")
    width, height = int(words[1]), int(words[2])
    return Head(width, height, *rate, turns, at, at + 3 * width * height)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Stretch:
    """Bytes of a file, whose first ones are no earlier than low and earlier than high; clip and first of a file without an index."""

    path: str
    size: int
    low: int
    high: int
    indexed: bool
    clip: int
    first: int


@dataclass(frozen=True)
class Stretches(InputPartition):
    parts: tuple[Stretch, ...]


#: What an index tells of each segment: clip and first frame, first byte, frames, what a Head says, and whether the clip is null.
COLUMNS = ["clip", "first", "begin", "frames", "width", "height", "rate_num", "rate_den", "nameless", "turns", "size", "step"]


def files(path: str) -> list[Stretch]:
    """The files of a folder (those that its list names, or without one all) or one file, each as a whole."""
    store, place = _open(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [Stretch(place, info.size, 0, info.size, False, 0, 0)]
    inside = store.get_file_info(fs.FileSelector(place))
    if store.get_file_info(f"{place}/{LISTING}").type == fs.FileType.File:
        with store.open_input_stream(f"{place}/{LISTING}") as f:
            found = json.loads(f.read())
        size = {x.base_name: x.size for x in inside}
        # a list of an earlier version names a file for each segment, with its clip and first frame
        return [Stretch(f"{place}/{s['name']}", size[s["name"]], 0, size[s["name"]], "clip" not in s, s.get("clip", 0), s.get("first", 0)) for s in found]
    plain = sorted((x.path, x.size) for x in inside if x.path.endswith(SEGMENT))
    return [Stretch(name, n, 0, n, False, k, 0) for k, (name, n) in enumerate(plain)]


def segments(store: fs.FileSystem, file: Stretch) -> dict[str, np.ndarray]:
    """COLUMNS of a file's segments in the order of their bytes: those of its index, or the one segment that its first head tells."""
    if file.indexed:
        with store.open_input_file(file.path + INDEX) as f:
            table = pa.ipc.open_file(f).read_all()
        return {c: table.column(c).to_numpy() for c in COLUMNS}
    with store.open_input_file(file.path) as f:
        h = read_head(f.read(HEAD_BYTES), file.path)
    if file.size % h.step:
        raise ValueError(f"{file.path}: {file.size} bytes are no whole number of pictures of {h.step}")
    values = [file.clip, file.first, 0, file.size // h.step, h.width, h.height, h.rate_num, h.rate_den, 0, h.turns, h.size, h.step]
    return {c: np.array([v], np.int64) for c, v in zip(COLUMNS, values, strict=True)}


def ranges(found: dict[str, np.ndarray], most: int, low: int, high: int) -> dict[str, np.ndarray]:
    """Segments cut to ranges of so many frames, those that begin in a stretch of bytes."""
    cuts = -(-found["frames"] // most)
    of = np.repeat(np.arange(len(cuts)), cuts)
    past = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * most
    out = {c: x[of] for c, x in found.items()}
    out |= {"first": out["first"] + past, "begin": out["begin"] + past * out["step"], "frames": np.minimum(out["frames"] - past, most)}
    keep = (out["begin"] >= low) & (out["begin"] < high)
    return {c: x[keep] for c, x in out.items()}


def _binary(rows: np.ndarray) -> pa.BinaryArray:
    """Rows of bytes, all of one length, as a column."""
    n, size = rows.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


class FrameReader(DataSourceReader):
    def __init__(self, path: str, ranges: int, upright: bool, info: bool, task_bytes: int) -> None:
        self.path, self.ranges, self.upright, self.info, self.task_bytes = path, ranges, upright, info, task_bytes

    def partitions(self) -> list[Stretches]:
        """Stretches of about task_bytes; small files share a task."""
        out, now, held = [], [], 0
        for f in files(self.path):
            # whole files for info, of which a task reads heads and indices: as if these were a hundredth
            for low in range(0, 1 if self.info else max(f.size, 1), self.task_bytes):
                high = f.size if self.info else min(low + self.task_bytes, f.size)
                now.append(Stretch(f.path, f.size, low, high, f.indexed, f.clip, f.first))
                held += HEAD_BYTES + (high - low) // (100 if self.info else 1)
                if held >= self.task_bytes:
                    out.append(Stretches(tuple(now)))
                    now, held = [], 0
        return out + [Stretches(tuple(now))] if now else out

    def read(self, part: Stretches | None) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        for file in part.parts if part is not None else ():  # None: nothing to read
            found = segments(store, file)
            if self.info:
                kinds = {"path": pa.string(), **{c: pa.int32() if c in ("width", "height", "turns") else pa.int64() for c in COLUMNS}}
                found["path"] = np.full(len(found["clip"]), file.path, object)
                names = [c.split()[0] for c in INFO.split(", ")]
                nulls = {"clip": found["nameless"] > 0}
                yield pa.RecordBatch.from_arrays([pa.array(found[c], kinds[c], mask=nulls.get(c)) for c in names], names=names)
            else:
                yield from self._frames(store, file, ranges(found, self.ranges, file.low, file.high))

    def _frames(self, store: fs.FileSystem, file: Stretch, found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The frames of ranges; ranges that follow one another and are alike are read together."""
        if not len(found["begin"]):
            return
        alike = np.diff(found["begin"]) == (found["frames"] * found["step"])[:-1]
        for c in COLUMNS[4:]:
            alike &= np.diff(found[c]) == 0
        starts = np.append(0, np.flatnonzero(~alike) + 1).tolist()
        with store.open_input_file(file.path) as f:
            for a, b in zip(starts, [*starts[1:], len(found["begin"])], strict=True):
                h = {c: int(found[c][a]) for c in COLUMNS[2:]}
                count = found["frames"][a:b]
                clip, place = np.repeat(found["clip"][a:b], count), np.arange(count.sum())
                frame = np.repeat(found["first"][a:b] - (np.cumsum(count) - count), count) + place
                many = max(1, BATCH_BYTES // h["step"])
                for k in range(0, len(place), many):
                    n = min(many, len(place) - k)
                    f.seek(h["begin"] + k * h["step"])
                    raw = np.frombuffer(f.read(n * h["step"]), np.uint8).reshape(n, h["step"])[:, h["size"] :]
                    sides = (h["width"], h["height"])
                    if self.upright and h["turns"]:
                        raw = np.rot90(raw.reshape(n, h["height"], h["width"], 3), h["turns"], (1, 2)).reshape(n, -1)
                        sides = sides[::-1] if h["turns"] % 2 else sides
                    same = [pa.array(np.full(n, v), t) for v, t in zip((*sides, h["rate_num"], h["rate_den"]), [pa.int32()] * 2 + [pa.int64()] * 2, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(clip[k : k + n], mask=np.full(n, h["nameless"] > 0)), pa.array(frame[k : k + n]), *same, _binary(raw)], names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    found: list[str]


class SegmentFile:
    """A file that a task writes, and the index of its segments."""

    def __init__(self, store: fs.FileSystem, place: str) -> None:
        self.store, self.place, self.name, self.bytes = store, place, f"{uuid.uuid4().hex}{SEGMENT}", 0
        self.parts: list[np.ndarray] = []
        self.out = store.open_output_stream(f"{place}/{self.name}")

    def add(self, clip: np.ndarray, frame: np.ndarray, form: tuple[int, int, int, int, int], pixels: np.ndarray, follows: bool) -> None:
        """Pictures of one form (sides, rate, whether the clip is null); the first may follow the last one that was added."""
        first = np.frombuffer(head(*form[:2], form[2:4]), np.uint8)
        rows = np.empty((len(pixels), len(first) + pixels.shape[1]), np.uint8)
        rows[:, : len(first)], rows[:, len(first) :] = first, pixels
        self.out.write(rows)
        at = np.append(0, np.flatnonzero((np.diff(clip) != 0) | (np.diff(frame) != 1)) + 1)
        count = np.diff(np.append(at, len(rows)))
        if follows and self.parts:
            self.parts[-1][-1, 3] += count[0]
            at, count = at[1:], count[1:]
        if len(at):
            step = rows.shape[1]
            same = np.tile(np.array([*form, 0, len(first), step], np.int64), (len(at), 1))
            self.parts.append(np.column_stack([clip[at], frame[at], self.bytes + at * step, count, same]))
        self.bytes += rows.size

    def close(self) -> None:
        self.out.close()
        every = np.concatenate(self.parts)
        table = pa.table({c: every[:, k] for k, c in enumerate(COLUMNS)})
        with self.store.open_output_stream(f"{self.place}/{self.name}{INDEX}") as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table)


class FrameWriter(DataSourceArrowWriter):
    """Each task writes its rows to files of its own, in segments: a new one where the clip or the size changes or a frame isn't the next."""

    def __init__(self, path: str, overwrite: bool, file_bytes: int) -> None:
        self.path, self.overwrite, self.file_bytes = path, overwrite, file_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, place = _open(self.path)
        store.create_dir(place, recursive=True)
        out: list[str] = []
        file, last = None, None
        try:
            for batch in batches:
                if any(batch.column(c).null_count for c in ("frame", "width", "height", "rate_num", "rate_den")):
                    raise ValueError("a picture's frame, sides and rate must be known")
                clip, frame, *forms = [batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("clip", "frame", "width", "height", "rate_num", "rate_den")]
                forms.append(batch.column("clip").is_null().to_numpy(zero_copy_only=False).astype(np.int64))
                pixels = batch.column("pixels")
                size = pa.compute.fill_null(pa.compute.binary_length(pixels), 0).to_numpy()
                bad = np.flatnonzero(size != 3 * forms[0] * forms[1])
                if len(bad):
                    k = bad[0]
                    raise ValueError(f"clip {clip[k]} frame {frame[k]}: {size[k]} bytes are not {forms[0][k]} x {forms[1][k]} pixels")
                turns = np.any([np.diff(x) != 0 for x in forms], axis=0) if len(clip) else np.zeros(0, bool)
                starts = np.append(0, np.flatnonzero(turns) + 1).tolist() if len(clip) else []
                for low, high in zip(starts, [*starts[1:], len(clip)], strict=True):
                    form = tuple(int(x[low]) for x in forms)
                    many = max(1, min(BATCH_BYTES, self.file_bytes) // max(1, int(size[low])))
                    for a in range(low, high, many):
                        b = min(a + many, high)
                        if file is not None and file.bytes >= self.file_bytes:
                            file.close()
                            out.append(file.name)
                            file = None
                        if file is None:
                            file, last = SegmentFile(store, place), None
                        raw = np.frombuffer(b"".join(pixels.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, int(size[low]))
                        file.add(clip[a:b], frame[a:b], form, raw, last == (int(clip[a]), int(frame[a]) - 1, form))
                        last = int(clip[b - 1]), int(frame[b - 1]), form
        except BaseException:
            if file is not None:
                file.out.close()
            raise
        if file is not None:
            file.close()
            out.append(file.name)
        return Written(out)

    def commit(self, messages: list) -> None:
        store, place = _open(self.path)
        store.create_dir(place, recursive=True)
        kept: list[dict] = []
        name = f"{place}/{LISTING}"
        if not self.overwrite and store.get_file_info(name).type == fs.FileType.File:
            with store.open_input_stream(name) as f:
                kept = json.loads(f.read())
        every = kept + [{"name": s} for m in messages if m is not None for s in m.found]
        with store.open_output_stream(f"{name}.new") as f:
            f.write(json.dumps(sorted(every, key=lambda s: s["name"])).encode())
        store.move(f"{name}.new", name)

    def abort(self, messages: list) -> None:
        store, place = _open(self.path)
        for m in messages:
            for s in m.found if m is not None else ():
                store.delete_file(f"{place}/{s}")
                store.delete_file(f"{place}/{s}{INDEX}")


class FrameSequence(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_sequence"

    def _flag(self, key: str, default: str) -> bool:
        return str(self.options.get(key, default)).lower() == "true"

    def schema(self) -> str:
        return INFO if self._flag("info", "false") else SCHEMA

    def reader(self, schema) -> FrameReader:
        task_bytes = int(self.options.get("task_bytes", TASK_BYTES))
        return FrameReader(self.options["path"], int(self.options.get("range_frames", RANGE_FRAMES)), self._flag("upright", "true"), self._flag("info", "false"), task_bytes)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], overwrite, int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSequence)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """clip, frames, width, height, fps of the clips in a folder or file; sides as shown upright."""
    register(spark)
    info = spark.read.format("frame_sequence").option("info", "true").load(path)
    side = F.col("turns") % 2 == 1
    shown = info.select("clip", "frames", F.when(side, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(side, F.col("width")).otherwise(F.col("height")).alias("height"), "rate_num", "rate_den")
    return shown.groupBy("clip", "width", "height").agg(F.sum("frames").alias("frames"), (F.first("rate_num") / F.first("rate_den")).alias("fps"))


def write(frames: DataFrame, path: str, range_frames: int = RANGE_FRAMES, mode: str = "append") -> None:
    """Write frames (SCHEMA) with ranges of a clip's frames side by side, in order."""
    register(frames.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    part = F.floor(F.col("frame") / range_frames)
    frames.select(*names).repartition("clip", part).sortWithinPartitions("clip", "frame").write.format("frame_sequence").mode(mode).save(path)


def packed(pixels: DataFrame, width: int, height: int, rate: tuple[int, int] = (24, 1)) -> DataFrame:
    """SCHEMA of pictures in whole levels: pixel rows (clip, frame, x, y, r, g, b), of which every one of a frame must be there, or
    frames with arrays r, g, b, row by row."""
    if "x" in pixels.columns:
        one = F.struct((F.col("y") * width + F.col("x")).alias("at"), "r", "g", "b")
        rows = pixels.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(one)).alias("p"))
        pixels = rows.select("clip", "frame", *[F.transform("p", lambda q: q[c]).alias(c) for c in "rgb"])  # noqa: B023

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = np.stack([batch.column(c).flatten().cast(pa.int64()).to_numpy() for c in "rgb"], 1)
            if len(levels) != len(batch) * width * height:
                raise ValueError(f"a frame's pixels are not {width} x {height}")
            raw = levels.astype(np.uint8).reshape(len(batch), -1)
            ints = [pa.array(np.full(len(batch), v), t) for v, t in ((width, pa.int32()), (height, pa.int32()), (rate[0], pa.int64()), (rate[1], pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ints, pa.array([p.tobytes() for p in raw], pa.binary())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    whole = pixels.select(F.col("clip").cast("long").alias("clip"), F.col("frame").cast("long").alias("frame"), *"rgb")
    return whole.mapInArrow(run, SCHEMA)


def unpacked(frames: DataFrame) -> DataFrame:
    """clip, frame, x, y, r, g, b of frames (SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sides = whole.column("width").to_numpy().astype(np.int64) * whole.column("height").to_numpy()
            low = 0
            while low < len(whole):
                high = low + max(1, int(np.searchsorted(np.cumsum(sides[low:]), BATCH_BYTES // 8, "right")))
                batch, size = whole.slice(low, high - low), sides[low:high]
                levels = np.frombuffer(b"".join(batch.column("pixels").to_pylist()), np.uint8).reshape(-1, 3).astype(np.int64)
                of = np.repeat(np.arange(len(batch)), size)
                at, wide = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), batch.column("width").to_numpy()[of]
                keys = [batch.column(c).take(pa.array(of)) for c in ("clip", "frame")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(at % wide), pa.array(at // wide), *[pa.array(levels[:, k]) for k in range(3)]], names=["clip", "frame", "x", "y", "r", "g", "b"])
                low = high

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("clip", "frame"))
    return frames.select("clip", "frame", "width", "height", "pixels").mapInArrow(run, f"{kinds}, x long, y long, r long, g long, b long")


def selected(frames: DataFrame, indices: DataFrame) -> DataFrame:
    """Frames at the places that a time grid gives them: indices is clip, position, frame; a repeated frame is read once."""
    # pictures look small to the planner when they are made from small tables: never broadcast
    few = frames.hint("merge").join(indices.select("clip", "frame").distinct(), ["clip", "frame"], "left_semi")
    rest = [c for c in few.columns if c not in ("clip", "frame")]
    return few.hint("merge").join(indices.select("clip", "position", "frame"), ["clip", "frame"]).select("clip", "position", "frame", *rest)


def extended(frames: DataFrame, count: int, ping_pong: bool = False) -> DataFrame:
    """Each clip's frames at count positions: those past the end hold the last frame, or turn back and forth between the ends."""
    n = frames.groupBy("clip").agg((F.max("frame") + 1).alias("n"))
    place = n.select("clip", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("position"))
    turn = F.greatest(F.lit(1), 2 * (F.col("n") - 1))
    back = F.pmod(F.col("position"), turn)
    to = F.when(back < F.col("n"), back).otherwise(turn - back) if ping_pong else F.least(F.col("position"), F.col("n") - 1)
    return selected(frames, place.select("clip", "position", to.cast("long").alias("frame")))


def in_order(frames: DataFrame) -> DataFrame:
    """frames with frame numbers anew from 0 in each clip, in the order they have."""
    return frames.withColumn("frame", F.row_number().over(Window.partitionBy("clip").orderBy("frame")).cast("long") - 1)

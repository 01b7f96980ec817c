"""Lossless WebP media columns: payloads are stored as images, read back, and written as pixel arrays.

What each image uses is chosen by a hash of its payload, so every part of the format carries its share of a table: back-
references, the colour cache, several groups of prefix codes, the palette, the predictor, and cross-colour with subtracted
green. smallest() tries all of them instead and keeps the shortest file; for text that is nearly always back-references with
or without the cache.

Edge cases: null text counts as empty: one blank padding unit. Payloads over one image's height go to several images, one
after the other. Equal texts, so repeated rows too, give equal values. An empty table gives no rows. Input columns named like
an output column are replaced. A broken stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cliplane.llm.common import scan_text
from cliplane.llm.webp_decode import decode, decode_many, split
from cliplane.llm.webp_encode import Plane, best_elements, best_modes, encode, encode_many, planes

__all__ = ["decode", "decode_many", "digests", "encode", "load", "media", "pixels", "smallest", "store", "store_many"]

UNIT = 192
WIDTH = 64
MOST_ROWS = 16384
TILE = 4
FORMS = ("references", "cache", "groups", "palette", "predictor", "cross")
#: How often each form is chosen: the two that make text smallest for a quarter of the images each, every other one for an eighth.
SHARES = (2, 2, 1, 1, 1, 1)
_CHOICE = [f for f, n in zip(FORMS, SHARES, strict=True) for _ in range(n)]


def _groups_by_tile(x: np.ndarray) -> np.ndarray:
    """Two groups of tiles: those with more signs, digits and blanks than the middle tile, and the others."""
    h, w = x.shape
    across, down = (w + (1 << TILE) - 1) >> TILE, (h + (1 << TILE) - 1) >> TILE
    of = ((np.arange(h)[:, None] >> TILE) * across + (np.arange(w)[None, :] >> TILE)).ravel()
    odd = sum(((x >> np.uint32(s) & np.uint32(0xFF)) < 0x41).ravel().astype(np.float64) for s in (0, 8, 16))
    share = np.bincount(of, odd, across * down) / np.maximum(np.bincount(of, minlength=across * down), 1)
    return (share > np.median(share)).astype(np.int64).reshape(down, across)


def planned(x: np.ndarray, form: str) -> list[Plane]:
    """What a file of ARGB pixels holds in one of the FORMS (an image of too many colours for a palette takes the cache)."""
    if form == "palette" and len(np.unique(x)) <= 256:
        return planes(x, palette=True, lz=True)
    if form == "predictor":
        return planes(x, predictor=best_modes(x, TILE), green=True, tile=TILE)
    if form == "cross":
        return planes(x, cross=best_elements(x, TILE), green=True, tile=TILE, lz=True)
    if form == "groups":
        return planes(x, meta=_groups_by_tile(x), meta_tile=TILE, lz=True)
    return planes(x, cache_bits=0 if form == "references" else 6, lz=True)


def written(x: np.ndarray, form: str) -> bytes:
    return next(encode_many([planned(x, form)]))


def _images(payload: bytes) -> list[np.ndarray]:
    """The payload (a multiple of UNIT) as RGB samples of images WIDTH pixels wide."""
    argb = np.full((len(payload) // 3, 4), 0xFF, np.uint8)
    argb[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    x = argb.view(">u4").astype(np.uint32).reshape(-1, WIDTH)
    return [x[k : k + MOST_ROWS] for k in range(0, len(x), MOST_ROWS)]


def store_many(payloads: list[bytes], form: str | None = None) -> list[bytes]:
    """The files of each payload, one after the other; images of all payloads are written together."""
    images = [_images(p) for p in payloads]
    forms = [form or _CHOICE[zlib.crc32(p) % len(_CHOICE)] for p in payloads]
    files = encode_many(planned(x, f) for each, f in zip(images, forms, strict=True) for x in each)
    return [b"".join(islice(files, len(each))) for each in images]


def store(payload: bytes, form: str | None = None) -> bytes:
    return store_many([payload], form)[0]


def smallest(payload: bytes) -> bytes:
    """The shortest of all forms, image by image."""
    return b"".join(min((written(x, f) for f in FORMS), key=len) for x in _images(payload))


def load_many(media: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays [rows, WIDTH, 3] that were stored."""
    files = [split(m) for m in media]
    every = iter(decode_many([f for each in files for f in each]))
    out = []
    for each in files:
        x = np.concatenate([next(every) for _ in each])
        out.append(np.ascontiguousarray(x.astype(">u4").view(np.uint8).reshape(*x.shape, 4)[..., 1:]))
    return out


def load(media: bytes) -> np.ndarray:
    """Pixel array [rows, WIDTH, 3] that was stored."""
    return load_many([media])[0]


def padded(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def feature(pixels: np.ndarray) -> str:
    """Size and mean of each channel of the decoded pixels."""
    h, w, _ = pixels.shape
    mean = pixels.reshape(h, w * 3).sum(0, dtype=np.int64).reshape(w, 3).sum(0) * 1000 // (h * w)
    return f"{w}x{h}:" + ":".join(map(str, mean.tolist()))


FIELDS = [
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
]


def digest(text: bytes, media: bytes, pixels: np.ndarray) -> tuple:
    back = pixels.tobytes()
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)


def _different(text: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The different texts and, for each row, the place of its own."""
    seen: dict[bytes, int] = {}
    at = [seen.setdefault(t.as_py() or b"", len(seen)) for t in text.cast(pa.large_binary())]
    return list(seen), np.array(at, np.int64)


def _columns(text: pa.Array) -> list[pa.Array]:
    raw, at = _different(text)
    stored = store_many([padded(t) for t in raw])
    rows = [digest(t, m, x) for t, m, x in zip(raw, stored, load_many(stored), strict=True)]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return [pa.array([r[k] for r in rows], kind).take(pa.array(at)) for k, kind in enumerate(kinds)]


def _media(text: pa.Array) -> list[pa.Array]:
    raw, at = _different(text)
    stored = store_many([padded(t) for t in raw])
    return [pa.array([stored[k] for k in at], pa.binary())]


def _pixels(media: pa.Array) -> list[pa.Array]:
    got = iter(load_many([m.as_py() for m in media if m.is_valid]))
    got = [next(got) if m.is_valid else None for m in media]
    size = [pa.array([None if x is None else x.shape[k] for x in got], pa.int32()) for k in (0, 1)]
    return [*size, pa.array([None if x is None else x.tobytes() for x in got], pa.binary())]


def media(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with media: the stored WebP bytes."""
    return scan_text(docs, lambda: _media, [T.StructField("media", T.BinaryType())], text_col, keep)


PIXELS = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("pixels", T.BinaryType())]


def pixels(stored: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Rows with WebP bytes as height, width and pixels (RGB bytes, row by row); null media give nulls."""
    keep = [c for c in stored.columns if c != media_col] if keep is None else keep
    return scan_text(stored, lambda: _pixels, PIXELS, media_col, keep, cast=None)


def digests(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with FIELDS, all from bytes that were stored and read back."""
    return scan_text(docs, lambda: _columns, FIELDS, text_col, keep)

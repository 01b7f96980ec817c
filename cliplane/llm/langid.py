"""Language identification of mixed-language text: script ranges, word scores and Viterbi over a switching penalty.

Each word is scored by hashed byte n-grams of its lower-cased form. The script of a word narrows the languages to those
that were written in it in training. Viterbi over the words of the whole text, with a penalty for every change of
language, labels spans; the language with the most labelled bytes wins, and its share of the bytes is the score (a share,
not a probability).

The model is fitted on about LANG_ROWS documents a language: those whose hash of the id lies below a cut that follows from
the number of different ids of the language, so no task ranks a language's rows. Their whole texts are counted on the
executors; what counts is each n-gram's share of its text, so every text weighs alike whatever its length (as TEXT_GRAMS
n-grams). The driver gets sums by language and n-gram bucket. Prediction uses the text alone and covers every whole text.

Edge cases: null text, or text without a letter (Unicode categories L*), is und with score 0. Of training rows with one id
the smallest text counts. Without training rows everything is und. Repeated rows are labelled each by itself. Input columns
named like an output column are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplane.llm import tokens as tk
from cliplane.llm.common import PIECE_BYTES, lists, pieces, quoted, scan_text

LANG_ROWS = 400
#: N-grams that a training text counts as.
TEXT_GRAMS = 3000
PENALTY = 6.0
BUCKETS = 1 << 15
NGRAMS = (2, 3, 4)

_B = np.arange(256)
LETTER = ((_B >= 0x41) & (_B <= 0x5A)) | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
#: First code point of each range and the script of its letters.
SCRIPTS = ["none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han", "other"]
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "other"), (0x3005, "han"), (0x3031, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
    (0xE0000, "other"),
]


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Script of each code point, 0 where it is no letter (Unicode categories L*)."""
    points = 0x110000
    letter = np.fromiter((chr(c).isalpha() for c in range(points)), bool, points)
    at = np.searchsorted([a for a, _ in RANGES], np.arange(points), side="right") - 1
    return np.where(letter, np.array([SCRIPTS.index(s) for _, s in RANGES], np.int8)[at], np.int8(0))


class Words:
    """Words of a piece of text: runs of letter bytes that hold a letter, the script of their first letter, their n-grams."""

    def __init__(self, text: pa.Array):
        raw, off = tk.flat(text)
        starts, ends, _ = tk.spans(raw, off, LETTER)
        lead = raw[starts].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        script = np.ones(len(starts), np.int64)
        for i in np.flatnonzero(lead >= 0x80) if len(lead) and (lead >= 0x80).mean() < 0.01 else []:
            script[i] = first_script(raw[starts[i] : ends[i]].tobytes())
        if len(lead) and (lead >= 0x80).mean() >= 0.01:
            script = scripts(raw, starts, ends)
        real = script > 0
        self.starts, self.ends, self.script = starts[real], ends[real], script[real]
        self.first = np.searchsorted(self.starts, off)
        self.raw = tk.LOWER[raw]

    def at(self, some: np.ndarray) -> Words:
        out = object.__new__(Words)
        out.raw, out.starts, out.ends, out.script = self.raw, self.starts[some], self.ends[some], self.script[some]
        return out

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each n-gram of each word (with a mark at both ends), and the number of n-grams of each word."""
        size = self.ends - self.starts
        padded = np.zeros(int(size.sum()) + 2 * len(size) + max(NGRAMS), np.uint32)
        at = np.cumsum(size + 2) - (size + 2)
        inner = np.repeat(at + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
        padded[inner] = self.raw[np.repeat(self.starts - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        total = int((size + 2).sum())
        left = np.repeat(at + size + 2, size + 2) - np.arange(total)
        out, keep = [], []
        code = np.zeros(total, np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            code = code * np.uint32(0x01000193) + padded[n - 1 : n - 1 + total] + np.uint32(1)
            if n in NGRAMS:
                mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
                out.append((mixed >> np.uint32(17)) % BUCKETS)
                keep.append(left >= n)
        buckets, keep = np.stack(out, axis=1), np.stack(keep, axis=1)
        return buckets, keep


def scripts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of the first letter of each word, all words at once, character by character until one is a letter."""
    script = np.zeros(len(starts), np.int64)
    todo, at = np.arange(len(starts)), starts.copy()
    padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    while len(todo):
        b = [padded[at + k] for k in range(4)]
        point = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | b[1] & 0x3F, np.where(b[0] < 0xF0, (b[0] & 0xF) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F, (b[0] & 7) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F)))
        step = np.where(b[0] < 0x80, 1, np.where(b[0] < 0xE0, 2, np.where(b[0] < 0xF0, 3, 4)))
        script[todo] = script_table()[np.minimum(point, 0x10FFFF)]
        at = at + step
        more = (script[todo] == 0) & (at < ends[todo])
        todo, at = todo[more], at[more]
    return script


def first_script(word: bytes) -> int:
    for c in word.decode("utf-8", "replace"):
        if found := int(script_table()[ord(c)]):
            return found
    return 0


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, written: np.ndarray):
        """weights: BUCKETS x languages, log odds; written: languages x scripts, whether used in training."""
        self.langs, self.weights, self.written = langs, weights.astype(np.float32), written

    @classmethod
    def of(cls, langs: list[str], counts: np.ndarray) -> Model:
        """counts: languages x (BUCKETS + scripts), how often each n-gram bucket and each script of a word was seen."""
        count, used = counts[:, :BUCKETS], counts[:, BUCKETS:]
        share = (count + 0.5) / (count.sum(1, keepdims=True) + 0.5 * BUCKETS)
        weights = (np.log(share) - np.log(share.mean(0, keepdims=True))).T if langs else np.zeros((BUCKETS, 0))
        return cls(langs, weights, used >= 0.02 * np.maximum(used.sum(1, keepdims=True), 1))

    def word_scores(self, words: Words) -> np.ndarray:
        """Log odds of each word in each language; languages not written in its script are ruled out where others are."""
        every = tk.hashes(words.raw, words.starts, words.ends)
        _, some, of = np.unique(every, return_index=True, return_inverse=True)
        return self._scores(words.at(some))[of]

    def _scores(self, words: Words) -> np.ndarray:
        buckets, keep = words.grams()
        count = len(words.starts)
        if not count or not self.langs:
            return np.zeros((count, len(self.langs)), np.float32)
        size = words.ends - words.starts + 2
        at = np.cumsum(size) - size
        score = np.zeros((count, len(self.langs)), np.float32)
        for j in range(buckets.shape[1]):
            w = self.weights[buckets[:, j]]
            w[~keep[:, j]] = 0
            score += np.add.reduceat(w, at, axis=0)
        allowed = self.written[:, words.script].T
        some = allowed.any(1)
        return np.where(allowed | ~some[:, None], score, np.float32(-1e4))

    def paths(self, words: Words, penalty: float = PENALTY) -> np.ndarray:
        """Best language of every word. Documents advance together, one word at a time, longest first; rows lie in the order of time."""
        langs, total = len(self.langs), len(words.starts)
        if not total or langs < 2:
            return np.zeros(total, np.int64)
        count = np.diff(words.first)
        order = np.argsort(-count, kind="stable")
        longest = int(count[order[0]])
        live = np.searchsorted(-count[order], -np.arange(1, longest + 1), side="right")  # documents with more than t words
        begin = np.concatenate([[0], np.cumsum(live)])
        place = np.empty(len(count), np.int64)
        place[order] = np.arange(len(count))
        when = np.arange(total) - np.repeat(words.first[:-1], count)
        row = begin[when] + np.repeat(place, count)
        v = np.empty((total, langs), np.float32)  # scores, then the best totals up to each word, less the best of all
        v[row] = self.word_scores(words)
        floor = np.float32(-penalty)
        edges = begin.tolist()
        last = v[: edges[1]]
        last -= last.max(1, keepdims=True)
        for t in range(1, longest):
            now = v[edges[t] : edges[t + 1]]
            now += np.maximum(last[: len(now)], floor)
            now -= now.max(1, keepdims=True)
            last = now
        best = v.argmax(1)
        stay = v >= floor
        path = best.copy()  # right for the last word of a document
        every = np.arange(len(count))
        for t in range(longest - 1, 0, -1):
            a, b = edges[t], edges[t + 1]
            n, before = b - a, edges[t - 1]
            now = path[a:b]
            path[before : before + n] = np.where(stay[before + every[:n], now], now, best[before : before + n])
        return path[row]


def label(text: pa.Array, model: Model, penalty: float = PENALTY) -> list[pa.Array]:
    """lang_pred, score, and spans (lang, first and last word, end exclusive)."""
    words = Words(text)
    n, langs = len(text), len(model.langs)
    count = np.diff(words.first)
    if not langs:
        empty = pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int32())], ["lang", "start", "end"])
        return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), lists(empty, np.zeros(n, np.int64))]
    path = model.paths(words, penalty)
    doc = np.repeat(np.arange(n), count)
    mass = np.bincount(doc * langs + path, (words.ends - words.starts).astype(np.float64), n * langs).reshape(n, langs)
    best = mass.argmax(1)
    total = mass.sum(1)
    names = np.array([*model.langs, "und"], dtype=object)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(path)) if len(a) else a
    value = pa.StructArray.from_arrays([pa.array(names[path[a]], pa.string()), pa.array((a - words.first[doc[a]]).astype(np.int32)), pa.array((b - words.first[doc[a]]).astype(np.int32))], ["lang", "start", "end"])
    return [pa.array(names[np.where(total > 0, best, langs)], pa.string()), pa.array(np.where(total > 0, mass.max(1) / np.maximum(total, 1), 0.0)), lists(value, np.bincount(doc[a], minlength=n)[:n] if n else np.zeros(0, np.int64))]


def fold(doc_id: str = "doc_id"):
    return F.crc32(quoted(doc_id).cast("string")) % 3


def tally(text: pa.Array) -> np.ndarray:
    """BUCKETS + scripts of one text: the shares of its n-grams and of its words, times TEXT_GRAMS."""
    words = Words(text)
    b, keep = words.grams()
    grams, used = np.bincount(b[keep], minlength=BUCKETS), np.bincount(words.script, minlength=len(SCRIPTS))
    return np.concatenate([n * (TEXT_GRAMS / max(1, n.sum())) for n in (grams, used)])


def train(docs: DataFrame, lang_rows: int = LANG_ROWS) -> Model:
    """Fit on documents outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()  # one row a language
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, len(SCRIPTS)), bool))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, lang_rows / max(1.0, 0.9 * r["n"])))])
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    rows = known.where(pick < share[F.col("lang")]).groupBy("lang", "doc_id").agg(F.min(F.col("text").cast("string")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, 1, PIECE_BYTES):
                for k, lang in enumerate(part.column(0).to_pylist()):
                    total[lang] = total.get(lang, 0) + tally(part.column(1).slice(k, 1))
        for lang, n in total.items():
            at = np.flatnonzero(n)
            cols = [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "bucket", "n"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n double")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + scripts rows a language
    langs = sorted(r["lang"] for r in sizes)
    total = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    total[np.searchsorted(langs, got["lang"].to_numpy(str)), got["bucket"].to_numpy(int)] = np.round(got["n"].to_numpy(float), 6)
    return Model.of(langs, total)


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score and lang_spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value
        return lambda text: label(text, fitted, penalty)

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", SPANS)]
    return scan_text(docs, make, fields, text_col, keep, piece_bytes=6 << 20)

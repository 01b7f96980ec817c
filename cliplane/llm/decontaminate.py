"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded piece of a partition (PIECE_BYTES of text). Its words become symbols: 1..V for the words of the test
phrases, 0 for any other word and for the end of a document; no phrase spans a 0. The suffix array of that symbol string
gives its BWT, stored in a wavelet matrix. Test phrases are searched backwards through wavelet ranks, all at once;
their occurrences are located by LF steps to sampled suffix positions, and the hit words are merged to removal spans.

No shuffle: the documents stream through mapInArrow. The phrases are broadcast in blocks: the words of a block's items as
one stream of symbols, where each window begins, and the vocabulary. A block takes items until their own size reaches
block_bytes of what is sent (an item of its own may be larger, at about 32 bytes and its letters a word); each further block is one
more pass over the rows.

Words are looked up by 64-bit hashes; the words of every occurrence are then compared byte by byte, and an occurrence with
another word is none.

Edge cases: null or empty text has no words, no hits and no spans. A benchmark row without words (or null text) has no
phrase. Equal item ids are one item; a null id counts as the empty string. Repeated rows are judged each by itself.
An empty benchmark leaves every document clean. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplane.llm import tokens as tk
from cliplane.llm.common import PIECE_BYTES, lists, scan_text

WINDOW = 13
#: Every position divisible by this keeps its suffix position.
SAMPLE = 8
#: Bytes that one broadcast holds.
BLOCK_BYTES = 16 << 20

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", SPAN)]


class Phrases:
    """The windows of a block of benchmark items over symbols of the block's sorted vocabulary."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        data, off = tk.flat(pa.array(texts, pa.string()))
        data = tk.LOWER[data]
        starts, ends, first = tk.spans(data, off, tk.WORD)
        words = tk.hashes(data, starts, ends)
        self.vocab, one = np.unique(words, return_index=True)
        #: All words of the items, one item after the other, as symbols 1, 2, ...
        self.stream = (np.searchsorted(self.vocab, words) + 1).astype(np.int32)
        self.ids, of = np.unique(np.array(ids, dtype=object), return_inverse=True) if ids else (np.zeros(0, object), np.zeros(0, np.int64))
        count = np.diff(first)
        windows = np.where(count > 0, np.maximum(1, count - window + 1), 0)
        self.owner = np.repeat(of, windows).astype(np.int32)
        self.start = (np.repeat(first[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
        self.length = np.repeat(np.minimum(count, window), windows).astype(np.int32)
        #: The bytes of each word of the vocabulary.
        size = ends[one] - starts[one]
        self.byte_at = np.concatenate([[0], np.cumsum(size)])
        self.bytes = data[np.repeat(starts[one] - self.byte_at[:-1], size) + np.arange(size.sum())]
        if self.differs(self.stream, data, starts, ends).any():
            raise ValueError("two words of the benchmark have the same hash")

    def sent(self) -> int:
        parts = (self.vocab, self.stream, self.owner, self.start, self.length, self.byte_at, self.bytes)
        return sum(x.nbytes for x in parts) + sum(len(i) + 60 for i in self.ids)

    def differs(self, symbol: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether words of a text (as bytes) are other words than the symbols that their hashes stand for."""
        at, size = self.byte_at[symbol - 1], self.byte_at[symbol] - self.byte_at[symbol - 1]
        out = size != ends - starts
        todo = np.flatnonzero(~out)
        step = np.arange(size[todo].sum()) - np.repeat(np.cumsum(size[todo]) - size[todo], size[todo])
        other = data[np.repeat(starts[todo], size[todo]) + step] != self.bytes[np.repeat(at[todo], size[todo]) + step]
        out[todo] = np.bincount(np.repeat(np.arange(len(todo)), size[todo]), other, len(todo)) > 0
        return out


class FMIndex:
    """Over a string of symbols >= 0 that ends in 0. Zeros rank among each other by position, so no comparison passes one."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.n = len(s)
        self.bits = max(1, int(sigma).bit_length())
        sa = suffix_array(s, self.bits)
        bwt = s[sa - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma + 1))]).astype(np.int64)
        keep = (sa % SAMPLE == 0) | (bwt == 0)
        self.sampled = keep
        self.sample_rank = np.cumsum(keep) - keep
        self.samples = sa[keep]
        self.levels = []
        seq = bwt
        for k in range(self.bits - 1, -1, -1):
            one = ((seq >> k) & 1).astype(bool)
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((k, zeros, int(zeros[-1])))
            seq = np.concatenate([seq[~one], seq[one]])
        symbol = np.arange(sigma + 1)
        self.base = self._down(symbol, np.zeros(sigma + 1, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, zeros, total in self.levels:
            z = zeros[i].astype(np.int64)
            i = np.where((c >> k) & 1, total + i - z, z)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times that c stands before i in the BWT."""
        return self._down(c, i) - self.base[c]

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for k, zeros, total in self.levels:
            z = zeros[i].astype(np.int64)
            one = zeros[i + 1] == z
            c |= one.astype(np.int64) << k
            i = np.where(one, total + i - z, z)
        return c

    def search(self, stream: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (stream[start : start + length]) that occur, and their rows of the suffix array, by backward search."""
        live = np.arange(len(length))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for step in range(int(length.max(initial=0))):
            more = length[live] > step
            if not more.any():
                break
            which = live[more]
            c = stream[start[which] + length[which] - 1 - step]
            lo[more] = self.start[c] + self.rank(c, lo[more])
            hi[more] = self.start[c] + self.rank(c, hi[more])
            left = lo < hi
            live, lo, hi = live[left], lo[left], hi[left]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            got = self.sampled[at]
            out[todo[got]] = self.samples[self.sample_rank[at[got]]] + steps
            todo, at = todo[~got], at[~got]
            c = self.symbol(at)
            at = self.start[c] + self.rank(c, at)
            steps += 1
        return out


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Sort the first symbols of every suffix packed in a word, then double the prefix of those still tied."""
    n, k = len(s), 63 // bits
    ends = np.flatnonzero(s == 0)
    at = np.flatnonzero(s)
    until = ends[np.searchsorted(ends, at)] - at  # symbols before the next 0
    padded = np.concatenate([s, np.zeros(k, s.dtype)])
    key = np.zeros(len(at), np.int64)
    for j in range(k):
        key = (key << bits) | np.where(j < until, padded[at + j], 0)
    order = np.argsort(key, kind="stable")
    key, pos, full = key[order], at[order], until[order] >= k
    fresh = np.ones(len(pos), bool)
    fresh[1:] = (key[1:] != key[:-1]) | ~full[1:]  # one that met a 0 is settled by its position
    rank = np.empty(n, np.int64)
    rank[ends] = np.arange(len(ends))
    group = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0)) + len(ends)
    rank[pos] = group
    tied = _tied(group)
    h = k
    while len(tied):
        g, p = group[tied], pos[tied]
        second = rank[p + h]
        o = np.lexsort((second, g))
        g, p, second = g[o], p[o], second[o]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (second[1:] != second[:-1])
        g = np.maximum.accumulate(np.where(new, tied + len(ends), 0))
        pos[tied], group[tied] = p, g
        rank[p] = g
        tied = tied[_tied(g)]
        h *= 2
    return np.concatenate([ends, pos])


def _tied(group: np.ndarray) -> np.ndarray:
    """Places whose neighbour is of the same group."""
    same = group[1:] == group[:-1]
    out = np.zeros(len(group), bool)
    out[1:] |= same
    out[:-1] |= same
    return np.flatnonzero(out)


def find(text: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each document; which words are hit; and each (document, item) that has an occurrence."""
    data, off = tk.flat(text)
    data = tk.LOWER[data]
    starts, ends, first = tk.spans(data, off, tk.WORD)
    hit = np.zeros(len(starts), bool)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(phrases.length):
        return first, hit, none, none
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    s = np.zeros(len(starts) + len(off) - 1, np.int64)
    s[np.arange(len(starts)) + doc] = tk.lookup(phrases.vocab, tk.hashes(data, starts, ends)) + 1
    index = FMIndex(s, len(phrases.vocab))
    which, lo, hi = index.search(phrases.stream, phrases.start, phrases.length)
    if not len(which):
        return first, hit, none, none
    count = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    which = np.repeat(which, count)
    at = index.locate(rows)
    of = np.searchsorted(first + np.arange(len(first)), at, side="right") - 1
    at = at - of  # places among the words
    length = phrases.length[which].astype(np.int64)
    held = np.flatnonzero(_covered(at, length, len(starts)))
    wrong = np.zeros(len(starts), bool)
    wrong[held] = phrases.differs(s[held + doc[held]], data, starts[held], ends[held])
    if wrong.any():
        before = np.concatenate([[0], np.cumsum(wrong)])
        right = before[at + length] == before[at]
        at, of, which, length = at[right], of[right], which[right], length[right]
    hit = _covered(at, length, len(starts))
    pair = np.unique(of * len(phrases.ids) + phrases.owner[which])
    return first, hit, pair // len(phrases.ids), pair % len(phrases.ids)


def _covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _columns(text: pa.Array, phrases: Phrases) -> list[pa.Array]:
    first, hit, doc, item = find(text, phrases)
    n = len(text)
    total = np.concatenate([[0], np.cumsum(hit)])
    per = np.bincount(doc, minlength=n) if n else np.zeros(0, np.int64)
    ids = pa.array(list(phrases.ids), pa.string()).take(pa.array(item))
    edge = np.zeros(len(hit) + 1, bool)  # a span starts
    edge[:-1] = hit
    edge[1:-1] &= ~hit[:-1]
    ends = np.zeros(len(hit) + 1, bool)
    ends[:-1] = hit
    ends[:-2] &= ~hit[1:]
    heads = first[:-1][first[:-1] < len(hit)]
    edge[heads] = hit[heads] if len(hit) else False
    tails = first[1:] - 1
    tails = tails[tails >= 0]
    ends[tails] = hit[tails]
    a, b = np.flatnonzero(edge), np.flatnonzero(ends) + 1
    of = np.searchsorted(first, a, side="right") - 1
    value = pa.StructArray.from_arrays([pa.array((a - first[of]).astype(np.int32)), pa.array((b - first[of]).astype(np.int32))], ["start", "end"])
    return [pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), lists(ids, per), lists(value, np.bincount(of, minlength=n) if n else np.zeros(0, np.int64))]


def most_sent(text: str) -> int:
    """Bytes that an item can add: symbol, start, owner and length of each word, and hash, place and letters if it is new."""
    return 32 * len(_WORDS.findall(text)) + len(text.encode()) + 120


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark's items in blocks of bounded size; one block is held at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        size = most_sent(row[1] or "")
        if ids and held + size > block_bytes:
            yield Phrases(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(row[0] or "")
        texts.append(row[1])
        held += size
    yield Phrases(ids, texts, window)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs with n_words, n_hit, item_ids (items with occurring windows, sorted) and spans (merged word ranges to remove)."""
    sc = docs.sparkSession.sparkContext
    out, rounds = docs, 0
    carried = list(dict.fromkeys([*(docs.columns if keep is None else keep), text_col]))
    for block in blocks(benchmark, item_col, item_text_col, window, block_bytes):
        shared = sc.broadcast(block)

        def make(shared=shared):
            phrases = shared.value
            return lambda text: _columns(text, phrases)

        old = [f"__{f.name}" for f in FIELDS] if rounds else []
        if rounds:
            out = out.withColumnsRenamed(dict(zip([f.name for f in FIELDS], old, strict=True)))
        out = scan_text(out, make, FIELDS, text_col, [*(c for c in carried if c not in {f.name for f in FIELDS}), *old], piece_bytes)
        if rounds:
            out = _merged(out)
        rounds += 1
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in FIELDS}]
    return out.select(*[F.col(f"`{c}`") for c in names], *[f.name for f in FIELDS])


def _merged(df: DataFrame) -> DataFrame:
    """Union of two blocks' findings in one row."""
    both = F.array_sort(F.concat("__spans", "spans"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    joined = F.aggregate(
        both,
        none,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    df = df.withColumn("spans", joined).withColumn("item_ids", F.array_sort(F.array_distinct(F.concat("__item_ids", "item_ids"))))
    return df.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])).drop(*[f"__{f.name}" for f in FIELDS])


def contaminated():
    """The contract's rule: some word is hit, and at least one word in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))

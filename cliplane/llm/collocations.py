"""Phrase collocation mining: which word pairs and triples stand together more often than their parts would.

1. Every task counts the words of its texts by language; one aggregation sums them (words are grouped by a 64-bit hash, and
   words that share one are told by their bytes: then everything is hashed again with another seed).
2. Words that are frequent enough get an id. The dictionary goes to the tasks in blocks of at most BLOCK_WORDS words; with
   more than one block the texts become a written stream of ids and hashes that each pass resolves further.
3. Pieces break at all other words, since no phrase that holds one can be frequent. What is left is packed as n-grams of ids
   in keys of 12 bytes, sorted digit by digit (16 bits at a time) and counted by run length before it is sent.
4. Keys are range-partitioned. The cuts come from the word counts: a word that begins more n-grams than a range should hold
   is cut again by the word that follows. Each range is sorted and counted again.
5. Scores, and phrases that a longer one covers, come from joins of the counted n-grams.

Edge cases: null text counts as empty, null lang as `und`. Repeated rows count each time. Very long texts are read in chunks
of CHUNK_BYTES. An empty table gives no rows. Only the text and the language are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm import tokens as tk
from cliplane.llm.common import drop, materialise, pieces, quoted

LEAST = 10
COVERED = 50
SCALE = 1_000_000
TOP = 2000
#: Words of the dictionary that one pass holds (8 bytes each on the driver and in every task).
BLOCK_WORDS = 4_000_000
#: Different words that a task counts before it sends them on.
HELD_WORDS = 200_000
#: N-grams that a task sorts and counts at once.
HELD_KEYS = 1 << 19
#: N-grams that a range of keys should hold at most.
RANGE_KEYS = 1 << 19
CHUNK_BYTES = 1 << 20
#: Shares of a language in which the first rows are found before they meet.
SALTS = 16

#: What ends a piece, and what ends a word besides.
ENDS_PIECE, ENDS_WORD = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK = np.isin(np.arange(256), list(ENDS_PIECE))
_INSIDE = ~(_BREAK | np.isin(np.arange(256), list(ENDS_WORD)))
_PLAIN = bytes(c if inside else 32 for c, inside in zip(tk.LOWER.tolist(), _INSIDE.tolist(), strict=True))
#: In a stream of words: where a piece ends. Hashes have 63 bits; an id that was found is negative.
STOP = np.iinfo(np.int64).min
_63 = np.uint64((1 << 63) - 1)


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text cut between words."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        while end < len(text) and _INSIDE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def _plain(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(quoted(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), quoted(text_col).cast("string").alias("text"))


def _hash(words: list[bytes], seed: int) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    data = np.frombuffer(b"".join(words), np.uint8)
    return (tk.hashes(data, np.concatenate([[0], ends[:-1]]), ends, seed) & _63).view(np.int64)


def word_counts(docs: DataFrame, seed: int = 0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, hash, word, last, c): occurrences of every word of a language; word <> last where words share a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, count in found.items():
                words = list(count)
                c = np.fromiter(count.values(), np.int64, len(words))
                text = pa.array(words, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(_hash(words, seed)), text, pa.array(c)],
                    names=["lang", "hash", "word", "c"],
                )
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                count = found.setdefault(lang, Counter())
                for chunk in _chunks(text.as_py() or b""):
                    count.update(chunk.translate(_PLAIN).split())
                if not count:
                    del found[lang]
                if sum(map(len, found.values())) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    each = _plain(docs, text_col, lang_col).mapInArrow(run, "lang string, hash long, word string, c long")
    return each.groupBy("lang", "hash").agg(F.min("word").alias("word"), F.max("word").alias("last"), F.sum("c").alias("c"))


def _words(data: np.ndarray, off: np.ndarray, seed: int, on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(hashes, whether each word begins a piece, first word of each text, whether the next word would begin one).

    on: the first text goes on from an earlier chunk, in the middle of a piece."""
    data = tk.LOWER[data]
    starts, ends, first = tk.spans(data, off, _INSIDE)
    breaks = np.flatnonzero(_BREAK[data])
    passed = np.searchsorted(breaks, starts)
    new = np.concatenate([[0], passed])[:-1] != passed
    begins = first[on:-1]
    new[begins[begins < len(new)]] = True
    return (tk.hashes(data, starts, ends, seed) & _63).view(np.int64), new, first, len(breaks) > (passed[-1] if len(passed) else 0)


def _stream(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[str, np.ndarray, int]]:
    """(lang, words, skip): hashes of words in order, STOP between pieces; the first skip were given before already."""
    for part in pieces(batch, 1, CHUNK_BYTES):
        langs = part.column(0).to_pylist()
        data, off = tk.flat(part.column(1))
        if len(data) > CHUNK_BYTES:  # one long text
            carried, on = np.zeros(0, np.int64), False
            for chunk in _chunks(data.tobytes()):
                h, new, _, stop = _words(np.frombuffer(chunk, np.uint8), np.array([0, len(chunk)]), seed, on)
                words = np.concatenate([carried, np.insert(h, np.flatnonzero(new), STOP), np.full(int(stop), STOP)])
                yield langs[0], words, len(carried)
                carried, on = words[-2:], True
            continue
        h, new, first, _ = _words(data, off, seed, False)
        names, code = np.unique(np.array(langs, object), return_inverse=True)
        code = np.repeat(code, np.diff(first))
        for k, lang in enumerate(names.tolist()):
            own = np.flatnonzero(code == k)
            yield lang, np.insert(h[own], np.flatnonzero(new[own]), STOP), 0


class Block:
    """Sorted hashes of a language's frequent words; word k of block b of n has id 1 + (first + k) * n + b."""

    def __init__(self, langs: list[str], hashes: np.ndarray, bounds: np.ndarray, b: int, n: int) -> None:
        self.at = {lang: (int(bounds[k]), int(bounds[k + 1])) for k, lang in enumerate(langs)}
        self.hashes, self.b, self.n = hashes, b, n

    def ids(self, lang: str, h: np.ndarray) -> np.ndarray:
        """The id of each hash, or 0."""
        a, z = self.at.get(lang, (0, 0))
        k = tk.lookup(self.hashes[a:z], h.astype(np.uint64) << np.uint64(1))
        return np.where((k >= 0) & (h >= 0), 1 + (a + k) * self.n + self.b, 0)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of big-endian keys (n x 12 bytes), by digits of 16 bits from the last; equal digits are passed over."""
    digits = keys.view(">u2")
    order = None
    for d in range(digits.shape[1] - 1, -1, -1):
        col = digits[:, d].astype(np.uint16)
        if len(col) and col.min() != col.max():
            order = np.argsort(col, kind="stable") if order is None else order[np.argsort(col[order], kind="stable")]
    return np.arange(len(keys)) if order is None else order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often (or with what sum of counts) each stands."""
    order = radix_order(keys)
    keys = keys[order]
    ids = keys.view(">u4")
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return keys[first], total.astype(np.int64)


def ngram_keys(ids: np.ndarray, skip: int = 0) -> np.ndarray:
    """Pairs and triples of neighbours above 0 as keys of three big-endian 32-bit ids (0: no third word).

    N-grams that lie within the first skip ids are left out."""
    ids = np.concatenate([ids, [0, 0]])
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    two, three = np.flatnonzero((a > 0) & (b > 0)), np.flatnonzero((a > 0) & (b > 0) & (c > 0))
    two, three = two[two + 1 >= skip], three[three + 2 >= skip]
    out = np.zeros((len(two) + len(three), 3), ">u4")
    out[: len(two), 0], out[: len(two), 1] = a[two], b[two]
    out[len(two) :, 0], out[len(two) :, 1], out[len(two) :, 2] = a[three], b[three], c[three]
    return out.view(np.uint8).reshape(-1, 12)


def _first_eight(keys: np.ndarray) -> np.ndarray:
    pair = np.ascontiguousarray(keys[:, :8]).view(">u8").ravel()
    return pair.astype(np.uint64)


def cut_ranges(langs: np.ndarray, counts: np.ndarray, b: int, n: int, ranges: int) -> np.ndarray:
    """First two ids (64 bits) at which ranges begin, out of one block's counts in the order of ids."""
    total = np.cumsum(counts)
    if not len(total) or ranges < 2:
        return np.zeros(0, np.uint64)
    want = np.arange(1, ranges) * (total[-1] / ranges)
    k = np.minimum(np.searchsorted(total, want, side="right"), len(total) - 1)
    inside = (want - (total[k] - counts[k])) / counts[k]
    edge = np.concatenate([[0], np.flatnonzero(langs[1:] != langs[:-1]) + 1, [len(langs)]])
    of = np.searchsorted(edge, k, side="right") - 1
    before = np.concatenate([[0], total])[edge]
    second = np.minimum(np.searchsorted(total, before[of] + inside * (before[of + 1] - before[of])), len(total) - 1)
    hot = counts[k] * ranges > total[-1]  # else the range begins with the word itself
    left = 1 + k * n + b
    return np.unique(left.astype(np.uint64) << np.uint64(32) | np.where(hot, 1 + second * n + b, 0).astype(np.uint64))


def _pack(streams: Iterator[tuple[np.ndarray, int]], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (range, keys, counts) of sorted and counted n-grams."""

    def flush() -> pa.RecordBatch:
        keys, count = run_lengths(np.concatenate(held))
        at = np.searchsorted(cuts, _first_eight(keys), side="right")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
        begin = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(at[edge[:-1]].astype(np.int64)),
                pa.array([keys[i:j].tobytes() for i, j in begin], pa.binary()),
                pa.array([count[i:j].tobytes() for i, j in begin], pa.binary()),
            ],
            names=["range", "keys", "counts"],
        )

    held: list[np.ndarray] = []
    size = 0
    for ids, skip in streams:
        held.append(ngram_keys(ids, skip))
        size += len(held[-1])
        if size >= HELD_KEYS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sum the blocks of each range (they stand side by side) and keep the n-grams that occur often enough."""

    def counted(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(k for k, _ in held), np.uint8).reshape(-1, 12)
        keys, f = run_lengths(keys, np.frombuffer(b"".join(c for _, c in held), np.int64))
        many = np.flatnonzero(f >= least)
        ids = keys[many].view(">u4").astype(np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(ids[:, k].copy()) for k in range(3)] + [pa.array(f[many])], names=["x", "y", "z", "f"])

    held: list[tuple[bytes, bytes]] = []
    now = None
    for batch in batches:
        for at, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if at != now and held:
                yield counted(held)
                held = []
            now = at
            held.append((keys, counts))
    if held:
        yield counted(held)


def ngrams(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, counted, totals): (id, lang, word, c) of frequent words, (x, y, z, f) of frequent n-grams (z = 0: two
    words), and (lang, n) of all words. Written tables."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    for seed in range(64):
        counts = materialise(word_counts(docs, seed, text_col, lang_col), "collocation-words")
        if not counts.where("word <> last").head(1):
            break
        drop(counts)
    else:
        raise ValueError("words share hashes whatever the seed")
    totals = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    often = counts.where(F.col("c") >= least)
    size = often.agg(F.count("*").alias("words"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-size["words"] // block_words))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size["c"] // RANGE_KEYS + 1)
    cuts, words = [], []
    stream = None
    plain = _plain(docs, text_col, lang_col)
    for b in range(blocks):
        own = often.where(F.pmod("hash", F.lit(blocks)) == b).select("lang", "hash", "c").toArrow()
        names = np.array(own.column("lang").to_pylist(), object)
        h = own.column("hash").to_numpy().astype(np.uint64) << np.uint64(1)
        langs, code = np.unique(names, return_inverse=True)
        order = np.lexsort((h, code))
        code, h, c = code[order], h[order], own.column("c").to_numpy()[order]
        share = round(ranges * c.sum() / max(1, size["c"])) if blocks > 1 else ranges
        cuts.append(cut_ranges(code, c, b, blocks, share))
        block = sc.broadcast(Block(langs.tolist(), h, np.searchsorted(code, np.arange(len(langs) + 1)), b, blocks))
        words.append(materialise(_with_ids(often.where(F.pmod("hash", F.lit(blocks)) == b), block), "collocation-ids"))
        if blocks > 1:
            old, source = stream, plain if stream is None else stream
            stream = materialise(_resolved(source, block, seed, old is None), "collocation-stream")
            if old is not None:
                drop(old)
            block.unpersist()
    edges = np.unique(np.concatenate(cuts))

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (x for batch in batches for x in _stream(batch, seed))
        return _pack(((block.value.ids(lang, s), skip) for lang, s, skip in parts), edges)

    def from_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for batch in batches for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        parts = ((np.frombuffer(s, np.int64), skip) for s, skip in rows)
        return _pack(((np.where((s < 0) & (s != STOP), -s, 0), skip) for s, skip in parts), edges)

    rows = "range long, keys binary, counts binary"
    sent = plain.mapInArrow(from_texts, rows) if stream is None else stream.mapInArrow(from_stream, rows)
    dealt = sent.repartitionById(len(edges) + 1, F.col("range").cast("int")).sortWithinPartitions("range")
    counted = dealt.mapInArrow(lambda batches: _count(batches, least), "x long, y long, z long, f long")
    counted = materialise(counted, "collocation-ngrams")
    block.unpersist()
    if stream is not None:
        drop(stream)
    found = words[0]
    for more in words[1:]:
        found = found.unionByName(more)
    return found, counted, totals


def _with_ids(often: DataFrame, block) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, lang = batch.column(1).to_numpy(), batch.column(0)
            ids = np.zeros(len(h), np.int64)
            for name in pc.unique(lang).to_pylist():
                own = np.flatnonzero(pc.equal(lang, name).to_numpy(zero_copy_only=False))
                ids[own] = block.value.ids(name, h[own])
            yield pa.RecordBatch.from_arrays([pa.array(ids), lang, batch.column(2), batch.column(3)], names=["id", "lang", "word", "c"])

    return often.select("lang", "hash", "word", "c").mapInArrow(run, "id long, lang string, word string, c long")


def _resolved(source: DataFrame, block, seed: int, texts: bool) -> DataFrame:
    """(lang, stream, skip) in which the words of one more block are ids (negative)."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, int]]:
        for lang, s, skip in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield lang, np.frombuffer(s, np.int64), skip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, s, skip in _stream(batch, seed) if texts else read(batch):
                ids = np.where(s >= 0, block.value.ids(lang, np.maximum(s, 0)), 0)
                done = np.where(ids > 0, -ids, s).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([done], pa.binary()), pa.array([skip], pa.int64())], names=["lang", "stream", "skip"])

    return source.mapInArrow(run, "lang string, stream binary, skip long")


def _score(left: str, right: str) -> str:
    """floor(SCALE * a * a / (left * right)) as SQL, in decimals of 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    return f"CAST({SCALE} AS DECIMAL(7, 0)) * {wide('a')} * {wide('a')} div ({wide(left)} * {wide(right)})"


def mine(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language."""
    words, counted, totals = ngrams(docs, least, text_col, lang_col, block_words)
    pairs, triples = counted.where("z = 0").select("x", "y", "f"), counted.where("z > 0")
    # the most frequent triple around each pair
    around = triples.select("x", "y", "f").unionByName(triples.select(F.col("y").alias("x"), F.col("z").alias("y"), "f"))
    around = around.groupBy("x", "y").agg(F.max("f").alias("longer"))
    left = pairs.join(around, ["x", "y"], "left").where(f"longer IS NULL OR longer * 100 < f * {covered}")
    none = F.lit(None).cast("long")
    two = left.select("x", "y", F.lit(0).cast("long").alias("z"), F.col("f").alias("a"), none.alias("head"), none.alias("tail"))
    head, tail = pairs.withColumnRenamed("f", "head"), pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("f").alias("tail"))
    three = triples.withColumnRenamed("f", "a").join(head, ["x", "y"]).join(tail, ["y", "z"]).select(*two.columns)
    both = two.unionByName(three)
    for side, how in (("x", "inner"), ("y", "inner"), ("z", "left")):
        lang = ["lang"] if side == "x" else []
        one = words.select(F.col("id").alias(side), F.col("c").alias(f"{side}_c"), F.col("word").alias(f"{side}_w"), *lang)
        both = both.join(one, side, how)
    # the cuts after the first and after the second word; of equal scores the first counts
    rest = "coalesce(tail, y_c)"
    both = both.selectExpr(
        "lang", "concat_ws(' ', x_w, y_w, z_w) AS phrase", "a", f"pmod(xxhash64(x, y, z), {SALTS}) AS salt", f"{_score('x_c', rest)} AS one",
        f"CASE WHEN z > 0 THEN {_score('head', 'z_c')} END AS other", "x_c", f"{rest} AS rest", "head", "z_c",
    )
    second = F.col("other") < F.col("one")
    pick = lambda a, b, to: F.when(second, F.col(b)).otherwise(F.col(a)).alias(to)
    scored = both.select("lang", "salt", "phrase", "a", pick("x_c", "head", "l"), pick("rest", "z_c", "r"), pick("one", "other", "score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    near = scored.withColumn("rank", place("lang", "salt")).where(F.col("rank") <= top).drop("rank", "salt")
    best = near.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rule, word by word.
SQL = r"""
WITH p AS (
  SELECT lang, piece_no, doc, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece, 0 AS piece_no
    FROM documents)
), g AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k))
  GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, j, array_to_string(list_slice(w, 1, j), ' ') AS first_part, array_to_string(list_slice(w, j + 1, c.k), ' ') AS rest
  FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < c.k
), s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = first_part JOIN g y ON y.lang = cuts.lang AND y.phrase = rest
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM s),
around AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS phrase, f FROM c WHERE k = 3)
  GROUP BY ALL
), kept AS (
  SELECT b.* FROM b LEFT JOIN around USING (lang, phrase) WHERE place = 1 AND (b.k = 3 OR longer IS NULL OR 100 * longer < 50 * a)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
) JOIN n USING (lang) WHERE rank <= 2000
"""

"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features of each whole text: lexicon densities (plain, obfuscated), second-person proximity, capitals, punctuation and
obfuscation rates. The classifier is fitted on at most SAMPLE_ROWS labelled rows (those with the smallest hash of their
id, whole texts of any length), of which a quarter is kept from the trees for the isotonic calibration; everything else
covers all rows. The sample's texts stay on the executors: they count the words for the learned lexicon and compute the
features, and the driver gets one row of numbers for each document of the sample and the words that were learned.

Edge cases: null text counts as empty; empty texts get the score of their (all zero) features. Of rows with one id the
smallest text is fitted on. Without labelled rows the model is constant 0. Repeated rows are scored each by itself. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplane.llm import tokens as tk
from cliplane.llm.common import drop, lists, materialise, quoted, scan_text

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
#: A word joins the lexicon if so many different toxic texts of the sample have it, if so many times the share of toxic
#: texts' words as of clean ones' are it, and if chance explains that no better than one part in e to this power.
LEARN_ROWS, LEARN_TIMES, LEARN_GAIN = 5, 12, 5.0
#: Words of a second-person pronoun or a lexicon word so close count as aimed at somebody.
NEAR = 5

#: Insults, by strength.
STRONG = "scum moron idiot imbecile bastard asshole bitch retard cunt slut whore faggot fuck fucking fucker motherfucker shit bullshit dickhead wanker vermin subhuman".split()
MILD = "trash pathetic disgusting worthless clown loser stupid dumb fool garbage filth filthy freak creep coward liar useless hateful ridiculous jerk crap damn sucks".split()
FOREIGN = "idiota imbécil estúpido estúpida basura mierda puta cabrón gilipollas asqueroso imbécile connard connasse salope merde stupide dégueulasse ordure abruti dummkopf arschloch scheiße scheisse hurensohn abschaum trottel depp ekelhaft wertlos wichser".split()
SECOND = "you your yours yourself u ur thou tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer ti tú usted ustedes vosotros".split()

NAMES = ["strong", "mild", "foreign", "learned", "any", "obfuscated", "aimed", "second", "capitals", "capital_words", "punctuation", "exclaims", "mixed", "length"]

_B = np.arange(256)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_LETTER = _UPPER | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
_PUNCT = ((_B >= 0x21) & (_B <= 0x2F)) | ((_B >= 0x3A) & (_B <= 0x40)) | ((_B >= 0x5B) & (_B <= 0x60)) | ((_B >= 0x7B) & (_B <= 0x7E))
_SPACE = (_B == 0x20) | ((_B >= 9) & (_B <= 13))
#: What stands for which letter.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_FOLD = tk.LOWER.copy()
for _k, _v in _LEET.items():
    _FOLD[ord(_k)] = ord(_v)
_MASKED = _LETTER.copy()
for _k in [*_LEET, "*", "#"]:
    _MASKED[ord(_k)] = True
_FOLD[ord("#")] = ord("*")


def _keys(words) -> np.ndarray:
    return np.unique(np.array([tk.word_hash(w) for w in words], np.uint64))


class Lexicon:
    """The fixed lists and the words learned from the sample (as hashes)."""

    def __init__(self, learned: np.ndarray | None = None) -> None:
        self.kinds = [_keys(STRONG), _keys(MILD), _keys(FOREIGN), np.zeros(0, np.uint64) if learned is None else learned]
        self.second = _keys(SECOND)
        plain = {w for w in [*STRONG, *MILD, *FOREIGN] if len(w) >= 4}
        starred = {w[:i] + "*" + w[i + 1 :] for w in plain for i in range(len(w))} | {w[0] + "*" * (len(w) - 2) + w[-1] for w in plain}
        self.masked = _keys(plain | starred)

    def features(self, text: pa.Array) -> np.ndarray:
        """A row of NAMES for each text."""
        raw, off = tk.flat(text)
        n, size = len(off) - 1, np.maximum(np.diff(off), 1)

        def per(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[off[1:]] - total[off[:-1]]

        starts, ends, first = tk.spans(raw, off, _LETTER)
        words = tk.hashes(tk.LOWER[raw], starts, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        kinds = [np.flatnonzero(tk.lookup(k, words) >= 0) for k in self.kinds]
        you = np.flatnonzero(tk.lookup(self.second, words) >= 0)
        bad = np.sort(np.concatenate(kinds))
        aimed = np.zeros(len(bad), bool)
        if len(you) and len(bad):
            for step in (0, 1):
                near = you[np.clip(np.searchsorted(you, bad) - step, 0, len(you) - 1)]
                aimed |= (np.abs(near - bad) <= NEAR) & (doc[near] == doc[bad])
        s2, e2, _ = tk.spans(raw, off, _MASKED)
        odd = np.concatenate([[0], np.cumsum(~_LETTER[raw])])
        letters = (e2 - s2) - (odd[e2] - odd[s2])
        mixed = np.flatnonzero((odd[e2] > odd[s2]) & (letters >= 2))
        at2 = np.searchsorted(off, s2[mixed], side="right") - 1
        hidden = tk.lookup(self.masked, tk.hashes(_FOLD[raw], s2[mixed], e2[mixed])) >= 0
        count = np.maximum(np.diff(first), 1)
        per_doc = lambda at: np.bincount(at, minlength=n)[:n]
        total = sum(per_doc(doc[k]) for k in kinds) + per_doc(at2[hidden])
        upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
        shout = (upper[ends] - upper[starts] == ends - starts) & (ends - starts >= 2)
        cols = [
            *(per_doc(doc[k]) / count * 100 for k in kinds), np.log1p(total), per_doc(at2[hidden]) / count * 100, per_doc(doc[bad[aimed]]) / count * 100,
            per_doc(doc[you]) / count * 100, per(_UPPER[raw]) / size, per_doc(doc[shout]) / count, per(_PUNCT[raw]) / size, per(raw == 0x21) / size, per_doc(at2) / count, np.log1p(np.diff(off)),
        ]
        return np.stack([np.asarray(c, np.float64) for c in cols], axis=1) if n else np.zeros((0, len(NAMES)))


def _words(text: pa.Array) -> list[pa.Array]:
    """The different words of each text, as hashes."""
    raw, off = tk.flat(text)
    starts, ends, first = tk.spans(raw, off, _LETTER)
    words = tk.hashes(tk.LOWER[raw], starts, ends)
    each = [np.unique(words[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    flat = np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64)
    return [lists(pa.array(flat), np.array([len(w) for w in each], np.int64))]


def learn(sample: DataFrame) -> np.ndarray:
    """Words of toxic texts that clean ones hardly have (sample: text, toxic); equal texts count once, and a word once a text.

    A text of many words gives chance many words to meet, so shares are of all (text, word) pairs of a class, not of its
    texts. The gain is the log likelihood ratio of the word's own share of toxic texts against the share of all pairs."""
    rows = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    words = scan_text(rows, lambda: _words, [T.StructField("words", T.ArrayType(T.LongType()))], keep=["toxic"])
    words = materialise(words.select((F.col("toxic") > 0).cast("long").alias("is_bad"), F.explode("words").alias("word")), "toxicity-words")
    total = words.agg(F.sum("is_bad").alias("bad"), F.count("*").alias("every")).first()
    bad, good = total["bad"] or 0, total["every"] - (total["bad"] or 0)
    if not bad or not good:
        drop(words)
        return np.zeros(0, np.uint64)
    per = words.groupBy("word").agg(F.sum("is_bad").alias("bad"), F.count("*").alias("every"))
    b, g = F.col("bad"), F.col("every") - F.col("bad")
    times = (b / bad) / ((g + 0.5) / good)
    gain = b * F.log(b / F.col("every") * ((bad + good) / bad)) + F.when(g > 0, g * F.log(g / F.col("every") * ((bad + good) / good))).otherwise(0.0)
    found = per.where((b >= LEARN_ROWS) & (times >= LEARN_TIMES) & (gain >= LEARN_GAIN)).select("word")
    got = np.sort(np.array([r["word"] for r in found.collect()], np.int64).view(np.uint64))  # of the bounded sample's words
    drop(words)
    return got


class Forest:
    """Logistic gradient boosting of small trees on binned features, then isotonic calibration."""

    def __init__(self, trees: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 4.0, learned: np.ndarray | None = None):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.bias, self.nodes = -20.0, []
        self.learned = learned
        self.least = 1.0  # hessian in a leaf
        self.knots, self.levels = np.array([0.0]), np.array([0.0])

    def fit(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Forest:
        """apart: rows kept from the trees, for calibration."""
        if not len(y):
            return self
        if apart.all() or not apart.any():
            apart = np.zeros(len(y), bool)
            self._boost(x, y)
            apart[:] = True
        else:
            self._boost(x[~apart], y[~apart])
        self.knots, self.levels = isotonic(self.margin(x[apart]), y[apart])
        return self

    def _boost(self, x: np.ndarray, y: np.ndarray) -> None:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        for k, c in enumerate(x.T):  # a feature that is mostly one value is cut right above it and at the quantiles of the rest
            rest = c[c > c.min()]
            if len(rest):
                cuts[k] = np.unique(np.concatenate([cuts[k], [c.min()], np.quantile(rest, np.linspace(0, 1, 17)[1:-1])]))
        code = np.stack([np.searchsorted(cuts[k], c, side="left") for k, c in enumerate(x.T)], axis=1)
        margin = np.full(len(y), self.bias)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-margin))
            g, h = y - q, q * (1 - q)
            tree: list = []
            margin += self._grow(tree, code, cuts, g, h, np.arange(len(y)), self.depth, np.zeros(len(y)))
            self.nodes.append(tree)

    def _grow(self, tree, code, cuts, g, h, rows, depth, out) -> np.ndarray:
        """Nodes are (feature, cut, left, right) or (value,)."""
        me = len(tree)
        tree.append(None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if depth:
            for k in range(code.shape[1]):
                width = len(cuts[k]) + 1
                left_g = np.cumsum(np.bincount(code[rows, k], g[rows], width))[:-1]
                left_h = np.cumsum(np.bincount(code[rows, k], h[rows], width))[:-1]
                if len(left_g):
                    gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain[(left_h < self.least) | (total_h - left_h < self.least)] = 0
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], k, j)
        if best[1] < 0:
            value = float(self.rate * total_g / (total_h + self.ridge))
            tree[me] = (value,)
            out[rows] = value
            return out
        _, k, j = best
        low = code[rows, k] <= j
        left = len(tree)
        self._grow(tree, code, cuts, g, h, rows[low], depth - 1, out)
        right = len(tree)
        self._grow(tree, code, cuts, g, h, rows[~low], depth - 1, out)
        tree[me] = (k, float(cuts[k][j]), left, right)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.nodes:
            stack = [(0, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                if len(tree[at]) == 1:
                    out[rows] += tree[at][0]
                elif len(rows):
                    k, cut, left, right = tree[at]
                    low = x[rows, k] <= cut
                    stack += [(left, rows[low]), (right, rows[~low])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a small share of the raw one keeps the order of rows within a level."""
        m = self.margin(x)
        level = np.interp(m, self.knots, self.levels)
        return np.clip(0.99 * level + 0.01 / (1 + np.exp(-m)), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing levels."""
    xs, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    ys = np.bincount(inverse, y) / n
    pools: list[list[float]] = []
    for a, v, w in zip(xs, ys, n, strict=True):
        pools.append([v, w, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, _, b2 = pools.pop()
            v1, w1, a1, _ = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, a1, b2])
    return np.array([p for v in pools for p in (v[2], v[3])]), np.array([v[0] for v in pools for _ in range(2)])


def fold(doc_id: str = "doc_id"):
    return F.crc32(quoted(doc_id).cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on labelled rows outside the held-out fold; of each id the largest label counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 2))
    sample = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id")  # at most sample_rows ids and labels
    rows = materialise(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(4)) == 1  # kept from the trees and the learned words
    learned = learn(rows.where(~apart))

    def make():
        lexicon = Lexicon(learned)
        return lambda text: [lists(pa.array((x := lexicon.features(text)).ravel()), np.full(len(x), len(NAMES)))]

    found = scan_text(rows.withColumn("apart", apart), make, [T.StructField("x", T.ArrayType(T.DoubleType()))], keep=["doc_id", "toxic", "apart"])
    got = found.toPandas().sort_values("doc_id")  # at most sample_rows rows of numbers
    drop(rows)
    if not len(got):
        return Forest()
    return Forest(learned=learned).fit(np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(np.float64), got["apart"].to_numpy(bool))


def score(docs: DataFrame, model: Forest, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        forest = shared.value
        lexicon = Lexicon(forest.learned)

        def columns(text):
            s = forest.score(lexicon.features(text))
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

        return columns

    return scan_text(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text_col, keep)

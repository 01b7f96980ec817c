"""Source divergence audit: how far the vocabulary of each source of a language is from the others', and by which terms.

1. Every task counts terms by language and source over its documents (at most HELD_TERMS at once): documents that have the
   term, and occurrences. So a frequent term is a few rows a task however many documents hold it.
2. The counts are dealt by (lang, term) and sorted by (term, lang, source, batch of documents). A scan of the runs sums up
   document frequency and counts, and keeps the terms that enough documents have: one row a term with its sources.
3. A second scan of these runs turns counts into shares, emits a term's candidates for each source (the first TERMS of a task)
   and adds up its part of every pair of sources; the pairs of a task are emitted as partial sums.

Shares are whole billionths and f is an integer quotient, so nothing is rounded. Of a pair only terms that either source has
are computed one by one; the others all have the same value.

The groups (one row a language and source) are broadcast: the result has a row for each pair of them, so they are at most
as many as the square root of the result's rows.

Edge cases: null text, lang and source count as ''. Repeated rows are documents of their own. Groups without terms take part.
Long texts are read in chunks of CHUNK_BYTES. An empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm.common import materialise, quoted

LEAST_DOCS = 3
BILLION = 1_000_000_000
TERMS = 200
#: Different (language, source, term) that a task counts before it sends them on.
HELD_TERMS = 300_000
CHUNK_BYTES = 1 << 20
#: Cells (terms by sources) that the second scan computes at once.
CELLS = 1 << 18
#: Sums of pairs that a task holds at most before it emits them.
HELD_PAIRS = 1 << 22

#: Letters, and every byte of a character beyond ASCII.
_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, chunk by chunk."""
    plain = text.translate(_TERM)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK_BYTES) if at + CHUNK_BYTES < len(plain) else len(plain)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, source, batch, docs, n): partial counts; a term '' with docs = 0 stands for a group's existence."""
    text, *names = (F.coalesce(quoted(c).cast("string"), F.lit("")).alias(k) for c, k in ((text_col, "text"), (lang_col, "lang"), (source_col, "source")))
    source = docs.select(*names, text, F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        told: set[tuple[str, str]] = set()
        first = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, src), (n, docs) in held.items():
                terms = list(n)
                columns = [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([src] * len(terms), pa.string()),
                    pa.array(np.full(len(terms), first)),
                    pa.array([docs[t] for t in terms], pa.int64()),
                    pa.array(list(n.values()), pa.int64()),
                ]
                if (lang, src) not in told:
                    told.add((lang, src))
                    columns = [pa.concat_arrays([c, pa.array([x], c.type)]) for c, x in zip(columns, (lang, "", src, first, 0, 0), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "batch", "docs", "n"])
            held.clear()

        size = 0
        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3).to_pylist()]
            for lang, src, text, row in zip(*columns, strict=True):
                if not held:
                    first = row
                n, docs = held.setdefault((lang, src), (Counter(), Counter()))
                before = len(n)
                own: set[bytes] = set()
                for terms in _parts(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    return source.mapInArrow(run, "lang string, term string, source string, batch long, docs long, n long")


def _starts(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Rows at which a run of equal values in the first so many columns begins."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in range(columns):
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _by_source(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each run of (lang, term, source), with docs and n summed."""
    first = _starts(batch, 3)
    if not len(first):
        return batch
    sums = [pa.array(np.add.reduceat(batch.column(k).to_numpy(), first)) for k in (3, 4)]
    return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(first)) for k in range(3)] + sums, names=batch.schema.names)


def _terms(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """One row for each run of (lang, term) that enough documents have, and for the groups ('')."""
    first = _starts(rows, 2)
    size = np.diff(np.append(first, rows.num_rows))
    at = pa.array(first)
    lang, term = rows.column(0).take(at), rows.column(1).take(at)
    docs = np.add.reduceat(rows.column(3).to_numpy(), first)
    keep = (docs >= least) | pc.equal(term, "").to_numpy(zero_copy_only=False)
    own = pa.array(np.repeat(keep, size))
    offsets = pa.array(np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32))
    each = [pa.ListArray.from_arrays(offsets, rows.column(k).filter(own)) for k in (2, 4)]
    kept = pa.array(keep)
    return pa.RecordBatch.from_arrays([lang.filter(kept), term.filter(kept), *each], names=["lang", "term", "sources", "counts"])


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, term, source), run by run; the last term of a batch waits for the next, a row a source."""
    held = None
    for batch in batches:
        rows = _by_source(batch)
        if held is not None:
            rows = _by_source(pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, rows.columns, strict=True)], names=rows.schema.names))
        if rows.num_rows:
            cut = int(_starts(rows, 2)[-1])
            if cut:
                yield _terms(rows.slice(0, cut), least)
            held = rows.slice(cut)
    if held is not None:
        yield _terms(held, least)


def share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(1e9 * (count + 1) / (total + terms)); totals whose product passes 64 bits take Python's integers."""
    below = total + terms
    top = count + 1
    if total < (1 << 62) // BILLION:
        return 1 + BILLION * top // below
    return 1 + np.array([BILLION * int(c) // below for c in top.tolist()], np.int64)


class Groups:
    """Per language: its sources in order, their totals, the total of all, and the number of kept terms."""

    def __init__(self, found: dict[str, dict[str, int]], terms: dict[str, int]) -> None:
        self.names = {lang: sorted(g, key=lambda s: s.encode()) for lang, g in found.items()}
        self.totals = {lang: [found[lang][s] for s in names] for lang, names in self.names.items()}
        self.terms = {lang: terms.get(lang, 0) for lang in found}
        self.at = {lang: {s: k for k, s in enumerate(names)} for lang, names in self.names.items()}

    def zeros(self, lang: str) -> np.ndarray:
        """The share of a term that a source doesn't have, by source."""
        one = np.zeros(1, np.int64)
        return np.concatenate([share(one, n, self.terms[lang]) for n in self.totals[lang]])


def _quotient(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _scan(batches: Iterator[pa.RecordBatch], groups: Groups, most: int) -> Iterator[pa.RecordBatch]:
    """Partial pairs and terms of the runs (lang, term, sources, counts) of a task."""
    sums: dict[str, np.ndarray] = {}  # lang -> S x S, what a pair differs by from terms that neither has
    best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def rows(part: str, lang: str, found: list[tuple[int, str, int]]) -> pa.RecordBatch:
        names = groups.names[lang]
        src, item, value = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found)), pa.array([names[k] for k in src]), pa.array([part] * len(found)), pa.array(item, pa.string()), pa.array(value, pa.int64())],
            names=["lang", "source", "part", "item", "value"],
        )

    def pairs() -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            names = groups.names[lang]
            for a in range(len(names)):
                some = np.flatnonzero(total[a])
                if len(some):
                    yield rows("pair", lang, [(a, names[b], int(total[a, b])) for b in some.tolist()])
        sums.clear()

    def terms(key: tuple[str, int]) -> list[tuple[int, bytes]]:
        return sorted(best[key], key=lambda x: (-x[0], x[1]))[:most]

    def scan(lang: str, term: list[str], row: np.ndarray, src: np.ndarray, n: np.ndarray) -> None:
        """row, src, n: the terms' counts above 0 as coordinates."""
        totals, kept, zero = groups.totals[lang], groups.terms[lang], groups.zeros(lang)
        size = len(zero)
        p = np.tile(zero, (len(term), 1))
        has = np.zeros(p.shape, bool)
        has[row, src] = True
        for s in np.unique(src).tolist():
            own = src == s
            p[row[own], s] = share(n[own], totals[s], kept)
        count = np.zeros(len(term), np.int64)
        np.add.at(count, row, n)
        q = share(count, sum(totals), kept)
        base = _quotient(zero[:, None], zero[None, :])
        total = sums.setdefault(lang, np.zeros((size, size), np.int64))
        names = [t.encode() for t in term]
        for s in np.unique(src).tolist():
            own = np.flatnonzero(has[:, s])
            mine = p[own]
            total[s] += (_quotient(mine[:, s : s + 1], mine) - base[s]).sum(0)
            # the other sources that haven't these terms
            total[:, s] += ((_quotient(zero, mine[:, s : s + 1]) - base[:, s]) * ~has[own]).sum(0)
            above = own[p[own, s] > q[own]]
            value = _quotient(p[above, s], q[above])
            held = best.setdefault((lang, s), [])
            held += zip(value.tolist(), [names[k] for k in above.tolist()], strict=True)
            if len(held) > 8 * most:
                best[lang, s] = terms((lang, s))

    for batch in batches:
        langs, term, sources, counts = (batch.column(k).to_pylist() for k in range(4))
        by_lang: dict[str, list[int]] = {}
        for k, lang in enumerate(langs):
            if term[k]:
                by_lang.setdefault(lang, []).append(k)
        for lang, own in by_lang.items():
            step = max(1, CELLS // len(groups.names[lang]))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                at = groups.at[lang]
                row = np.repeat(np.arange(len(part)), [len(sources[k]) for k in part])
                src = np.array([at[s] for k in part for s in sources[k]], np.int64)
                scan(lang, [term[k] for k in part], row, src, np.array([c for k in part for c in counts[k]], np.int64))
            if sum(x.size for x in sums.values()) > HELD_PAIRS:
                yield from pairs()
    yield from pairs()
    for lang, s in best:
        if best[lang, s]:
            yield rows("term", lang, [(s, item.decode(), value) for value, item in terms((lang, s))])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    spark = docs.sparkSession
    counts = term_counts(docs, text_col, lang_col, source_col)
    # terms first: their bytes tell rows apart sooner than those of the few languages
    runs = counts.repartition("lang", "term").sortWithinPartitions("term", "lang", "source", "batch").select("lang", "term", "source", "docs", "n")
    runs = materialise(runs.mapInArrow(lambda b: _runs(b, least), "lang string, term string, sources array<string>, counts array<long>"), "divergence-runs")
    each = runs.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    kept = runs.where("term <> ''").groupBy("lang").agg(F.count("*").alias("v"))
    found: dict[str, dict[str, int]] = {}
    for r in each.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n")).toLocalIterator():
        found.setdefault(r["lang"], {})[r["source"]] = r["n"]
    groups = Groups(found, {r["lang"]: r["v"] for r in kept.collect()})
    sent = spark.sparkContext.broadcast(groups)
    parts = runs.mapInArrow(lambda b: _scan(b, sent.value, terms), "lang string, source string, part string, item string, value long")
    parts = materialise(parts, "divergence-parts")
    base = _even_pairs(spark, groups, sent)
    sums = parts.where("part = 'pair'").unionByName(base).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    first = parts.where("part = 'term'").select("*", rank).where(F.col("rank") <= terms)
    return sums.select("*", rank).unionByName(first).select("lang", "source", "part", "item", "value", "rank")


def _even_pairs(spark, groups: Groups, sent) -> DataFrame:
    """For each pair the value of all kept terms as if neither source had them, made on the executors."""
    rows = spark.createDataFrame([(lang, k) for lang, names in groups.names.items() for k in range(len(names))], "lang string, k int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = sent.value.names[lang]
                others = [b for b in range(len(names)) if b != a]
                many = sent.value.terms[lang]
                zero = sent.value.zeros(lang) if many else np.ones(len(names), np.int64)
                value = _quotient(zero[a], zero)[others] * many
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * len(others), pa.string()) for x in (lang, names[a], "pair")] + [pa.array([names[b] for b in others], pa.string()), pa.array(value)],
                    names=["lang", "source", "part", "item", "value"],
                )

    return rows.mapInArrow(run, "lang string, source string, part string, item string, value long")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT d, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), everyone AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM everyone)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

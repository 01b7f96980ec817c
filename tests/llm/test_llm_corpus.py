"""Collocations, the extendible-hash index and the divergence audit against brute force on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliplane.llm import collocations, divergence, exact_dedup, queries

COLUMNS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def odd_docs(seed, n=120):
    """Texts of few words with all kinds of breaks, nulls, repeated rows, ids that are null or stand twice."""
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "éa", "É", "x9", "can't", "日本", "|", "a-b"]
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 30, 200])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", "\n", ". ", ", ", "\r\n", "\x0b", "!", "\xa0"]) for _ in range(k))
        rows.append((rng.choice([i, i, None, 7]), rng.choice([text] * 8 + [None, "", " ", "\n\n"]), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None])))
    rows += rows[:20] + [(900 + i, "new york new york is new", "en", "s1") for i in range(12)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return df.select("*", *[F.lit("x").alias(c) for c in ("key", "sha", "n", "rank", "term", "a`b")])


# ---------------------------------------------------------------- collocations


def brute_phrases(rows, least=10, covered=50, top=2000):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            longer = [b for q, b in f.items() if len(q) > len(p) and b >= least and p in (q[:2], q[1:])] if len(p) == 2 else []
            if not any(100 * b >= covered * a for b in longer):
                score, _, left, right = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("seed, blocks", [(1, 4_000_000), (2, 3)])
def test_collocations(spark, seed, blocks):
    """Also with more words than a block of the dictionary holds."""
    rows = odd_docs(seed)
    got = collocations.mine(frame(spark, rows), block_words=blocks)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows)
    short = collocations.mine(frame(spark, rows), top=5, block_words=blocks)
    assert sorted(map(tuple, short.collect())) == brute_phrases(rows, top=5)


def test_long_texts_are_read_in_chunks(monkeypatch):
    rows = odd_docs(6)
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])

    def keys():
        found = collections.Counter()
        for lang, words, skip in collocations._stream(batch, 0):
            ids = np.where(words == collocations.STOP, 0, words % (1 << 31) + 1)
            found.update((lang, bytes(k)) for k in collocations.ngram_keys(ids, skip))
        return found

    whole = keys()
    for size in (1, 16, 64, 1000):
        monkeypatch.setattr(collocations, "CHUNK_BYTES", size)
        assert keys() == whole and whole


def test_words_that_share_a_hash_are_hashed_again(spark, monkeypatch):
    real, seeds = collocations._hash, []

    def clash(words, seed):
        seeds.append(seed)
        h = real(words, seed)
        return h if seed else h & 3

    monkeypatch.setattr(collocations, "_hash", clash)
    rows = odd_docs(5, 40)
    found = collocations.word_counts(frame(spark, rows), 0)
    assert found.where("word <> last").count() > 0 and collocations.word_counts(frame(spark, rows), 1).where("word <> last").count() == 0
    assert sorted(map(tuple, collocations.mine(frame(spark, rows)).collect())) == brute_phrases(rows)


def test_keys_are_sorted_digit_by_digit():
    rng = np.random.default_rng(1)
    ids = rng.choice([0, 1, 5, 70_000, 2**31, 2**32 - 1], (500, 3)).astype(">u4")
    keys = ids.view(np.uint8).reshape(-1, 12)
    found, n = collocations.run_lengths(keys)
    want = collections.Counter(map(bytes, keys))
    assert [bytes(k) for k in found] == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
    counts = np.full(100, 5)
    counts[1] = 500
    cuts = collocations.cut_ranges(np.zeros(100, int), counts, 0, 1, 20).tolist()
    assert cuts == sorted(cuts) and sum(c >> 32 == 2 for c in cuts) >= 5  # the hot word is cut by what follows it


# ---------------------------------------------------------------- exact dedup


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[re.sub("[ \t-\r]+", " ", row[1] or "")].append(row[0])
    out = []
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        left = [True]  # of rows that share the smallest id one stays
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            out.append((i, first, len(ids), i == first and bool(left) and left.pop(), sha))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_dedup(spark, seed):
    rows = odd_docs(seed)
    assert told(exact_dedup.dedup(frame(spark, rows))) == brute_groups(rows)


def test_chains_of_colliding_keys_and_split_buckets(spark):
    rows = odd_docs(3) + [(1000 + i, f"text {i} " + "x" * i, "en", "s") for i in range(150)]
    few = lambda text: hashlib.md5(text).digest()[0] % 5 << 59  # noqa: E731  five keys for all texts
    staged = exact_dedup.stage(frame(spark, rows), hash_of=few, held_bytes=300)
    index = exact_dedup.build(staged, capacity=1 << 20, owners=3)
    assert told(exact_dedup.assign(staged, index)) == brute_groups(rows)
    assert index.entries.groupBy("key").count().agg(F.max("count")).first()[0] > 10  # chains of different texts
    staged = exact_dedup.stage(frame(spark, rows))
    index = exact_dedup.build(staged, capacity=200, owners=1)
    buckets = index.directory.collect()
    depths = {b["depth"] for b in buckets}
    assert len(depths) > 1 and sum(2.0 ** -b["depth"] for b in buckets) <= 1  # some buckets were split, and none overlap
    assert told(exact_dedup.assign(staged, index)) == brute_groups(rows)
    load = {(b["prefix"], b["depth"]): b["load"] for b in buckets}
    held = index.entries.groupBy("bucket", "depth").agg(F.sum(F.greatest("size", F.lit(1))).alias("n"), F.countDistinct("key").alias("keys")).collect()
    assert {(r.bucket, r.depth) for r in held} == set(load)
    for r in held:
        assert r.n <= 200 or r.keys == 1 or r.depth == max(depths)


def test_an_index_takes_further_documents(spark):
    rows = odd_docs(4)
    old, new = rows[:70], rows[70:]
    first = exact_dedup.stage(frame(spark, old))
    index = exact_dedup.build(first)
    more = exact_dedup.stage(frame(spark, new), index=index)
    both = exact_dedup.build(more, index)
    got = told(exact_dedup.assign(first, both)) + told(exact_dedup.assign(more, both))
    assert sorted(got, key=repr) == brute_groups(rows)
    assert index.lookup(first.select("key")).count() == index.entries.count()


def test_normalised_texts():
    for text in ("", " ", "\t\n", "a", " a", "a ", "\na\x0b\x0cb\r ", "a\xa0b", "a\x00 b\x1cc"):
        assert exact_dedup.normalised(text.encode()).decode() == re.sub("[ \t-\r]+", " ", text)


# ---------------------------------------------------------------- divergence


def brute_audit(rows, least=3, most=200):
    by = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    docs = collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        by[lang or ""][source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, sources in by.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        share = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[u] for u in kept) + v) for t in kept}  # noqa: B023, E731
        p = {s: share(c) for s, c in sources.items()}
        q = share(sum(sources.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if sources[s][t] > 0 and p[s][t] > q[t]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:cut]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, most", [(1, 200), (2, 2)])
def test_divergence(spark, monkeypatch, seed, most):
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    rows = odd_docs(seed)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), terms=most).collect())) == brute_audit(rows, most=most)


def test_divergence_without_kept_terms(spark):
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "fr", None), (4, "", "fr", "x")]
    got = sorted(map(tuple, divergence.audit(frame(spark, rows)).collect()))
    assert got == brute_audit(rows) and [r[4] for r in got] == [0] * 4


def test_runs_and_scans_in_small_parts(monkeypatch):
    rng = random.Random(3)
    counts = sorted((rng.choice("ab"), rng.choice(["", "x", "y", "z"]), rng.choice(["s", "t", "u"]), rng.randint(0, 2), rng.randint(1, 5)) for _ in range(200))
    names = ["lang", "term", "source", "docs", "n"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in counts[k : k + 7]]) for k in range(0, 200, 7)]
    runs = [r for b in divergence._runs(iter(batches), 20) for r in b.to_pylist()]
    want = {}
    for lang, term, source, docs, n in counts:
        held = want.setdefault((lang, term), [0, {}])
        held[0] += docs
        held[1][source] = held[1].get(source, 0) + n
    assert {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"], strict=True)) for r in runs} == {k: v[1] for k, v in want.items() if v[0] >= 20 or k[1] == ""}
    groups = divergence.Groups({x: {s: 50 + i for i, s in enumerate("stu")} for x in "ab"}, {"a": 3, "b": 3})
    batch = pa.RecordBatch.from_pylist(runs)

    def scanned():
        found = collections.Counter()
        for b in divergence._scan(iter([batch]), groups, 200):
            for r in b.to_pylist():
                found[r["lang"], r["source"], r["part"], r["item"]] += r["value"]
        return found

    whole = scanned()
    monkeypatch.setattr(divergence, "CELLS", 3)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 1)
    assert scanned() == whole and whole
    text = ("Ab cé! x" * 50).encode()
    plain = [t for part in divergence._parts(text) for t in part]
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 9)
    assert [t for part in divergence._parts(text) for t in part] == plain


def test_shares_beyond_64_bits():
    counts = np.array([0, 3, 10**12, 7 * 10**12])
    want = [1 + 10**9 * (int(c) + 1) // (8 * 10**12 + 50) for c in counts]
    assert divergence.share(counts, 8 * 10**12, 50).tolist() == want


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_exact_dedup", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(tuple, got.collect()), key=repr) == want and want


# ---------------------------------------------------------------- mixing and sharding


def test_key_ranges_are_even_with_many_poor_documents(spark, monkeypatch):
    from cliplane.llm import mixing

    monkeypatch.setattr(mixing, "RANGE_ROWS", 200)
    rng = np.random.default_rng(1)
    q = np.where(rng.random(20_000) < 0.1, 0.02, rng.uniform(0.1, 1, 20_000))
    rows = spark.createDataFrame([("a" if i % 3 else None, float(q[i]), float(-np.log(rng.random()) / q[i])) for i in range(len(q))], "source string, __quality double, __key double")
    ranged = mixing._ranges(rows)
    sizes = [r["count"] for r in ranged.groupBy("source", "__range").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 300 and len(sizes) == 67 + 34
    edges = ranged.groupBy("source", "__range").agg(F.min("__key").alias("low"), F.max("__key").alias("high")).orderBy("source", "__range").collect()
    for a, b in zip(edges, edges[1:]):
        assert a.source != b.source or a.high <= b.low  # ranges follow the order of keys


def test_shards_along_the_curve_prune_filters_on_several_dimensions(spark):
    from cliplane.llm import hilbert

    rng = random.Random(3)
    rows = [(i, "w" * rng.randint(1, 3000), rng.choice(["en", "fr", "de", "es"]), f"src{rng.randint(0, 15)}") for i in range(6000)]
    docs = spark.createDataFrame(rows, COLUMNS)
    found = hilbert.shard(docs, keep=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "size", "shard")
    found = [r.asDict() for r in found.collect()]
    touched = lambda test: len({r["shard"] for r in found if test(r)})
    filters = {"lang": lambda r: r["lang"] == "fr", "source": lambda r: r["source"] == "src3", "size": lambda r: r["size"] < 200, "doc_id": lambda r: r["doc_id"] < 400}
    shards = {k: touched(f) for k, f in filters.items()}
    assert all(n <= 18 for n in shards.values()) and sum(shards.values()) <= 64, shards  # in random order each filter meets all 24

"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and verified Hamming distances.

Fingerprints that differ in at most 3 of 64 bits agree in at least 3 of 6 blocks, so close pairs share one of the 20 keys
made of 3 blocks (about 32 bits each: few chance meetings even among billions of fingerprints). Equal fingerprints are
one node from the start, whatever number of copies they have.

A key with at most HOT different fingerprints is joined with itself and verified. A hotter key takes an exact way that is
linear in its size: two of its fingerprints are within 3 bits if and only if some value is within 1 bit of one and 2 bits
of the other (in the bits that the key leaves free); every member names the values within 2 bits, and each value that
some member is within 1 bit of links all its members to that one.

Components come from alternating large-star and small-star rounds over written tables.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any other. Repeated rows and null ids are rows
of their own; a component of null ids only has a null id. An empty table gives no rows. Kept columns may have any names; one
that is called fp, root or component_id gives way to the result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplane.llm.common import drop, materialise, quoted, scan_text

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
AGREE = BLOCKS - DISTANCE
#: Different fingerprints of a key that are joined pair by pair.
HOT = 256
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: A-Z only, and the blanks are \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -SHINGLE].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(text: pa.Array) -> list[pa.Array]:
    seen: dict[bytes, int] = {}
    out = []
    for t in text.cast(pa.large_binary()):
        raw = t.as_py() or b""
        if raw not in seen:
            seen[raw] = fingerprint(raw)
        out.append(seen[raw])
    return [pa.array(np.array(out, np.uint64).view(np.int64))]


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with fp: the fingerprint as a signed long."""
    return scan_text(docs, lambda: _fingerprints, [T.StructField("fp", T.LongType())], text_col, keep)


def block_masks() -> list[int]:
    """The bits of every choice of AGREE blocks."""
    edges = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in c) for c in combinations(range(BLOCKS), AGREE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between different fingerprints, enough that close ones are connected. fps: distinct fp."""
    masks = block_masks()
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)]))
    keyed = fps.select("fp", key.alias("k")).select("fp", "k.choice", "k.bits")
    shared = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = materialise(keyed.join(shared, ["choice", "bits"]), "simhash-members")
    cold = members.where(F.col("n") <= hot)
    left, right = cold.select("choice", "bits", F.col("fp").alias("a")), cold.select("choice", "bits", F.col("fp").alias("b"))
    pairs = left.join(right, ["choice", "bits"]).where((F.col("a") < F.col("b")) & _close(F.col("a"), F.col("b"))).select("a", "b")
    return pairs.unionByName(_hot_links(members.where(F.col("n") > hot), masks)).distinct()


def _hot_links(members: DataFrame, masks: list[int]) -> DataFrame:
    """Star edges through shared values, linear in the members of a key."""
    free = F.element_at(F.array(*[F.array(*[F.lit(b) for b in range(64) if not m >> b & 1]) for m in masks]), F.col("choice") + 1)
    none = F.array(F.lit(-1))
    one = members.select("choice", "bits", "fp", free.alias("free")).select("choice", "bits", "fp", "free", F.explode(F.concat(none, F.col("free"))).alias("x"))
    two = F.concat(none, F.filter("free", lambda y: (F.col("x") >= 0) & (y > F.col("x"))))  # no flip, one, or two in ascending order
    value = one.select("choice", "bits", "fp", "x", F.explode(two).alias("y"))
    flips = F.expr("if(x < 0, 0L, shiftleft(1L, x)) | if(y < 0, 0L, shiftleft(1L, y))")
    value = value.select("choice", "bits", "fp", F.col("fp").bitwiseXOR(flips).alias("value"), F.bit_count(flips).alias("far"))
    hub = value.groupBy("choice", "bits", "value").agg(F.min(F.struct("far", "fp")).alias("near"), F.count("*").alias("n"))
    hub = hub.where((F.col("near.far") <= 1) & (F.col("n") > 1)).select("choice", "bits", "value", F.col("near.fp").alias("hub"))
    star = value.join(hub, ["choice", "bits", "value"]).where(F.col("fp") != F.col("hub"))
    return star.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches."""
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "simhash-edges")
    sign = None
    while True:
        # large star: neighbours above a node hang from its smallest neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, hang from the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        below = large.join(least, "b")
        small = below.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        now, old = materialise(small, "simhash-edges"), now
        drop(old)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == sign:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        sign = tuple(found)


def cluster(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """docs (columns keep, default the id) with fp, root (one value for each component) and component_id (its smallest id)."""
    keep = [c for c in ([id_col] if keep is None else keep) if c not in ("fp", "root", "component_id")]
    own = [f"k_{i}" for i in range(len(keep))]
    named = docs.select(*[quoted(c).alias(k) for c, k in zip(keep, own, strict=True)], quoted(id_col).alias("__id"), quoted(text_col).alias("__text"))
    rows = materialise(fingerprints(named, "__text", [*own, "__id"]), "simhash-rows")
    nodes = rows.groupBy("fp").agg(F.min("__id").alias("__least"))
    root = components(links(nodes.select("fp"), hot))
    nodes = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "__least")
    nodes = materialise(nodes, "simhash-nodes")
    ids = nodes.groupBy("root").agg(F.min("__least").alias("component_id"))
    found = rows.join(nodes.join(ids, "root").select("fp", "root", "component_id"), "fp")
    return found.select(*[quoted(k).alias(c) for c, k in zip(keep, own, strict=True)], "fp", "root", "component_id")

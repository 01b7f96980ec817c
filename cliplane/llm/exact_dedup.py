"""Exact dedup: an extendible-hash index of texts on shared files.

Texts are equal when they are equal bytes once every run of blanks is one space.

1. stage: every task normalises its texts and keeps those it has seen in a dictionary of at most HELD_BYTES (by bytes, not by
   hash), so a text is sent about once by a task however many copies there are. One written table holds a narrow row for
   each document and an entry for each such text with its number of copies and its first document.
2. directory: the loads of the keys' leading bits say which buckets are over CAPACITY; each of those is split in two, doubling
   the directory by a bit, until none is (a bucket of one key can't be split). It starts at the depth that even loads would
   need; the loads of each first bucket lie in one task.
3. owners: entries and bucket headers are dealt by the directory's first bits and sorted by key, so that each task reads its
   ranges of keys bucket by bucket. Entries with one key are chained: their bytes are compared, and each chain holds different
   texts. The result is the index: files sorted by key with bucket, text, first document and number of copies.
4. Documents get their chain's result by key and digest; two chains with one key and one SHA-256 would be an error.

An index can take further documents: its entries join those of the new documents, and only loads decide about splits.

Edge cases: null text counts as empty; a text of blanks only is one space. Of rows with one smallest id one stays; null ids
come last. Repeated rows are copies. A text of any length is one entry and is compared whole. An empty table gives no rows. Kept
columns may have any names; one that is called like a result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm.common import materialise, quoted

#: Bytes of text that a bucket should hold at most.
CAPACITY = 4 << 20
#: Bytes of texts that a task holds to find copies among its own rows.
HELD_BYTES = 32 << 20
#: Bits that a bucket of the first directory can be split by.
DEEPER = 6
#: Buckets of the first directory for each owner task, so that ranges of keys are even.
RANGES = 8
#: Bytes of different texts that an owner task reads.
OWNED = 64 << 20
#: Bytes of rows and entries that a task gives away at once.
OUT_BYTES = 4 << 20

ENTRY = ["key", "sha", "text", "size", "copies", "first_none", "first_id", "first_row"]
_MIX = "key long, sha binary, text binary, size long, copies long, first_none boolean, first_id long, first_row long"


def normalised(text: bytes) -> bytes:
    """Every run of the blanks \\x20 and \\x09-\\x0D as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + b" ".join(words) + (b" " if text[-1:].isspace() else b"")


def xxh64(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


@dataclass(frozen=True)
class Index:
    """directory: (prefix, depth, load); entries: ENTRY and bucket columns, sorted by key in each file."""

    directory: DataFrame
    entries: DataFrame

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Entries of the given keys (column key)."""
        return self.entries.join(keys.select("key").distinct(), "key", "left_semi")


def stage(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", hash_of: Callable[[bytes], int] = xxh64, held_bytes: int = HELD_BYTES, index: Index | None = None
) -> DataFrame:
    """Written rows: (row, id, key, sha) of each document, and entries (text not null) of each task's different texts."""
    after = 0 if index is None else 1 + (index.entries.agg(F.max("first_row")).first()[0] or 0)
    row = F.monotonically_increasing_id() + F.lit(after)
    source = docs.select(row.alias("row"), quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[bytes, list] = OrderedDict()  # text -> [key, sha, copies, (no id, id, row)]
        held = size = 0
        out: list[tuple] = []

        def entry(text: bytes, found: list) -> None:
            nonlocal size
            out.append((None, None, found[0], found[1], text, len(text), found[2], *found[3]))
            size += len(text) + 200

        def flush() -> pa.RecordBatch:
            nonlocal size
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "id", *ENTRY])
            out.clear()
            size = 0
            return made

        for batch in batches:
            for row, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                text = normalised(raw.as_py() or b"")
                first = (doc is None, doc, row)
                found = seen.get(text)
                if found is None:
                    key = hash_of(text)
                    found = seen[text] = [key - (1 << 64) if key >> 63 else key, hashlib.sha256(text).digest(), 1, first]
                    held += len(text) + 200
                else:
                    seen.move_to_end(text)
                    found[2] += 1
                    found[3] = min(found[3], first, key=lambda x: (x[0], x[1] or 0, x[2]))
                out.append((row, doc, found[0], found[1], *[None] * 6))
                size += 100
                while held > held_bytes and len(seen) > 1:
                    old, found = seen.popitem(last=False)
                    held -= len(old) + 200
                    entry(old, found)
                if size > OUT_BYTES:
                    yield flush()
        while seen:
            entry(*seen.popitem(last=False))
            if size > OUT_BYTES:
                yield flush()
        if out:
            yield flush()

    return materialise(source.mapInArrow(run, f"row long, id long, {_MIX}"), "dedup-staged", "zstd")


def _prefix(key: Column, depth: Column) -> Column:
    """The leading bits of a key as a number."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (64 - depth).cast("int")))


def doubled(loads: DataFrame, capacity: int, start: int, most: int = DEEPER) -> DataFrame:
    """(prefix, depth, load) of the buckets after splitting what is overfull. loads: (key, size) of each entry."""
    fine = start + most
    cell, top = _prefix(F.col("key"), F.lit(fine)), _prefix(F.col("key"), F.lit(start))
    cells = loads.groupBy(cell.alias("cell"), top.alias("top")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
    cells = cells.repartition("top").withColumn("depth", F.lit(start))
    for k in range(most + 1):  # the loads of the buckets as they are, and the splits that they ask for
        own = Window.partitionBy("top", "depth", "prefix")
        cells = cells.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {fine} - depth)")).withColumn("load", F.sum("size").over(own))
        if k < most:
            split = (F.col("load") > capacity) & (F.min("low").over(own) != F.max("high").over(own))
            cells = cells.withColumn("depth", F.when(split, F.lit(start + k + 1)).otherwise(F.col("depth")))
    return cells.groupBy("prefix", "depth").agg(F.first("load").alias("load"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key, a bucket's header before its entries: chain equal keys and merge equal texts."""
    out: list[list] = []
    size = 0
    bucket, depth = None, None
    now, chain = None, []

    def close() -> None:
        nonlocal size
        if len({c[1] for c in chain}) < len(chain):
            raise ValueError("different texts with one key and one SHA-256")
        for c in chain:
            out.append(c)
            size += len(c[2]) + 200
        chain.clear()

    def flush() -> pa.RecordBatch:
        nonlocal size
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        made = pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[*ENTRY, "bucket", "depth"])
        out.clear()
        size = 0
        return made

    for batch in batches:
        columns = [batch.column(k) if k == 3 else batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for key, head, sha, text, n, copies, none, first_id, first_row, own, deep in zip(*columns, strict=True):
            if head:
                bucket, depth = own, deep
                continue
            if key != now:
                close()
                now = key
            text = text.as_py()
            for c in chain:
                if c[2] == text:
                    c[4] += copies
                    c[5:8] = min(c[5:8], [none, first_id, first_row], key=lambda x: (x[0], x[1] or 0, x[2]))
                    break
            else:
                chain.append([key, sha, text, n, copies, none, first_id, first_row, bucket, depth])
            if size > OUT_BYTES:
                yield flush()
    close()
    if out:
        yield flush()


def build(staged: DataFrame, index: Index | None = None, capacity: int = CAPACITY, owners: int | None = None) -> Index:
    """The index of what was staged, and of what an older index holds."""
    spark = staged.sparkSession
    entries = staged.where(F.col("text").isNotNull()).select(*ENTRY)
    if index is not None:
        entries = entries.unionByName(index.entries.select(*ENTRY))
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNED))
    start = max((2 * total // capacity).bit_length() - 2, (RANGES * parts - 1).bit_length())
    loads = entries.select("key", F.greatest("size", F.lit(1)).alias("size"))
    directory = materialise(doubled(loads, capacity, start), "dedup-directory")
    # headers: the smallest key (as an unsigned number) of each bucket
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in entries.schema.fields if f.name != "key"]
    low = F.expr("shiftleft(prefix, 64 - depth)").alias("key")
    heads = directory.select(low, F.lit(True).alias("head"), *none, F.col("prefix").alias("bucket"), F.col("depth").cast("int").alias("depth"))
    no_bucket = [F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("int").alias("depth")]
    rows = entries.select("key", F.lit(False).alias("head"), *ENTRY[1:], *no_bucket)
    owner = F.floor(_prefix(F.col("key"), F.lit(start)) * parts / F.lit(1 << start)).cast("int")
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = heads.unionByName(rows).repartitionById(parts, owner).sortWithinPartitions(unsigned, F.desc("head"))
    return Index(directory, materialise(dealt.mapInArrow(_chain, f"{_MIX}, bucket long, depth int"), "dedup-index", "zstd"))


def assign(staged: DataFrame, index: Index, id_col: str = "doc_id") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, bucket) of the documents that were staged."""
    first = [F.col("first_id").alias("keep_id"), "first_row", F.col("copies").alias("group_size"), "bucket"]
    rows = staged.where(F.col("text").isNull()).select("row", F.col("id").alias(id_col), "key", "sha")
    both = rows.join(index.entries.select("key", "sha", *first), ["key", "sha"])
    kept = (F.col("row") == F.col("first_row")).alias("kept")
    return both.select(quoted(id_col), "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"), "bucket")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each document: assign() out of an index of its own."""
    staged = stage(docs, text_col, id_col)
    return assign(staged, build(staged, **how), id_col)


#: The same rule by a window over whole texts.
SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""

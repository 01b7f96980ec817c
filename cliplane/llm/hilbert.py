"""Sharding along a Hilbert curve over quantised metadata.

Size class, id, source and language are quantised to BITS bits each; rows are sorted by the index of their cell on the
Hilbert curve and cut into runs of equal row counts (law `rows`), so that each shard covers a compact region and files can
be pruned on any of the dimensions.

Ids are cut at approximate quantiles of their rows, so one outlier doesn't flatten the others. Sources and languages are
cut at quantiles of their different values, in the order of their text, so neighbours in name are neighbours in space and
a handful of values get a cell each. All cuts together are under 200 numbers.

The order is a range partitioning by (curve, id, CRC, size, source, language, place in the input). The last column makes
the key unique, so a hot cell, or a third of all rows being equal, spreads over ranges like any other rows. Rows are numbered
inside their range while they are written in order; a range's first number is a prefix sum over one row a range.

Edge cases: null text has size 8 and CRC 0; null id, source and lang have cell 0. Repeated rows and ties each take a slot
of their own, in an order fixed by their values. An empty table gives no rows. Columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm.common import materialise, quoted

BITS = 6
DIMS = 4
SHARDS = 24
#: Most cell of a dimension; cell 0 is that of nulls.
MOST = (1 << BITS) - 1
#: Rows of a range (its sort spills, so this is about balance, not about memory), with few and with all columns.
RANGE_ROWS = {"narrow": 2_000_000, "wide": 200_000}
_NULL = -(1 << 63)


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of non-negative coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess rotations
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _name_key(name: Column, skip: int) -> Column:
    """The seven bytes of a name behind its first `skip` bytes as a number in the order of the names; null stays null."""
    seven = F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), skip + 1, 7)), 14, "0")
    return F.conv(seven, 16, 10).cast("long")


def _common_prefix(a: str | None, b: str | None) -> int:
    x, y = (a or "").encode(), (b or "").encode()
    return next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def _cuts(df: DataFrame, column: Column) -> list[int]:
    """At most MOST - 1 ascending cut points that leave about as many rows of df on both sides of each step."""
    shares = [k / MOST for k in range(1, MOST)]
    found = df.select(column.alias("v")).agg(F.percentile_approx("v", shares, 10_000).alias("q")).first()["q"]
    return found or []


def quantiser(docs: DataFrame, id_col: Column, names: list[Column]):
    """(key columns of the names, pandas UDF from size, id and the name keys to the curve index)."""
    ends = docs.agg(*[f(n).alias(f"{f.__name__}{k}") for k, n in enumerate(names) for f in (F.min, F.max)]).first()
    keys = [_name_key(n, _common_prefix(ends[f"min{k}"], ends[f"max{k}"])) for k, n in enumerate(names)]
    cuts = [np.array(_cuts(docs, id_col), np.int64)]
    cuts += [np.array(_cuts(docs.select(k.alias("n")).distinct(), F.col("n")), np.int64) for k in keys]

    def cell(values: pd.Series, at: np.ndarray) -> np.ndarray:
        v = values.to_numpy(np.int64)
        return np.where(v == _NULL, 0, 1 + np.searchsorted(at, v, side="left"))

    def index(size: pd.Series, *rest: pd.Series) -> pd.Series:
        by_size = np.clip(np.floor(4 * np.log2(size.to_numpy(np.float64)) - 12), 0, MOST)
        return pd.Series(hilbert_index(np.stack([by_size, *map(cell, rest, cuts)], axis=1), BITS))

    def curve(size: pd.Series, ident: pd.Series, source: pd.Series, lang: pd.Series) -> pd.Series:
        return index(size, ident, source, lang)

    return keys, F.pandas_udf(curve, "long")


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """docs (columns keep, default the id) with size, text_crc32, curve, law, shard, slot and grown_shard."""
    spark = docs.sparkSession
    new = ["size", "text_crc32", "curve", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in ([id_col] if keep is None else keep) if c not in new]
    col = {c: (quoted(c) if c in docs.columns else F.lit(None)).cast("string") for c in ("source", "lang")}
    ident = quoted(id_col).cast("long")
    keys, curve = quantiser(docs, ident, list(col.values()))
    text = quoted(text_col).cast("string")
    # kept columns get names of their own, so that none of them can be taken for a working column
    rows = docs.select(
        *[quoted(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        ident.alias("__id"),
        *[v.alias(f"__{c}") for c, v in col.items()],
        *[F.coalesce(v, F.lit(_NULL)).alias(f"__n{k}") for k, v in enumerate([ident, *keys])],
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = rows.withColumn("curve", curve("size", "__n0", "__n1", "__n2")).drop("__n0", "__n1", "__n2")
    order = ["curve", "__id", "text_crc32", "size", "__source", "__lang", "__row"]
    total = docs.count()
    wide = text_col in keep
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(fewest, -(-total // RANGE_ROWS["wide" if wide else "narrow"]))
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # monotonically_increasing_id is the range's number, shifted by 33 bits, plus the row's number in it
    placed = placed.withColumn("__place", F.monotonically_increasing_id()).drop("__id", "__source", "__lang", "__row")
    placed = materialise(placed, "hilbert-sorted")
    part, at = F.shiftrightunsigned("__place", 33).alias("__part"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part).agg(F.count("*").alias("__n"))  # one row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    counts = F.broadcast(counts)  # 16 bytes a range: under 10 MB for 10^11 rows
    placed = placed.withColumn("__part", part).join(counts, "__part").withColumn("__at", F.col("__before") + at)
    small, extra = divmod(total, shards)
    big = extra * (small + 1)
    in_big, in_small = F.expr(f"__at div {small + 1}"), F.expr(f"{extra} + (__at - {big}) div {max(small, 1)}")
    placed = placed.withColumn("shard", F.when(F.col("__at") < big, in_big).otherwise(in_small).cast("int"))
    first = F.col("shard") * F.lit(small) + F.least(F.col("shard"), F.lit(extra))
    return placed.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard",
        (F.col("__at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

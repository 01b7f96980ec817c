"""Mixing sources to target weights by Efraimidis-Spirakis sampling [DataFrame functions only].

Each source gets a token target by water-filling. Complete epochs of a source come first; the rest of its target is
filled in the order of exponential keys, scaled by document quality weights, up to the token budget; the document at the
budget's edge gives the words that are left. Keys come from a hash of the id and the text, so reruns agree.

The quality weight of a document is a product of four factors: usual length of its words, enough words, few repeated words,
few signs. It lies between 0.02 and 1.

The prefix sums need no single-task sort of a source: keys are cut into ranges of about RANGE_ROWS rows. The cuts are quantiles
of the keys: a key is exponential with its document's quality as rate, so its distribution in a source follows from the
numbers of documents by (rounded) quality. Sizes are summed by (source, range), these sums are added up in blocks of BLOCK ranges and then over blocks, and rows are summed within a range
only. Where a single key has more than HOT rows (one row repeated over and over; such rows have equal sizes and may change
places), the rows of that key are dealt by their row number to parts of their own.

Edge cases: null text has size 0 and takes nothing; the null source is a source, last in order; null ids are told apart by
their texts. Repeated rows are separate rows of one key. An empty table gives no rows. Kept columns may have any names; those
of results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm.common import materialise, quoted

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2.0
SEED = "mix"
#: Rows of a source that one key range should hold, and ranges of a block.
RANGE_ROWS = 2_000
BLOCK = 4096
#: Sources whose grades (under 1 KB each) are broadcast; more are joined by a shuffle.
MOST_SENT = 8192
#: A range with more rows is searched for keys that more than RANGE_ROWS rows share.
HOT = 50_000
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[!-/:-@\[-`{-~]"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(size: Column, chars: Column, different: Column, signs: Column) -> Column:
    """0.02 to 1, from the numbers of words, characters, different words and signs of a text."""
    n, length = F.greatest(size, F.lit(1)).cast("double"), F.greatest(chars, F.lit(1)).cast("double")
    usual = 1 / (1 + F.abs(length / n - 6.5) / 6.5)
    enough = (size + 10) / (size.cast("double") + 50)
    varied = 0.25 + 0.75 * F.least(F.lit(1.0), 2 * different / n)
    plain = 1 - F.least(F.lit(0.75), 5 * signs / length)
    return F.greatest(F.lit(0.02), usual * enough * varied * plain)


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1], from the first 48 bits of an MD5 of id and text."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) with target: weights share the whole, a target stops at epochs sizes, the excess is reshared."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    df = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    df = df.withColumn("__cap", epochs * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    every = Window.partitionBy(F.lit(1))
    by_ratio = Window.orderBy("__ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # if all before this one in the order of cap / weight are capped, the others share the rest at this level; it rises up to
    # the last source that is capped and falls after it, so the largest is the one that holds
    capped = F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0.0))
    left = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(by_ratio), F.lit(0.0))
    df = df.withColumn("__level", (share * F.sum("source_size").over(every) - capped) / left)
    df = df.withColumn("__water", F.max("__level").over(every))
    return df.select("source", "source_size", F.least("__cap", F.col("__water") * F.col("__w")).alias("target"))


def _ranges(keyed: DataFrame) -> DataFrame:
    """keyed (source, __quality, __key) with __range: the key's place among ranges of about RANGE_ROWS rows of its source."""
    grade = F.round(F.log("__quality") * 8).alias("__grade")
    grades = keyed.groupBy("source", grade).agg(F.count("*").alias("n"), F.avg("__quality").alias("q"))
    # at most 33 grades a source
    grades = grades.groupBy(F.col("source").alias("r_source")).agg(F.collect_list(F.struct("n", "q")).alias("grades"), F.sum("n").alias("rows"))
    grades = materialise(grades, "mix-grades")
    if grades.count() <= MOST_SENT:
        grades = F.broadcast(grades)
    rows = keyed.join(grades, F.col("source").eqNullSafe(F.col("r_source")))
    below = F.aggregate("grades", F.lit(0.0), lambda total, g: total - g["n"] * F.expm1(-g["q"] * F.col("__key"))) / F.col("rows")
    ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    return rows.withColumn("__range", F.least(ranges - 1, F.floor(ranges * below)).cast("long")).drop("r_source", "grades", "rows")


def _parts(keyed: DataFrame, hot: int) -> DataFrame:
    """keyed (source, __range, __key, __row) with __part: an array by which the rows of a range can be summed in the order of keys."""
    none = F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<long>")
    heavy = keyed.groupBy("source", "__range").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    heavy = heavy.select(F.col("source").alias("h_source"), F.col("__range").alias("h_range"))
    if heavy.isEmpty():
        return keyed.withColumn("__part", none)
    same = F.col("source").eqNullSafe(F.col("h_source")) & (F.col("__range") == F.col("h_range"))
    keys = keyed.join(heavy, same, "left_semi").groupBy("source", "__range", "__key").agg(F.count("*").alias("n")).where(F.col("n") > RANGE_ROWS)
    keys = keys.groupBy(F.col("source").alias("h_source"), F.col("__range").alias("h_range"))
    keys = keys.agg(F.array_sort(F.collect_list("__key")).alias("keys"), F.max("n").alias("n"))  # at most rows / RANGE_ROWS keys in all
    rows = keyed.join(keys, same, "left")
    below = F.size(F.filter("keys", lambda k: k < F.col("__key")))
    shared = F.array_contains("keys", F.col("__key"))
    deal = F.pmod(F.xxhash64("__row"), F.ceil(F.col("n") / RANGE_ROWS))
    part = F.array(below.cast("long"), shared.cast("long"), F.when(shared, deal).otherwise(0).cast("long"))
    return rows.withColumn("__part", F.when(F.col("keys").isNull(), none).otherwise(part)).drop("h_source", "h_range", "keys", "n")


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    keep: list[str] | None = None,
    hot: int = HOT,
) -> DataFrame:
    """docs (columns keep, default the id) with size, source_size, target and taken."""
    new = ["size", "source_size", "target", "taken"]
    keep = [c for c in ([id_col] if keep is None else keep) if c not in new]
    text = quoted(text_col).cast("string")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    narrow = docs.select(
        *[quoted(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        quoted(id_col).alias("__id"), quoted(source_col).cast("string").alias("source"), words(text).alias("size"),
        number(F.length(text)).alias("__chars"), number(F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))).alias("__different"),
        number(F.regexp_count(text, F.lit(SIGNS))).alias("__signs"), uniform(quoted(id_col), text).alias("__u"), F.monotonically_increasing_id().alias("__row"),
    )
    narrow = materialise(narrow, "mix-rows")  # the text is read once
    sizes = narrow.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("__rows"))
    graded = narrow.withColumn("__quality", quality(*[F.col(c) for c in ("size", "__chars", "__different", "__signs")]))
    keyed = graded.withColumn("__key", -F.log("__u") / F.col("__quality"))
    keyed = _parts(_ranges(keyed), hot)
    place = ["source", "__range", "__part"]
    per = keyed.groupBy(place).agg(F.sum("size").alias("__sum")).withColumn("__block", F.floor(F.col("__range") / BLOCK))
    first = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("source", "__block").agg(F.sum("__sum").alias("__sum")).select(
        F.col("source").alias("b_source"), F.col("__block").alias("b_block"), F.coalesce(F.sum("__sum").over(first), F.lit(0)).alias("__blocks_before")
    )
    goal = targets(sizes.select("source", "source_size")).withColumnRenamed("source", "g_source")
    before = Window.partitionBy("source", "__block").orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    per = per.join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("__block") == F.col("b_block")))
    per = per.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    per = per.select(*[F.col(c).alias(f"p{c}") for c in place], (F.col("__before") + F.col("__blocks_before")).alias("__before"), "source_size", "target")
    rows = keyed.join(per, F.col("source").eqNullSafe(F.col("psource")) & (F.col("__range") == F.col("p__range")) & (F.col("__part") == F.col("p__part")))
    within = Window.partitionBy(place).orderBy("__key", "__id", "size", "__chars", "__row").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("__before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("__prefix", prefix).withColumn("__full", full)
    rows = rows.withColumn("__budget", F.round(F.col("target") - F.col("__full") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__budget") - F.col("__prefix")))
    taken = (F.col("__full") * F.col("size") + part).cast("long").alias("taken")
    return rows.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", taken)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS chars,
    coalesce(len(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 0)::BIGINT AS different,
    coalesce(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')), 0)::BIGINT AS signs, md5(coalesce(text, '')) AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source
), r AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(2e0 * source_size) OVER o, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0e0)) AS level
  FROM s WINDOW o AS (ORDER BY 2e0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(2e0 * source_size, w * max(level) OVER ()) AS target FROM r
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || hash), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656e0)
    / greatest(0.02e0, (1e0 / (1e0 + abs(greatest(chars, 1)::DOUBLE / greatest(size, 1)::DOUBLE - 6.5e0) / 6.5e0))
      * ((size + 10) / (size::DOUBLE + 50e0))
      * (0.25e0 + 0.75e0 * least(1e0, (2 * different) / greatest(size, 1)::DOUBLE))
      * (1e0 - least(0.75e0, (5 * signs) / greatest(chars, 1)::DOUBLE))) AS key
  FROM d
), p AS (
  SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - prefix)))::BIGINT AS taken FROM p
"""

"""From raw documents to sharded training data: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the columns of documents.

Edge cases: null and empty texts are scored like any other, make one group of near-duplicates (fingerprint zero), have no
hits, and have size 0, so the mix doesn't take them. Of a group of near-duplicates the row with the smallest id stays (null
last); rows that are equal in id and text are ordered by all their other columns, and rows that are equal in every column
are one. Null sources are a source. Empty tables give no rows. Columns of documents may have any names; in the last stage
those of its results give way to them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliplane.llm import decontaminate, hilbert, mixing, simhash, toxicity
from cliplane.llm.common import drop, quoted, shared_dir, table


#: Columns that the operators read; a stage keeps the others out of the way, since their names may be those of an operator's results.
READ = ("doc_id", "text", "source", "lang")


def aside(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: f"__kept{k}" for k, c in enumerate(docs.columns) if c not in READ})


def back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, out of rows that were computed from aside(docs)."""
    return found.select(*[quoted(c if c in READ else f"__kept{k}").alias(c) for k, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows of documents."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return back(toxicity.score(aside(docs), model).where(F.col("predicted") == 0), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: that with the smallest id (ties: smallest text hash)."""
    text_hash = F.xxhash64(F.col("text").cast("string"))
    narrow = simhash.cluster(docs.select("doc_id", "text", text_hash.alias("hash")), keep=["doc_id", "hash"])
    first = narrow.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("k_id"), F.col("first.hash").alias("k_hash"))
    own = [f"c{k}" for k in range(len(docs.columns))]  # names that clash with none of this stage
    left = docs.select(*[quoted(c).alias(n) for c, n in zip(docs.columns, own, strict=True)], quoted("doc_id").alias("id"), text_hash.alias("hash"))
    left = left.join(kept, left["id"].eqNullSafe(kept["k_id"]) & (left["hash"] == kept["k_hash"]), "left_semi")
    # rows that are equal in id and text stand side by side now: one of them stays
    same = Window.partitionBy("id", "hash").orderBy(*[n for n in own if docs.schema[own.index(n)].dataType.typeName() != "map"])
    left = left.withColumn("place", F.row_number().over(same)).where(F.col("place") == 1)
    return left.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule finds go; the others stay as they are."""
    return back(decontaminate.scan(aside(docs), table(spark, sf_dir, "benchmark")).where(~decontaminate.contaminated()), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated once for each epoch that takes it; documents that the mix doesn't take go. Texts stay whole."""
    plain = aside(docs)
    taken = mixing.mix(plain, keep=plain.columns)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return back(taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))), docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot along the Hilbert curve."""
    new = ["size", "text_crc32", "law", "shard", "slot"]
    return hilbert.shard(docs, keep=docs.columns).select(*[quoted(c) for c in docs.columns if c not in new], *new)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard_documents)]

#: Trees, fingerprints and Hilbert order are no SQL; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written as Parquet and read again, and go once the next ones are there."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            drop(last)
        docs = last = spark.read.parquet(path)
    return docs

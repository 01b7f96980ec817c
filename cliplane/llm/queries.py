"""The thirteen queries over whole tables, with the columns of their contracts, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplane.llm import collocations, decontaminate, divergence, exact_dedup, hilbert, langid, licenses, mixing, secrets, simhash, toxicity, warc, webp
from cliplane.llm.common import table


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_webp_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(toxicity.fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    name = F.array(*[F.lit(k) for k in secrets.KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    links = F.array_join(F.transform("links", lambda x: F.concat(one(x), F.lit(">"), one(x["with"]))), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    count = [F.size(F.filter(kinds, lambda _: _ == k)).cast("long").alias(n) for k, n in enumerate(("n_assign", "n_access", "n_hex"))]  # noqa: B023
    return found.select("doc_id", *count, F.sha2(secrets.listing(F.col("base")), 256).alias("base_sha256"), secrets.listing(F.col("all")).alias("spans"), links.alias("links"))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = warc.complete(warc.read(warc.write(pages)), pages.count())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs), keep=["doc_id"]).select("doc_id", F.coalesce(langid.fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_hilbert_sharding, op2_fm_decontamination, op3_license_templates, op4_simhash_blocks, op5_webp_lossless, op6_toxicity_trees, op7_secret_linking, op8_warc_salvage, op9_language_viterbi, op10_weighted_mixing, op11_phrase_collocations, op12_exact_dedup, op13_source_divergence)
    return {f.__name__: f for f in every}


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), p AS (
  SELECT DISTINCT coalesce(item_id, '') AS item_id, least(len(words), 13) AS n, array_to_string(list_slice(words, i, i + 12), ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM b WHERE len(words) > 0)
), s AS (SELECT DISTINCT n FROM p), g AS (
  SELECT doc_id, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, s WHERE len(words) >= n)
), o AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force: Hilbert order, automata, XXH64, images, trees, Viterbi and positions are no SQL."""
    return {"op2_fm_decontamination": OP2_SQL, "op8_warc_salvage": warc.SQL, "op10_weighted_mixing": mixing.SQL, "op11_phrase_collocations": collocations.SQL, "op12_exact_dedup": exact_dedup.SQL, "op13_source_divergence": divergence.SQL}

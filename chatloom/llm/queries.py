"""Queries over the given tables: each operator applied to its whole table, as results ask for."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import (
    alignment, ann, decontam, huffman, licenses, maskedlm, packing, pii, quality, simhash, treebpe, warc, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = huffman.archived(_table(spark, sf_dir, "documents"))
    return huffman.read_digests(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op4_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), decontam.indexes(_table(spark, sf_dir, "benchmark")))


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, with_payload=False).drop("payload", "url")


def held_out(doc_id: str = "doc_id"):
    """Whether an id's labels are kept from training."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2


def quality_weights(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = _table(spark, sf_dir, "labels").where(~held_out())
    return quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.scores(docs, quality_weights(spark, docs, sf_dir))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maskedlm.scored(_table(spark, sf_dir, "documents"))


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.found(docs, pii.fit(docs))


def op9_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op11_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents")).drop("groups")


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_huffman_ids": op1_huffman_ids,
    "op2_simhash_components": op2_simhash_components,
    "op3_license_scan": op3_license_scan,
    "op4_bm25_decontamination": op4_bm25_decontamination,
    "op5_warc_dictionary": op5_warc_dictionary,
    "op6_ftrl_quality": op6_ftrl_quality,
    "op7_masked_lm": op7_masked_lm,
    "op8_skip_chain_pii": op8_skip_chain_pii,
    "op9_collision_counting": op9_collision_counting,
    "op10_sum_of_squares_packing": op10_sum_of_squares_packing,
    "op11_incremental_whitening": op11_incremental_whitening,
    "op12_token_alignment": op12_token_alignment,
    "op13_tree_bpe": op13_tree_bpe,
}

#: What SQL can say of them; the others are compared with plain Python in the tests.
ORACLES: dict[str, str] = {
    "op5_warc_dictionary": """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS lead,
    list_transform(range(8), lambda i: cast('0x' || substr(hex, 5 * i + 1, 5) AS bigint)) AS twenty_bits FROM p
)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + ((list_extract(twenty_bits, cast(j // 4 + 1 AS int)) >> (5 * (3 - j % 4))) & 31) AS int), 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM f""",
}

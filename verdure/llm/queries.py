"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.llm import bpe, html_extract, line_dedup, media, near_dup, packing, quality, secrets, token_store, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)


OP1_SQL = line_dedup.SQL.format(docs="documents")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(spark, pages(spark, sf_dir))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last > page_id THEN last END AS refers_to
FROM p LEFT JOIN m USING (payload_digest, payload_bytes)
"""


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = media.store(documents(spark, sf_dir))
    return media.media_columns(media.read_media(spark, folder, manifest))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=2, percent=80)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.rules(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")

    base = F.sha2(joined(F.filter("spans", lambda s: s.kind != "crf")), 256)
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op9_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_documents(token_store.write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(pages(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_warc, op3_media_columns, op4_minhash_near_dedup, op5_quality_rules, op6_secret_scans, op7_best_fit_packing, op8_bpe_trie, op9_token_wavelet, op10_html_extraction)
}
SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_warc": OP2_SQL}

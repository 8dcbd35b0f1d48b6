"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import Scratch, prepare, saved, table

from . import bpe, decontaminate, line_dedup, lm_score, merkle, near_dedup, oracles, pii, quality, secret_scan, token_counts, vector_codes, warc, weighted_sampling

#: Where the public tokenizers lie; the path is a parameter of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The time of capture of pages, whose tables tell none.
CAPTURED = "2024-01-31T00:00:00Z"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(prepare(spark), sf_dir, "documents")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(secret_scan.find(table(prepare(spark), sf_dir, "documents")), kinds=secret_scan.BASE)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(documents, BYTE_BPE, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.digest(bpe.decode(ids, BYTE_BPE, public_tokenizers.PATTERN))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(prepare(spark), sf_dir, "documents"), words_per_shingle=2, percent=80)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find(documents, table(spark, sf_dir, "benchmark"), offsets=False))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.floor(F.col("quality") * 1_000_000 + 0.5) / 1_000_000
    return quality.assess(table(prepare(spark), sf_dir, "documents")).withColumn("quality", shown)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(prepare(spark), sf_dir, "pages")), CAPTURED)
    return records.select("page_id", "type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "content_length", "source_status", "source_headers", "payload_digest", "block_digest")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(prepare(spark), sf_dir, "documents"), PIECES)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    lines = pages.select("page_id", line_dedup.url_host(F.col("url")).alias("host"), warc.plain_text(F.col("html")).alias("text"))
    return line_dedup.clean(saved(lines), report="n_dropped").select("page_id", "host", "n_dropped", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(prepare(spark), sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(prepare(spark), sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = merkle.leaf([F.col(c) if c != "text" else F.replace("text", F.lit("\n"), F.lit("")) for c in columns])
    with Scratch(spark) as scratch:
        rows = merkle.manifest(scratch, documents, columns, key="doc_id", group="source", other=F.when(even & F.contains("text", F.lit("\n")), tampered))
        rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("other", "leaf"), F.col("proof")))
        return saved(rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(prepare(spark)) as scratch:
        return saved(weighted_sampling.with_next(scratch, table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(prepare(spark)) as scratch:
        rows, books = vector_codes.compress(scratch, table(spark, sf_dir, "embeddings"))
        code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
        coded = saved(rows.select(F.col("id").alias("vec_id"), "label", code.alias("code"), "error"))
    return vector_codes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_secrets": op2_secrets,
    "op3_bpe": op3_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_merkle": op11_merkle,
    "op12_fingerprints": op12_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {"op4_near_dedup": oracles.OP4, "op5_decontaminate": oracles.OP5, "op6_quality": oracles.OP6, "op7_warc": oracles.OP7, "op9_line_dedup": oracles.OP9, "op11_merkle": oracles.OP11, "op13_vector_codes": oracles.OP13}

"""The training-data pipeline over documents: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

Stages take docs with more columns, of whatever names, and keep them; the last one replaces columns called
ids, n_tokens and round_trip. Empty docs give empty results. Null and blank texts have no words and fall to
the quality rules; in the stages behind, where none are left, they would stay as they are, without lines, links, hits or
ids. Rows that repeat are judged alike; of near duplicates the smallest id stays, of rows that share it all do,
and rows without an id stay. Texts of any length are read whole. Temporary columns never clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from larkspur.session import delete, owned, prepare, shared_folder, table, unused, written

#: A line on more than this share of a source's documents is boilerplate. Of the good documents of sf0.1, the
#: commonest line is on 8.8 to 14.0 % of each of the 20 sources and no other is on more than 5.4 % of one: the
#: ratio is the middle of that gap, so that a line is judged alike on all sources.
BOILERPLATE_RATIO = 0.07
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules judge good."""
    prepare(spark)
    return quality.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate on their source; those that hold nothing else are left whole. n_chars is that of the text that is left."""
    prepare(spark)
    cleaned = line_dedup.clean(docs, page_id="doc_id", host="source", ratio=BOILERPLATE_RATIO, emptied=False)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    prepare(spark)
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in passages of the benchmark."""
    return decontaminate.drop(docs, table(prepare(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and whether the ids decode to the text."""
    prepare(spark)
    text = unused("decoded", docs.columns)
    ids = bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN)
    back = bpe.decode(ids, BYTE_BPE, public_tokenizers.PATTERN, out=text)
    return back.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": F.col(text) == F.coalesce("text", F.lit(""))}).drop(text)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the signatures nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Stages are written below the folder that all executors share; each is deleted once the next one is written, and what a stage saved in between once it is."""
    folder = f"{shared_folder(prepare(spark))}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with owned(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return docs

"""From raw documents to packed sequences: quality rules, near-dedup, secret masking, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run``
writes what a stage returns as Parquet in the shared folder and reads it again as the next one's documents.

Edge cases: a null text is empty and has too few words, so the first stage rejects it; given to the other stages, it is a
text like any other (null stays null), is no secret, is taken no words of by the mix, and is packed as its end token alone.
Null doc_ids, sources and other columns are kept, a null source being one source, the last. Texts of any length are read
whole. Of repeated rows near-dedup keeps one, as of all copies; ties go to the smallest doc_id, then to the smallest hash of
the text. An empty table gives an empty result at every stage. Columns beyond those of documents are carried along, whatever
their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramspark.llm import mixing, packing, quality, secrets, simhash
from engramspark.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: of texts whose fingerprints link, and of texts with most segments in common."""
    return simhash.without_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return secrets.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", packed),
]

#: SQL has neither XXH64, nor a byte-pair vocabulary, nor knapsacks; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

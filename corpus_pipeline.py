"""Training-data pipeline: stages applied to documents, one after another. Part of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import exact, mixing, neardup, pieces, quality
from lexmill.llm.common import Scratch, read, without


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows of docs.

    Null and empty texts are judged as the empty text, rows keep their multiplicity, an empty table stays empty.
    """
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space.

    Null texts count as empty and are equal to each other; of repeated rows one stays. An empty table stays empty.
    """
    return exact.radix_groups(docs, rows=True).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8.

    Null and empty texts and null ids are linked with nothing and stay. Rows of one doc_id stay or go together. An
    empty table stays empty.
    """
    dropped = neardup.near_duplicates(docs, neardup.WORDS).filter(~F.col("kept")).select("doc_id")
    return without(docs, Scratch(spark, "near").keep(dropped))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources draws them.

    Null texts have size 0, a null source is a source of its own, an empty table stays empty.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every drawn document: their number and digest, and the digest of the text they decode to.

    Null texts count as empty and have no ids; rows keep their multiplicity; an empty table gives an empty result.
    """
    return pieces.summary(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The classifier and the encoder have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs

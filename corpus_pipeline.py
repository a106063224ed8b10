"""The corpus pipeline: five stages from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept. All but the last return the columns of
documents; the last returns what the encoder makes of each document that is left.

Odd input: an empty table gives an empty result in every stage, and further columns of ``docs`` pass through, whatever
their names. What a stage does with nulls, empty and very long texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import linededup, mixing, pieces, quality, simhash
from tomewright.llm.common import materialize, set_aside
from tomewright.llm.queries import LEVELS, SEED, WEIGHTS

#: Share of the tokens left that the mixture asks for; a document is taken once at most.
FRACTION = 0.9


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null, empty and blank texts score 0 and go, as long as there is anything to learn from. A null in the metadata is a value
    like others. Repeated rows have one score and go or stay together; a null id has no label.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; n_chars follows the text; documents that were nothing but repeats go.

    Null, empty and blank texts stay as they are. Rows with a null id stay unchanged. Rows that repeat an id with one text
    are one document and lose the same lines; of equal runs the one of the smallest id, text hash and line stays.
    """
    cut = linededup.dedup_lines(docs, drop_emptied=True)
    return cut.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    All null, empty and blank texts are one group. Rows with a null id stay. Rows that repeat an id stay or go together,
    and tie the groups of their texts to each other.
    """
    return simhash.keep_first(docs, simhash.near_duplicates(docs)).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes; a source is never repeated here.

    Null and empty texts and rows with a null id take no part and go. Null languages and sources are the level "". Repeated
    rows count each, and all rows of an id stay if any of them is taken; documents of equal rank are taken by id.
    """
    taken = materialize(mixing.mix(docs, LEVELS, WEIGHTS, FRACTION, seed=SEED, max_epochs=1).select("doc_id").distinct(), "mix-taken")
    left = materialize(docs.select("doc_id").join(taken, "doc_id", "left_anti").distinct(), "mix-left")
    some, rest = set_aside(docs, ["doc_id"], left)  # most documents are taken: they stay where they are
    return rest.select(*docs.columns).unionByName(some.join(taken, "doc_id", "left_semi").select(*docs.columns))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and the text that they decode to; the columns of documents but text stay.

    Null and empty texts have the end id only and decode to the empty text. Every row is encoded on its own, however long.
    """
    return pieces.encode_pieces(docs, caches=pieces.LEAN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing_sources", mixing_sources),
    ("sentencepiece_encoding", sentencepiece_encoding),
]
#: SQL can't express the first, third and last stage; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

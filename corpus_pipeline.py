"""A training corpus from documents: quality rules, exact and near duplicates, source mix, packed sequences.

Every stage is written as Parquet to the shared folder and read back as the
next one's input, so a lost executor costs at most one stage's tasks.  Rows with equal
or null ids are documents of their own in every stage; of ids in an order, null
is the smallest.  A null text is an empty one, a null language or source is a
value of its own, texts of any length are taken whole, an empty table gives an
empty table.  All stages but the last return the columns they got, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sagalog.llm.common import materialize
from sagalog.llm.exact_dedup import exact_dedup
from sagalog.llm.mixing import mixed_documents
from sagalog.llm.near_dedup import near_dedup
from sagalog.llm.packing import pack
from sagalog.llm.quality import quality_filter
from sagalog.llm.queries import tokenizer_file
from sagalog.plans.cluster import ship

#: Similarity of word 5-shingles, in percent, from which two texts are near duplicates.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are multivariate outliers go.

    Null, empty and short texts fail the base rules; rows repeated word for word are judged alike.
    """
    ship(spark)
    return quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null and empty texts are one group; of rows with the same id and text one stays.
    """
    ship(spark)
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (word shingles at NEAR_PERCENT) the document with the smallest id stays.

    Texts without words are near to nothing and stay.
    """
    ship(spark)
    return near_dedup(docs, percent=NEAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: one row per document and pass, with the words that the pass takes.

    Texts without words have none to take and give no row.
    """
    ship(spark)
    return mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence; an empty text is its end token, rows with equal ids are packed each on its own."""
    ship(spark)
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("packing", packed_sequences),
]

#: The outlier estimates, the similarity classes and the tokenizer can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

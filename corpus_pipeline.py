"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, and further ones as they are, whatever their names.

Nulls: a null text counts as empty, a null source is a source of its own, a null id is a document like any other. Rows
that repeat an id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tidewave.llm.common import remove, scratch, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model calls toxic go. It is fitted on this stage's own input and the table ``labels``.

    Empty and null texts stay; without toxic labels all do. Each row is judged by its own text.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, of those the one with the smallest id, and of those one row.

    Empty and null texts are equal to one another.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id stays.

    An id shared by unlinked texts takes none of them away. Texts without words all stay.
    """
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is shown once; those of rarer sources up to twice, as the flattest temperature under that limit says.

    The rows come as the permutation of blocks has them: epoch by epoch, source by source, block after block.
    """
    return mixing.mixed_rows(docs, max_repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in bins of 512 to 8192 tokens; a text without words has no bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity is a fitted model and near duplicates need a transitive closure over pairs: no SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again, and deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs

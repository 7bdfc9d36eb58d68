"""A training corpus from raw documents in five stages.

Language identification, near-duplicate removal, removal of repeated passages, mixing of sources, packing. ``STAGES``
names them in this order; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents.

Every stage works on all rows that its predecessor kept. ``ORACLE_SQL`` is None: SQL can express neither the
hypervectors nor the tokenizer, so ``tests/llm`` holds the pipeline against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.language_id import learn_prototypes, tell_language
from fluxloom.llm.mixing import mix_sources
from fluxloom.llm.packing import pack_documents, tokenizer_path
from fluxloom.llm.shingles import drop_similar
from fluxloom.llm.substring import drop_repeated
from fluxloom.runtime import ensure_checkpoint_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` is the label where there is one and the prediction elsewhere."""
    return tell_language(docs, learn_prototypes(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    SimHash links near copies, shared rare shingles the other near duplicates: texts whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more, compared exactly.
    """
    return drop_similar(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document with a smaller id has too."""
    return drop_repeated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder.

    Each stage's rows are written to the shared checkpoint folder and removed once the next stage's are there.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

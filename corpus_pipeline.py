"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns a DataFrame that is written
as Parquet and read again for the next one. All stages but the last return the columns of documents. When a stage begins, the tables
that stages before it needed for their result go, as that result is a table by then; those that its docs read stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, near_dedup, packing, quality_classifier, secret_scan
from tracewright.llm.registry import tokenizer_folder
from tracewright.llm.storage import release, staged, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs)
        with staged():
            return function(spark, docs, sf_dir)

    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table with a number for each row, and the name of its column, which docs has none of."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


@_stage
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others; repeated rows stay or go together; rows without an id are scored too. Without
    usable labels every row gets the same score. An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, labels))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the first row: five-word shingles, similarity 0.8.

    Rows are documents whatever their ids: of repeated rows one stays, different texts with one id are judged apart, and rows without an id
    as well. Texts without words (null, empty, blank) are duplicates of nothing and stay. An empty table gives an empty one.
    """
    rows, row = _numbered(docs)
    groups = near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle=5, percent=80)
    return rows.join(groups.where("NOT kept").select(F.col("doc_id").alias(row)), row, "left_anti").select(docs.columns)


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars of those texts counted anew; every row stays.

    Null and empty texts stay as they are; repeated rows are masked alike. An empty table gives an empty one.
    """
    return secret_scan.redact_secrets(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; one that the mix cuts goes in whole, one that it doesn't reach goes.

    Null is a source of its own. Texts without words have nothing to take and go. Repeated rows are drawn one by one. An empty
    table gives an empty one.
    """
    rows, row = _numbered(docs)
    taken = mixing.mix_sources(rows.select(F.col(row).alias("doc_id"), "source", "text")).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("long")
    return rows.join(taken.select(F.col("doc_id").alias(row), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy")).select(row), row).select(docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 2048 tokens, each row packed as often as it stands there.

    Null and empty texts are the end token alone. An empty table gives no piece.
    """
    return packing.pack_documents(docs, tokenizer_folder())


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trees and token ids are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with staged():
            docs = written(found, name)
    return STAGES[-1][1](spark, docs, sf_dir)

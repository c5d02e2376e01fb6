"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage works on all that the one before it kept. The first three drop documents, the fourth
replaces the secrets that it finds in the text, and the last packs what is left into sequences.

All stages take documents with nulls in any column, very long and empty texts, ties, repeated rows
and further columns of any name, and give an empty result for an empty table; what each makes of them
is said below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate, near_copies, packing, quality, secret_scan
from fathom.llm.common import ready, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches quality.KEEP.

    A null or empty text gets the grade of the model's intercept; every repeated row is judged alike. Whole
    texts are scored whatever their length. All columns are kept.
    """
    ready(spark)
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    own = {c: f"_kept_{c}" for c in docs.columns if c in quality.OUT.names}
    judged = quality.rate(docs.withColumnsRenamed(own), model).where("keep")
    return judged.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id.

    Null and empty texts are copies of each other. Rows with a null id all stay; of repeated rows with one id
    one stays. Whole texts are compared whatever their length. All columns are kept.
    """
    ready(spark)
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of benchmark items.

    Null and empty texts have no words and stay; repeated rows are judged alike, very long texts whole.
    All columns are kept; one named like a column of the finding is read no more and comes back unchanged.
    """
    ready(spark)
    own = {c: f"_kept_{c}" for c in docs.columns if c in decontaminate.OUT.names}
    judged = decontaminate.find_contamination(docs.withColumnsRenamed(own), table(spark, sf_dir, "benchmark"))
    return judged.where("not contaminated").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced, and n_chars, if there, of the new text.

    Null texts stay null, empty ones empty; repeated rows are treated alike, very long texts whole. All
    columns are kept.
    """
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, by sequence and offset.

    A null or empty text is one separator; repeated rows are documents of their own; a very long text is
    spread over many sequences. A null id stays null. No other columns are kept.
    """
    ready(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again, and removed once the next one is written."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs

"""What a session needs before the library's Python code runs on its workers, and how lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to Python at a time where the session still has Spark's own 10,000: whole texts are long.
BATCH_ROWS = "1000"


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where they share the driver's files, bounds the batches
    that they get, and gives lineage cuts a place.

    The folder is the cluster's spark.checkpoint.dir. Only a local session without it (tests, a laptop)
    gets a folder of its own; on a cluster such a folder would be lost with its machine, so a
    cluster session must name one. On a cluster ship the package with --py-files; the path is then harmless.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fathom-checkpoint-"))
    # Checkpoint folders go once nothing refers to their DataFrames any more, unless the session says otherwise.
    if sc.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints") is None:
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """ready(), and the readers of recordings and logs."""
    from fathom.sources import register

    register(ready(spark))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared checkpoint folder: lost executors cost no recomputation."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)

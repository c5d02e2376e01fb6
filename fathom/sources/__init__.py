"""Readers of echo-sounder recordings and vehicle logs."""

from fathom.sources.logs import LogDataSource, fixes_from_files
from fathom.sources.sonar import SonarDataSource, frames_from_files, index_recordings


def register(spark) -> None:
    """Makes spark.read.format("sl3") and format("bin_log") known, and has Spark push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SonarDataSource)
    spark.dataSource.register(LogDataSource)


__all__ = ["LogDataSource", "SonarDataSource", "fixes_from_files", "frames_from_files", "index_recordings", "register"]

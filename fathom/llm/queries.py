"""The corpus queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import centroids, decontaminate, html_text, merkle, packing, pii, quality, secret_scan, sharding, simhash, url_filter, warc, whitening
from fathom.llm.common import ready, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.query(table(ready(spark), sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(ready(spark), sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(table(ready(spark), sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(ready(spark), sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(ready(spark), sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(ready(spark), sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(ready(spark), sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(table(ready(spark), sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.query(table(ready(spark), sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(table(ready(spark), sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(ready(spark), sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_sharding,
        op3_fingerprints,
        op4_pii,
        op5_url_filters,
        op6_packing,
        op7_decontamination,
        op8_simhash,
        op9_quality,
        op10_secrets,
        op11_centroid_clustering,
        op12_whitening,
        op13_warc,
    )
}
ORACLES: dict[str, str] = {"op5_url_filters": url_filter.ORACLE, "op11_centroid_clustering": centroids.ORACLE, "op13_warc": warc.ORACLE}

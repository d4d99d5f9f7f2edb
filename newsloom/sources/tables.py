"""Typed readers for the input tables. No schema inference, one scan per use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one declared table; filters and column choices reach the scan.

    The scan alone decides the splits (``spark.sql.files.maxPartitionBytes``), at every size.
    """
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")

"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "chars_final_with_names", "filings_8k", "filing_scores", "gics_codes", "market_monthly", "mix_targets",
    "pack_limits", "subject_areas", "subject_labels",
)


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns`` only these are in the scan's read schema."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, name) for name in names]

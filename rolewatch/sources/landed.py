"""Readers of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LANDED

_INPUT_TEXT = """
    name STRING, domain STRING, career_url STRING, early_careers_url STRING, events_url STRING,
    priority STRING, role_keywords STRING, event_keywords STRING, scan_cron STRING
"""


def write_landed(rows: DataFrame, path: str) -> None:
    """Add landed rows to a folder with one subfolder per provider."""
    rows.write.mode("append").partitionBy("provider").parquet(path)


def read_landed(spark: SparkSession, path: str, providers: list[str] | None = None) -> DataFrame:
    """Landed payloads and pages (parquet); of a folder with subfolders per provider, only those of ``providers`` are read."""
    rows = spark.read.schema(LANDED).option("mergeSchema", "false").parquet(path)
    rows = rows.select(*[F.col(c) for c in spark.createDataFrame([], LANDED).columns])
    return rows if providers is None else rows.where(F.col("provider").isin(providers))


def read_target_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Companies to import (CSV with header); keyword columns hold comma-separated lists."""
    rows = spark.read.schema(_INPUT_TEXT).option("header", True).option("multiLine", False).csv(path)
    lists = {name: F.split(name, ",") for name in ("role_keywords", "event_keywords")}
    return rows.withColumns(lists)


def read_company_list(spark: SparkSession, path: str) -> DataFrame:
    """Companies a watchlist is synchronised with (CSV with header: name, domain, career_url)."""
    return spark.read.schema("name STRING, domain STRING, career_url STRING").option("header", True).csv(path)

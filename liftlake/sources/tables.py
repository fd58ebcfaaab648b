"""Readers and the named dataset catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV; a malformed row fails the job. Give ids a string schema: inference drops leading zeros."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class DatasetCatalog:
    """Named datasets: key to (format, path), read lazily and registered as views on request."""

    def __init__(self, spark: SparkSession, entries: dict[str, tuple[str, str]] | None = None):
        self.spark = spark
        self.entries = dict(entries or {})

    def add(self, key: str, kind: str, path: str) -> None:
        if kind not in ("csv", "parquet"):
            raise ValueError(f"unknown dataset format '{kind}'")
        self.entries[key] = (kind, path)

    def load(self, key: str) -> DataFrame:
        if key not in self.entries:
            raise KeyError(f"no dataset named '{key}'; known: {', '.join(sorted(self.entries))}")
        kind, path = self.entries[key]
        return read_csv(self.spark, path) if kind == "csv" else read_parquet(self.spark, path)

    def register(self) -> list[str]:
        for key in self.entries:
            self.load(key).createOrReplaceTempView(key)
        return sorted(self.entries)

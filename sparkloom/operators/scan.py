"""Sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import scan_csv
from .base import Operation


class Scan(Operation):
    """Delimited text without a header (columns "0", "1", ...) or Parquet.

    ``types`` are numpy type names by position; without them a column is bigint,
    double, boolean or string by all of its values."""

    is_source = True

    def __init__(self, path: str, types: list[str] | None = None, delimiter: str = ",", format: str | None = None):
        self.path, self.types, self.delimiter = path, types, delimiter
        self.format = format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
        if self.format not in ("csv", "parquet"):
            raise ValueError(f"unknown format {self.format!r}")

    def read(self, spark: SparkSession) -> DataFrame:
        if self.format == "parquet":
            return spark.read.parquet(self.path)
        return scan_csv(spark, self.path, self.types, self.delimiter)

    def explain(self) -> str:
        return f"Scan ({self.path})"

"""Tables landed as files, for the operators that read paths or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logshield.sources.shared import folder


def landed_text(rows: DataFrame, column: str = "line") -> str:
    path = folder(rows.sparkSession)
    rows.select(column).write.text(path)
    return path


def landed_parts(rows: DataFrame, order: str, parts: int) -> str:
    """Parquet files of consecutive ranges of `order`, about `parts` of them."""
    path = folder(rows.sparkSession)
    rows.repartitionByRange(parts, order).write.parquet(path)
    return path

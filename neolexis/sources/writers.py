"""Outputs: tables, sorted CSV exports, samples, parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, out_dir: str, name: str, partition_by: list[str] = ()) -> str:
    path = f"{out_dir.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, order: list = (), limit: int | None = None) -> None:
    """One file with a header, sorted. For exports that people open; with a limit it is a top-n sample."""
    rows = df.orderBy(*order) if order else df
    rows = rows.limit(limit) if limit else rows
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parts(df: DataFrame, path: str, rows_a_file: int = 10_000, limit: int | None = None) -> None:
    (df.limit(limit) if limit else df).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""Inputs: raw posts, clean corpora, word lists, token lists, tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("subreddit", T.StringType()), ("created_utc", T.StringType()), ("body", T.StringType()), ("score", T.IntegerType()))])


def raw_posts(spark: SparkSession, path: str, schema: T.StructType | None = RAW) -> DataFrame:
    """JSON lines, compressed or not. With a schema no pass over the data is spent on inferring it.

    Files named .zst need a zstd codec in Hadoop's native library; where it is missing use zstd_posts.
    """
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def zstd_posts(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """JSON lines in zstd files, with long windows as archives have them; a task a file, streamed batch by batch."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for batch in batches:
            for content in batch.column(0):
                reader = zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(content.as_py(), read_across_frames=True)
                text, held = io.TextIOWrapper(reader, encoding="utf-8", errors="replace", newline="\n"), []
                for line in text:
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string")
    return found.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def table(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir.rstrip('/')}/{name}")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One token a line, compared exactly; empty lines don't count."""
    return spark.read.text(path).select(F.col("value").alias("token")).where("token <> ''").distinct()


def words(spark: SparkSession, tokens: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def token_list(text: str | None = None, path: str | None = None) -> list[str]:
    """From a JSON list, or a file with a JSON list or a token a line; without empties and repeats, in order."""
    if (text is None) == (path is None):
        raise ValueError("give either tokens or a file")
    if path is not None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        found = json.loads(text) if text.lstrip().startswith("[") else text.splitlines()
    else:
        found = json.loads(text)
    if not isinstance(found, list) or not all(isinstance(t, str) for t in found):
        raise ValueError("tokens must be a list of strings")
    found = list(dict.fromkeys(t for t in found if t))
    if not found:
        raise ValueError("no tokens")
    return found


def size_path_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines `size<TAB>path` with their line order."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())
    return rows.select("line", parts[0].alias("size"), parts[1].alias("path"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a pattern stands for, is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank; of a missing file none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path).where(F.trim("value") != "")


def plotting_rows(spark: SparkSession, path: str) -> DataFrame:
    """A plotting export read back; numbers that don't parse are null."""
    rows = spark.read.option("header", True).csv(path)
    text = {"subreddit", "corpus", "token", "time_grain", "period_id", "spike_profile"}
    flags = {c for c in rows.columns if c.startswith(("has_", "is_"))}
    return rows.select(*[F.col(c) if c in text else (F.lower(c) == "true").alias(c) if c in flags else F.col(c).try_cast("double").alias(c) for c in rows.columns])


def shuffled_corpus(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """A random sample of a corpus in random order; it doesn't depend on partitions."""
    return df.orderBy(F.xxhash64(F.to_json(F.struct(*df.columns)), F.lit(seed))).limit(rows)

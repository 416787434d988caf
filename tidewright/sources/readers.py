"""Readers of corpora and matrices, and the writer of result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_corpora(spark: SparkSession, paths: Mapping[str, str], encoding: str = "iso-8859-1") -> DataFrame:
    """(lang, path, text): whole text files per language, decoded from ``encoding``; a path may be a glob."""
    out = None
    for lang, path in paths.items():
        files = spark.read.format("binaryFile").load(path).select(F.lit(lang).alias("lang"), "path", F.decode("content", encoding).alias("text"))
        out = files if out is None else out.unionByName(files)
    if out is None:
        raise ValueError("no paths")
    return out


def load_matrix(spark: SparkSession, path: str, sep: str = r"\s+", decimal_columns: bool = True) -> DataFrame:
    """(line, col, value): numbers of blank- or comma-separated text files; ``line`` counts within a file from 0.

    The line number is the order of the text in one file split; give one matrix per file.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("v")).where("v <> ''")
    cells = lines.select("line", F.posexplode(F.split("v", sep)).alias("col", "value"))
    return cells.withColumn("value", F.expr("try_cast(value AS double)")) if decimal_columns else cells


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Save a result table (parquet, csv or json)."""
    df.write.format(fmt).mode(mode).option("header", "true").save(path)

"""Sinks and file sources: label tables, reports, manifests, refusal to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, unique: list[str] | None = None) -> DataFrame:
    """A CSV with a header under a given schema; with unique, repeated keys raise an error when read."""
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    if unique:
        from pyspark.sql import Window

        n = F.count(F.lit(1)).over(Window.partitionBy(*unique))
        df = df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws("/", *unique)))).otherwise(F.lit(True))).drop("__n")
    return df


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with the file's name."""
    return spark.read.json(path, schema=schema, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A Parquet table at a path where there is none yet."""
    (df.write.partitionBy(*by) if by else df.write).mode("errorifexists").parquet(path)


def json_report(df: DataFrame) -> DataFrame:
    """One JSON line a row, keys sorted, NaN and infinite numbers as null."""
    clean = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))

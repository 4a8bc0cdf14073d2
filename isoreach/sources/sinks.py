"""Writers: tables with a manifest, skipped where the same inputs have been written before."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, paths: list[str], options: Mapping[str, object]) -> str:
    """A hash of the options and of each input's name, length and time of change."""
    seen = []
    for path in sorted(paths):
        fs, at = _fs(spark, path)
        summary, status = fs.getContentSummary(at), fs.getFileStatus(at)
        seen.append([path, summary.getLength(), status.getModificationTime()])
    return hashlib.sha256(json.dumps([seen, dict(options)], sort_keys=True, default=str).encode()).hexdigest()


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, f"{path.rstrip('/')}.manifest")
    if not fs.exists(at):
        return None
    # the manifest is one short row
    return json.loads(spark.read.text(at.toString(), wholetext=True).first()[0])


def write_table(df: DataFrame, path: str, mark: str = "", partition_by: tuple[str, ...] = ()) -> dict:
    """df as Parquet, its schema kept where it is empty, then a manifest beside it: schema, rows, fingerprint.

    By zstd, which takes the lists of places side by side for what they are, nearly equal; snappy looks back 64 KB only.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    made = {"fingerprint": mark, "rows": spark.read.parquet(path).count(), "schema": json.loads(df.schema.json())}
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.manifest")
    return made


def resumed(spark: SparkSession, path: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if its manifest has this fingerprint, else built and written."""
    made = read_manifest(spark, path)
    if not made or made["fingerprint"] != mark:
        write_table(build(), path, mark)
    return spark.read.parquet(path)

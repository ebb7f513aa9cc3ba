"""Masking of a stream of lines: each line by itself, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactrix.operators import masks


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).select(F.col("value").alias("core"), F.input_file_name().alias("file"))


def mask_stream(lines: DataFrame) -> DataFrame:
    """(core, …) with global masks, policies and birth years; works on streams and tables alike."""
    return lines.withColumn("core", masks.birth_years(masks.mask_enp(masks.global_masks(F.col("core")))))

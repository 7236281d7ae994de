"""Text sources: whole files and tables of documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import text as T


def files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, content`` of UTF-8 files read whole, a file or a folder. A missing path
    raises FileNotFoundError; something else than a file or folder ValueError."""
    local = path.removeprefix("file://")
    if "://" not in local:
        if not os.path.exists(local):
            raise FileNotFoundError(local)
        if not (os.path.isfile(local) or os.path.isdir(local)):
            raise ValueError(f"{local} is not a file")
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def accepted(documents: DataFrame, max_length: int = 500_000, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents of usable length, and the others with the reason. With ``fail_fast`` a reject raises."""
    n = F.length("content")
    reason = F.when(F.col("content").isNull() | (n == 0), "empty").when(n > max_length, "too long")
    judged = documents.withColumn("reason", reason)
    if fail_fast and not judged.where("reason is not null").isEmpty():
        raise ValueError("a document is empty or exceeds maximum allowed length")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def guarded(texts: DataFrame, column: str = "text", max_length: int = 500_000, max_word: int = 1000) -> DataFrame:
    """``texts`` with ``problem``: why a text must not go to a summarizer, or null."""
    return texts.withColumn("problem", T.guard(F.col(column), max_length, max_word))

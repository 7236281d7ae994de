"""New documents as they arrive: every micro-batch goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sylvan.operators import chunking

SCHEMA = "doc_id long, content string"


def read(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files of documents that appear in ``folder``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def write_chunks(documents: DataFrame, folder: str, checkpoint: str, max_tokens: int = 500) -> StreamingQuery:
    """Chunks of every new document, each batch in a folder of its own, so a batch that is repeated
    after a failure replaces what it had written."""

    def batch(rows: DataFrame, number: int) -> None:
        chunks = chunking.token_chunks(rows.dropDuplicates(["doc_id"]), max_tokens)
        chunks.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

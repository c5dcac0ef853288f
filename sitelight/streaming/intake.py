"""Documents that keep arriving: chunk and encode each new file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelight.operators.retrieval import chunk_table, document_status, encode
from sitelight.sources.document_files import from_binary

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New text files below ``folder`` as documents."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("recursiveFileLookup", True).load(folder)
    )
    return from_binary(files)


def start_intake(
    documents: DataFrame, store: str, checkpoint: str,
    encoder: Callable[[Column], Column] | None = None, dims: int = 384, once: bool = True,
) -> StreamingQuery:
    """Chunk, encode and append every new document.

    Each micro-batch overwrites its own ``batch`` partition, so a batch that is
    repeated after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = {
            "documents": document_status(batch),
            "chunks": encode(chunk_table(batch), "chunk_text", encoder, dims),
        }
        for name, table in tables.items():
            (
                table.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/{name}")
            )

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

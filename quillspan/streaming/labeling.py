"""The labelling transform on streams.

Matching and de-duplication of a document need that document alone, so each micro-batch runs the batch plan;
what is written equals the batch result. Files are read at a set rate and written as JSON lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspan.operators import matching


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_batch).json(path)


def label_stream(docs: DataFrame, symptoms: DataFrame, products: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Label what is there and what arrives while it runs; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        spans = matching.weak_label(batch, symptoms, products)
        matching.nested(batch, spans).write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

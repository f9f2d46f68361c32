"""Continuous ingestion of a folder of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrain.operators.classify import Classifier
from lexigrain.operators.embed import Embedder
from lexigrain.operators.store import ChunkStore
from lexigrain.plans.ingest import ingest_documents
from lexigrain.schema import Source


def stream_folder(store: ChunkStore, source: Source, folder: str, checkpoint: str, classifier: Classifier | None = None, embedder: Embedder | None = None, document_type: str = "core_rules", once: bool = False) -> StreamingQuery:
    """Ingest every new file of a folder, its path being the document id; a batch that runs again inserts nothing twice."""
    files = store.spark.readStream.format("text").option("wholetext", True).load(folder)
    docs = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"))

    def batch(df: DataFrame, _: int) -> None:
        ingest_documents(store, source, df, classifier, embedder, document_type)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

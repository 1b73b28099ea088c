"""Chunks of documents that arrive in a stream. An extension: the batch operators hold for each micro-batch as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evidentia.functions import fixed_values as V
from evidentia.operators import chunking, retrieval


def stream_chunks(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """A streaming DataFrame of chunks: chunking needs no state."""
    return chunking.split_documents(docs, size, overlap)


def append_postings(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks and postings of each micro-batch below `out`, in a folder named by the batch, so a rerun replaces its own."""

    def batch(df: DataFrame, epoch: int) -> None:
        chunks = chunking.split_documents(df).persist()
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={epoch}")
        retrieval.term_table(chunks).write.mode("overwrite").parquet(f"{out}/postings/batch={epoch}")
        chunks.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

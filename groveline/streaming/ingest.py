"""Documents that arrive as a stream become encoded chunks, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from groveline.operators import text as T
from groveline.operators.encode import encode


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, size: int = 60, overlap: int = 15, **trigger) -> StreamingQuery:
    """Chunk and encode every micro-batch of ``docs`` (doc_id, text) and write it under ``out``, in a folder a batch.

    Chunking looks at one document only, so no state is kept between batches. A batch that runs again after a
    failure replaces its own folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        made = encode(T.chunks(batch.select("doc_id", "text"), size, overlap))
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

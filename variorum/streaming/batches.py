"""Pages that arrive as files, built in micro-batches. The batch stages run unchanged in ``foreachBatch``; a page is the
unit of work, so no state crosses a batch. Each batch is written to its own folder, so one that runs twice after a failure
replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from variorum.kernels.registry import Registry
from variorum.operators.apparatus import entries


def build(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, registry: Registry | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Entries of all page files that are there; the query ends when they are done."""

    def run(pages: DataFrame, number: int) -> None:
        entries(pages, registry).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

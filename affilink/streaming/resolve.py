"""Resolution of a stream of queries against static index tables, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from affilink.operators import cascade, decisions


def resolve_stream(queries: DataFrame, own: cascade.Corpus, path: str, checkpoint: str, size: int = cascade.POOL_SIZE) -> StreamingQuery:
    """Writes the scored parents of streamed queries (query_id, text) under path, a folder for each batch.

    A batch that is repeated overwrites its own folder, so each query's rows appear once. Equal queries of a batch (by their normal
    form) are resolved once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        todo, keys = decisions.to_run(rows)
        found = cascade.resolve(todo, own, size).parents.withColumnRenamed("query_id", "key")
        keys.join(found, "key").drop("key").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

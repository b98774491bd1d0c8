"""What the operators of this subpackage share: input tables, shared folders, worker-side caches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast, of some 24 bytes each.
FEW_ROWS = 1 << 18

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark is local (tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is unset, and {master} shares no local folder")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="affilink-")
    return _own_dirs[app]


def written(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of written() that no later plan reads."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def partitions_for(docs: DataFrame, bytes_each: int) -> int:
    """The session's shuffle partitions, or more where they would hold over bytes_each of the files read, as Spark estimates them."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = 0  # what Spark says where it doesn't know
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // bytes_each)))


def broadcast_if_few(rows: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """rows of a few numbers each, marked for a broadcast if they are counted to be at most so many; else left to a shuffled join."""
    return F.broadcast(rows) if rows.count() <= most else rows


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def vocabulary_path(name: str) -> str:
    """A vocabulary file by its name among the public tokenizers, or any path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)

"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder in the warehouse only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder, read again: cuts lineage and survives lost executors.

    The files go when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_apart(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns (name there -> name here); a column that is absent is null.

    Extra columns, whatever their names, never reach an operator's own columns.
    """
    from pyspark.sql import functions as F

    by_name = {c.lower(): c for c in df.columns}
    out = []
    for source, (target, kind) in {k: v if isinstance(v, tuple) else (v, None) for k, v in wanted.items()}.items():
        c = F.col(f"`{by_name[source.lower()]}`") if source.lower() in by_name else F.lit(None)
        out.append((c.cast(kind) if kind else c).alias(target))
    return df.select(*out)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; when a task ends, what it has freed goes back to the system, as workers are kept for later tasks."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return held

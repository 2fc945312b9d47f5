"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session has none (tests) is a temporary folder made and set; on a cluster that is an error,
    since executors don't see each other's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and survives the loss of executors, since the files are not theirs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def appended(written: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of ``more`` written beside those of a table of ``materialise``: the table of both."""
    more.write.mode("append").option("compression", "zstd").parquet(written._written_to)
    whole = written.sparkSession.read.schema(written.schema).parquet(written._written_to)
    whole._written_to = written._written_to
    return whole


def release(*written: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing will read any more.

    The shuffle files behind them go when the driver next collects its garbage, which it is asked to do.
    """
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if written:
        sweep(written[0])


def sweep(df: DataFrame) -> None:
    """Have the shuffle files go that nothing reads any more: after a large step their disk is wanted for the next."""
    df.sparkSession._jvm.System.gc()


def hand_back() -> None:
    """Give the system the memory that this process has freed and still holds: Arrow's pool, then the C library's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker hands memory back after each partition: idle workers stay beside the JVM of their executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return whole


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(column, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Lists of up to so many ids (16 bytes at most each) are broadcast; longer ones are shuffled.
BROADCAST_IDS = 500_000
#: Tables of two longs are broadcast up to so many rows: 32 MB, some 100 MB as a hash table.
BROADCAST_KEYS = 2_000_000
#: Tables of rows of some 250 bytes are broadcast up to so many rows.
BROADCAST_WIDE = 100_000


def only(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among ``ids``, written before so that counting them is cheap."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")

"""What several of the corpus operators share: tables, lineage cuts and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join with texts is broadcast up to so many bytes, as measured; beyond that the join is a shuffle.
BROADCAST_BYTES = 32 << 20
#: Word separators of the corpus operators: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset on one machine (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="pulseloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint: later actions read its files, whichever executors were lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/pulseloom/{name}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(name: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(names: list[str]) -> Column:
    """The named columns as one, under names of our own, so that none of theirs meets one of ours."""
    return F.struct(*(named(c).alias(f"c{i}") for i, c in enumerate(names)), F.lit(0).alias("none")).alias("row")


def unfolded(names: list[str]) -> list[Column]:
    """The columns that carried() took, under their own names."""
    return [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(names)]


#: What Python workers are started with: one heap, which gives large blocks back at once, for Arrow as well.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_MMAP_THRESHOLD_": "131072"}


def small_batches(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """Rows are texts here: fewer of them in an Arrow batch keep both sides of a Python worker's pipe small.

    The setting holds for the whole session, as Spark reads it when a plan runs; results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    return spark


def lean_workers(spark: SparkSession) -> SparkSession:
    """small_batches(), and Python workers with the settings of WORKER: they serve one stage after another and would add up.

    It costs time where much is allocated, so only what is short of memory asks for it. It holds for workers started from
    now on.
    """
    for k, v in WORKER.items():
        spark.sparkContext.environment.setdefault(k, v)
    return small_batches(spark)


_kept: list = [None, None]


def keep_only(owner: str, forget: Callable[[], object] | None = None) -> None:
    """A Python worker serves one operator after another; only the one at work keeps what it has cached."""
    if _kept[0] not in (None, owner):
        if _kept[1]:
            _kept[1]()
        give_back()
    _kept[:] = owner, forget


def give_back() -> None:
    """Return memory that is free to the system: workers live on and would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own counsel
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def pieces(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """batch, in halves where it holds more than so many bytes: Python's own objects take ten times that."""
    if batch.nbytes <= most or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)


def list_of(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column with one entry for each array of parts."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))

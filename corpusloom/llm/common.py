"""What the operators share: folders that all executors see, cut lineage, fold of a row."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id as text) mod 4 that marks the held-out fold.
HELD_OUT_REMAINDER = 2

#: Paths made inside the with-blocks of cleaned() that are open, the innermost last.
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary one is made for a session on one machine; on a cluster executors would not see it,
    so that is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it again, so that a lost executor costs no recomputation before it."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for tables that nothing reads any more."""
    for df in tables:
        if path := vars(df).get("_written_at"):
            remove(df.sparkSession, path)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what scratch() and materialise() made inside; results have to be written elsewhere by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system interface; one that is not there is left so."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with underscores after it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def held_out(doc_id: Column) -> Column:
    """True for rows of the held-out fold; a null id is in no fold, so false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def give_back() -> None:
    """Return freed memory to the system, where the C library can: drivers and Python workers live long after what they held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass

"""What the operators share: reading tables, materialising in the shared folder, words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the six ASCII control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of our own, but only in a session of one machine:
    on a cluster each executor would write to its own disk."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """Texts go to Python in Arrow batches of at most BATCH_BYTES: both sides of the pipe hold one or two per task. Sets
    spark.sql.execution.arrow.maxBytesPerBatch for the session, unless it has been set to less."""
    conf = df.sparkSession.conf
    now = (conf.get(BATCH_CONF) or "").removesuffix("b")
    if not now.isdigit() or int(now) <= 0 or int(now) > BATCH_BYTES:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


CACHES: list[Callable[[], None]] = []  # each forgets what tasks of this process remember for later ones


def lean() -> None:
    """For the start of a task that needs its memory: Python workers are reused, so what tasks of other stages remember or
    have freed in this one is given back."""
    for forget in CACHES:
        forget()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_open: list[list[str]] = []


def written(path: str) -> None:
    """Notes a table or file that `scratch` takes."""
    for paths in _open:
        paths.append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever operators write to the shared folder inside is deleted at the end; results have to be written before."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            delete(spark, path)


@dataclass
class Stash:
    """Tables written to the shared folder, which cut lineage and outlive any executor."""

    spark: SparkSession
    label: str
    paths: list[str] = field(default_factory=list)
    lasting: bool = False  # not taken by scratch

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{self.label}-{uuid.uuid4().hex}"
        if not self.lasting:
            written(path)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_older(self, keep: int = 1) -> None:
        """Deletes all but the newest tables: those that no later step reads."""
        for path in self.paths[:-keep] if keep else self.paths:
            delete(self.spark, path)
        self.paths = self.paths[-keep:] if keep else []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(key: Column) -> Column:
    """crc32 of the key's text, modulo 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5

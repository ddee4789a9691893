"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Removes the shuffle files of a query when it ends; the plan alone knows them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as a zip that Spark itself distributes."""
    sc = spark.sparkContext
    # texts can be long: batches to Python are kept small, unless the session says how large they are
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "2000")
    if getattr(sc, "_trackloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(), "trackloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    sc._trackloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is set and Spark runs in this one process, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="trackloom-checkpoint-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Plans made in this block lose their shuffle files as soon as they end: else these stay on the executors' disks until the
    driver's garbage collector happens to run. A DataFrame made before the block keeps its own when it is collected: see gathered().
    What a retried stage still needs is made again. A query that ends early, as one side of a join is found empty, may leave the job of
    another side behind: that one would wait for files that are gone, and is ended with the block."""
    before, sc, tag = spark.conf.get(CLEANUP, None), spark.sparkContext, f"trackloom-{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    sc.addJobTag(tag)
    try:
        yield
    finally:
        sc.removeJobTag(tag)
        sc.cancelJobsWithTag(tag)
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def gathered(df: DataFrame) -> list[Row]:
    """df's rows, for what is small enough for the driver; its shuffle files go at once."""
    with shuffles_removed(df.sparkSession):
        return df.select("*").collect()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


_MADE: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what several branches read: it is computed once and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/trackloom-table-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    for paths in _MADE:
        paths.append(path)
    out = df.sparkSession.read.parquet(path)
    out._trackloom_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing will read it again."""
    delete(df.sparkSession, df._trackloom_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes in this block are deleted at its end; what is kept must be written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            delete(spark, path)


class Recent(dict):
    """A dictionary of at most about `most` bytes, at `each` bytes an entry: when its younger half is full it takes the place of the older one, which is forgotten.

    Keys of more than 64 letters aren't remembered.
    """

    def __init__(self, make: Callable | None = None, most: int = 48 << 20, each: int = 200):
        super().__init__()
        self.make, self.room, self.older = make, most // each // 2, {}

    def put(self, key, value) -> None:
        if len(key) > 64:
            return
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def of(self, keys: set, make_all: Callable[[list], list]) -> dict:
        """A dictionary of these keys; what isn't remembered is made together."""
        out, new = {}, []
        for k in keys:
            value = self.get(k)
            if value is None:
                value = self.older.get(k)
                if value is None:
                    new.append(k)
                    continue
                self.put(k, value)
            out[k] = value
        for k, value in zip(new, make_all(new)):
            self.put(k, value)
            out[k] = value
        return out


_HELD: dict = {}


def held(key, make: Callable):
    """The one thing that a worker process keeps between batches and tasks; asking for another one forgets it."""
    if _HELD.get("key") != key:
        _HELD.clear()
        gc.collect()
        _HELD.update(value=make(), key=key)
    return _HELD["value"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch; fn returns the columns of the output by name, in the order of schema."""
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    # the schema string is parsed on the driver; workers get the Arrow one
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                cols = fn(part)
                yield pa.RecordBatch.from_arrays([cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give back what the allocators hold free; a worker process outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each part holds about `most` bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most / max(1, batch.nbytes)))
    for k in range(0, n, step):
        yield batch.slice(k, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(batch.schema.names.index(name)).to_pylist()]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))

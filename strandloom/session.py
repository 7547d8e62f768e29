"""Session helpers: shared scratch storage, shipping the package to the workers, reading tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

BATCH_CONF, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_shipped: dict[str, str] = {}
#: What the innermost `scratch` block of this thread deletes; a thread that was started elsewhere has none.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def get_session(name: str = "strandloom") -> SparkSession:
    """The session of the command line: master, memory and partitions are those it was submitted with."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local master may do without one: it gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{scratch_root(spark)}/strandloom/{name}-{uuid.uuid4().hex}"


def discard_later(path: str) -> None:
    """The surrounding `scratch` block, if there is one, deletes path when it ends."""
    if _written.get() is not None:
        _written.get().append(path)


def materialise(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor never reruns what lies before it. A surrounding `scratch` deletes it unless keep."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if not keep:
        discard_later(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables materialised in the block, by the same thread, when it ends, so results must be written, collected or kept inside it."""
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get():
            delete(spark, path)
        _written.reset(token)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialise(make()), after which what make() materialised on its way is deleted, and what it shuffled, as soon as the driver's garbage is collected."""
    path = new_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    discard_later(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Shuffles that nothing refers to any more are deleted as the driver collects its garbage, which by itself may be much later."""
    gc.collect()
    spark._jvm.System.gc()


def few_partitions(df: DataFrame) -> bool:
    """Is df read in fewer tasks than there are cores?"""
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of BATCH bytes instead of 64 MB, of which an executor holds several at a time. A size set by the user stays."""
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, BATCH)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="strandloom-"), "strandloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.join("strandloom", os.path.relpath(p, here)))
    spark.sparkContext.addPyFile(out)
    _shipped[app] = out

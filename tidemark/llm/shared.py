"""Helpers that several corpus operators use."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast up to so many rows of a few numbers each, lists counted by their elements; beyond that the
#: join is by shuffle.
BROADCAST_ROWS = 500_000

#: Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares.  Where the session names none: one of our own if all run on this machine,
    as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
        found = _OWN[0]
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: The tables of the scope that this thread is in.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes within go at the end.  What is to stay must have been written elsewhere by then."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            remove(spark, path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within, the session has this setting.  What is lazy must be cut within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within, Python workers get rows by BATCH_BYTES, not by ten thousand however long they are: of long texts the JVM
    and the worker would hold tens of megabytes each.  What is lazy must be cut within."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df from a table in the shared folder that it was written to, and where that is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, so that nothing before it runs twice
    and a lost executor costs one table's read.  The table stays until the end of the scope, if there is one."""
    out, path = written(df)
    paths = _SCOPE.get()
    if paths is not None:
        paths.append(path)
    return out


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS, elements: Column | None = None) -> bool:
    """Whether df has at most limit rows, where it stops counting just beyond; with elements, of lists and the like,
    whether those sum up to limit at most."""
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):  # one plan and job, not a new one for each stage
        if elements is not None:
            return (df.agg(F.sum(elements)).first()[0] or 0) <= limit
        return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS, elements: Column | None = None) -> DataFrame:
    """df, marked for broadcast if it is bounded; else unchanged, for a join by shuffle."""
    return F.broadcast(df) if bounded(df, limit, elements) else df


def row_hash(*columns: str) -> Column:
    """A hash that tells rows of one id apart, nulls too."""
    return F.xxhash64(*columns, *(F.isnull(c) for c in columns))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def salt_of(column: str | Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")

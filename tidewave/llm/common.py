"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators call white space: space, tab, newline, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]"
#: Folders that ``cut`` and ``stored`` have written in this process, oldest first.
_written: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would read it by (a bare path is the cluster's default store, not always local)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local run gets a folder of its own; a cluster gets an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidewave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return qualified(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder now and go on from the files, so that nothing is computed twice and a lost executor costs a re-read."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _written.append(file.get())
    return out


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as Parquet: for wide rows that are read again a few columns at a time, and for joins upon joins.

    A checkpoint hands on the planner's estimate of its size, and a join's estimate is the product of its sides', so after
    a few joins and rounds the estimate alone has millions of digits and fills the driver. Files are of a known size.
    Use ``cut`` where row numbers are given to what was written: a checkpoint's partitions are the same at every read.
    """
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _written.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``cut`` and ``stored`` write inside is deleted at its end. For one driver thread, and for results that are written inside too."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            remove(spark, _written.pop())


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` (null-safe), through a struct of them.

    Neither side arrives partitioned by that struct, so both get a shuffle of their own, and that is what lets adaptive
    execution split a hot key over many tasks (it can't when one side is the direct output of an aggregate).
    The key columns of ``right`` are dropped.
    """
    left, right = (d.withColumn("__k", F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))) for d in (left, right))
    return left.join(right.drop(*keys), "__k", how).drop("__k")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is computed once per row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))

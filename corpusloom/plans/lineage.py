"""Durable cuts of lineage in the folder that driver and executors share, and dealing of small tables over all cores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster, whose machines share no such folder, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, kind: str = "cut") -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps depend on files every executor can see."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [f.getPath().toString() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or ()]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that was not there; an error if it was, so of two writers one fails. Written aside and renamed, so that no one reads a part of it."""
    hp = spark._jvm.org.apache.hadoop.fs.Path
    fs = hp(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = hp(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(hp(path)) or not fs.rename(aside, hp(path)):
        fs.delete(aside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = hp.getFileSystem(spark._jsc.hadoopConfiguration()).open(hp)
    try:
        return bytes(at.readAllBytes()).decode()
    finally:
        at.close()


def bounded(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint for a table that is known to have ``rows`` rows, if that is at most ``most``."""
    return F.broadcast(df) if rows <= most else df


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside; afterwards it is what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*cuts: DataFrame) -> None:
    """Delete the files of cuts that no later step reads."""
    for c in cuts:
        delete(c.sparkSession, c.cut_path)


def clear(spark: SparkSession) -> None:
    """Delete all cuts of this application; results that are not written yet can't be read after it."""
    delete(spark, shared_dir(spark))


def spread(df: DataFrame) -> DataFrame:
    """A table ``df`` of fewer files than cores and of few bytes, dealt evenly over the cores: one file with one row group is one task's work otherwise.

    Larger tables, and what is not read from files, stay as they are.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    total = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if total < cores * (128 << 20) else df

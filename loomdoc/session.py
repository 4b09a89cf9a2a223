"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomdoc")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set, a temporary folder in local mode; a cluster must name one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomdoc-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; Spark removes the files with the last reference."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a compressed table in the shared folder, for the time of the block. What leaves the block must be cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        removed(spark, path)


def files_key(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> str:
    """A name that changes with the files of these tables: their paths, sizes and times."""
    found = []
    for name in names:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
        while listed.hasNext():
            f = listed.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:24]


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def kept(df: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """The table ``name`` of the shared folder, written from ``df()`` if it isn't whole there yet: what ingest stores once and queries read. A table without its success mark is written over."""
    path = f"{shared_folder(spark)}/kept/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not be a broadcast: Spark takes rows made by generators and UDFs for much smaller than they are, and the driver would hold them."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows out if there are fewer splits than cores, as with one small file; larger inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

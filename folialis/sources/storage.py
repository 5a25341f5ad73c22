"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage at the price of one write, where ``checkpoint()`` would compute its input
twice, and it survives the loss of any executor. It also has a known size, so the planner may choose
a broadcast join by the real number of bytes and not by a guess.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests), a temporary folder becomes it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # one folder for each application on this machine
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="folialis-")
        folder = _own[app]
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df as a table written once in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folialis/{uuid.uuid4().hex}-{name}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that is far dearer than moving its rows.

    A small file is one task however long its rows take; inputs with more parts than cores stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; call it when their readers are done."""
    for s, path in [x for x in _made if x[0] is spark]:
        _made.remove((s, path))
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    import shutil

    for path in [*(p for _, p in _made), *_own.values()]:
        u = urlparse(path)
        if u.scheme in ("", "file") and os.path.isdir(u.path):
            shutil.rmtree(u.path, ignore_errors=True)

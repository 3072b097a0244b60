"""Shared scratch space: where lineage is cut.

Everything written here must be readable by the driver and by every executor, so the place is the
session's ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine (a local master, as
in tests) is a temporary folder made; on a cluster it must be set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one if a local session names none."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with the schema it had; ``options`` are the writer's.

    Unlike a cache or a local checkpoint it survives the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/webloom-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing will read it any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if folder.rpartition("/")[2].startswith("webloom-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

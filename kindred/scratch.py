"""Tables written in between, in the folder that all of a cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Folders that this program has made and marked for deletion.
_ROOTS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a temporary folder that ends
    with the program, if all of Spark runs in one process, as in tests; else an error, as executors share no local folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _temporary()


@cache
def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="kindred-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to, in a folder of this program's own that the JVM deletes when it ends."""
    root = f"{shared_folder(spark)}/kindred-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Cuts the lineage, survives lost executors, and
    forgets the partitioning, so that a later join shuffles both sides and adaptive execution can split hot keys."""
    path = fresh(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialize`` returned, once no later plan reads it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)

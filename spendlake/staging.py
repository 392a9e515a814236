"""Written intermediate tables in the cluster's shared checkpoint folder.

A stage that is read more than once (parsed messages, each dedup round) is
written as Parquet and read back: lineage is cut, a lost executor costs one
re-read, and later steps read only the columns they need.
"""

import functools
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spendlake-stage-")


def stage_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/spendlake/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """For files that tasks write themselves: the file system of a ``qualified`` folder, and its path there."""
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" not in folder:
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark gives it: one without is on the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

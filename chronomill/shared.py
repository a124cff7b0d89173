"""The folder that driver and executors share, for what is written on the way to a result."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_known: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which goes when the application ends.

    Where that setting is unset, a folder of this machine if all runs on it, else an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="chronomill-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/chronomill-{spark.conf.get('spark.app.id')}"
    if own not in _known:
        _known.add(own)
        fs, path = file_system(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def file_system(spark: SparkSession, where: str) -> tuple:
    """The Hadoop file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_text(spark: SparkSession, where: str) -> str:
    """A small file, hidden ones too."""
    fs, path = file_system(spark, where)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def release(spark: SparkSession) -> None:
    """Removes all that this application has written to its folder; results that aren't read yet are lost."""
    fs, path = file_system(spark, shared_dir(spark))
    fs.delete(path, True)
    fs.mkdirs(path)

"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of ``keep`` that nothing has deleted yet.
_stored: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, not there yet, in the session's checkpoint folder (``spark.checkpoint.dir``).

    Only a local session that names none gets a temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def keep(spark: SparkSession, name: str) -> str:
    """A new folder that ``clear_stored`` deletes."""
    path = new_folder(spark, name)
    _stored.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back; ``clear_stored`` deletes what this has written."""
    path = keep(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Deletes the tables of ``stored``, once what was made from them has been saved."""
    sc = spark.sparkContext
    while _stored:
        path = sc._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

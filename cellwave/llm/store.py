"""Intermediate tables, in the folder that all executors share."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from cellwave.sources.shared import new_folder


#: Folders that ``cut`` has written and nothing has dropped yet, and which of them a table is read from.
_written: list[str] = []
_folder: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Later steps then read the table, whatever executors have been lost, and a
    table that several steps use is computed once. It stays until ``drop`` or
    ``clear``, as results that have not been computed yet may need it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folder[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that no later step reads."""
    for table in tables:
        delete(table.sparkSession, _folder.pop(table))


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that ``cut`` has written in this session, once what was made from them has been saved."""
    for path in list(_written):
        delete(spark, path)

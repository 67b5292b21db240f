"""Tables that several queries read and one makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ondine.staging import shared_dir, staged

_tables: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, d: str, name: str, made: Callable[[], DataFrame], source: str = "lineitem") -> DataFrame:
    """What ``made`` gives, written once a session as Parquet into the shared folder and read from there.

    It is made anew when a file of the source table of folder ``d`` has changed, or the kept one is gone; its files go with the driver.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{d}/{source}.parquet")
    files = where.getFileSystem(conf).listFiles(where, True)
    state = []
    while files.hasNext():
        one = files.next()
        state.append((one.getPath().toString(), one.getModificationTime(), one.getLen()))
    key = (spark.sparkContext.applicationId, shared_dir(spark), d, name, *sorted(state))
    table = _tables.get(key)
    if table is not None:
        place = jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
        if place is None or not place.getFileSystem(conf).exists(place):
            table = None
    if table is None:
        table = _tables[key] = staged(made(), name)
    return table

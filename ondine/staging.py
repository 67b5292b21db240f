"""Tables that are written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of the warehouse where the session names none, which a cluster's executors must share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_ondine"
        if found.partition(":")[0] in ("file", found) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is not set, and executors can't see {found}")
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # at exit the session may be gone
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back, which cuts the lineage; the files go when ``released``, or with the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ondine-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _places[table] = path
    return table


def released(*tables: DataFrame) -> None:
    for table in tables:
        if path := _places.pop(table, None):
            remove(table.sparkSession, path)

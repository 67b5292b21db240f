"""What several operators of this folder share: staged tables, prefix sums, safe column names."""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with at least one in so many of all rows is hot; there are at most so many of them.
HOT_KEYS = 256

_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none (tests on one machine), a folder of the warehouse is set, which they share too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_ondine"
        if found.partition(":")[0] in ("file", found) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is not set, and executors can't see {found}")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is a checkpoint's and may stay
        pass


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage: what follows reads files that outlive any executor, and values that
    depend on a task (partition numbers) stay as they were written. The files go when ``released``, or with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ondine-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _places[table] = path
    return table


def released(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for table in tables:
        if path := _places.pop(table, None):
            _remove(table.sparkSession, path)


def joined_by_count(rows: DataFrame, answers: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``answers`` on ``key``; answers has a row for each key, and in ``count`` how many of the ``total`` rows hold it.

    Keys of 1 / HOT_KEYS of all rows or more, of which there are at most HOT_KEYS, are broadcast, so that no task gets a hot key's
    rows; the others are joined by a shuffle.
    """
    hot = F.broadcast(answers.where(F.col(count) * HOT_KEYS >= total))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(answers, key))


def spread(spark: SparkSession) -> int:
    """Partitions to deal rows into: as many as the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str], within: str | None = None, label: str = "sums") -> DataFrame:
    """Adds, for each ``out: value`` of ``sums``, the sum of ``value`` over the rows up to and with this one.

    Rows are ranged by ``order`` (with ``within``, each of its values counts by itself and
    must come first in ``order``). The ranges are staged, each is summed by itself, and a table with a row
    for each range (and value of ``within``) carries the sums before it, so no
    task holds more than a range, however many rows one value has.
    """
    keys = [within] if within else []
    ranged = df.repartitionByRange(spread(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = staged(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), label)
    whole = rows.groupBy("__part", *keys).agg(*[F.sum(v).alias(f"__whole_{o}") for o, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("__part", *keys, *[F.coalesce(F.sum(f"__whole_{o}").over(before), F.lit(0)).alias(f"__before_{o}") for o in sums])
    inside = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__inside_{o}": F.sum(v).over(inside) for o, v in sums.items()})
    whole = whole.withColumnsRenamed({"__part": "__p"} | ({within: "__w"} if within else {}))
    on = F.col("__part") == F.col("__p")
    if within:
        on = on & F.col(within).eqNullSafe(F.col("__w"))
    rows = rows.join(whole, on, "left")
    return rows.select(*df.columns, *[(F.col(f"__before_{o}") + F.col(f"__inside_{o}")).alias(o) for o in sums])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")

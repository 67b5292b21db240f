"""Signals as views of the benchmark tables: which rows are a track, and in which order its samples stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sampling rate that the views of lineitem stand for.
RATE = 1000

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order keys of a stretch in which a long track's samples are numbered by themselves.
STRETCH = 1 << 14


def signals_of(spark: SparkSession, sf_dir: str, track: Column, long: bool = False) -> DataFrame:
    """Samples numbered in ORDER. A long track is numbered stretch by stretch of its first order key, so that no task sorts a
    whole track, and a row for each stretch carries the number of samples before it."""
    rows = table(spark, sf_dir, "lineitem").select(track.alias("track"), *ORDER)
    n = F.row_number().over(Window.partitionBy("track").orderBy(*ORDER)).cast("bigint") - 1
    if long:
        stretch = F.floor(F.col("l_orderkey") / STRETCH)
        before = Window.partitionBy("track").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy("track", stretch.alias("stretch")).agg(F.count("*").alias("size"))
        counts = counts.select("track", "stretch", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
        rows = rows.withColumn("stretch", stretch).join(counts, ["track", "stretch"])
        n = F.col("before") + F.row_number().over(Window.partitionBy("track", "stretch").orderBy(*ORDER)) - 1
    left, right = (F.col("l_quantity") - 25.5) / 24.5, F.col("l_discount") * 20 - 1
    return rows.select("track", n.alias("n"), left.alias("l"), right.alias("r")).withColumn("mono", (F.col("l") + F.col("r")) / 2)


def long_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few long tracks: (track, n, l, r, mono)."""
    return signals_of(spark, sf_dir, F.concat("l_returnflag", "l_linestatus"), long=True)


def short_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short tracks, one per supplier."""
    return signals_of(spark, sf_dir, F.col("l_suppkey"))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mono track per user of the events: (track, n, mono)."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), n.alias("n"), ((F.col("value") - 50) / 500).alias("mono"))


def signals_sql(track: str) -> str:
    return f"""select track, n, l, r, (l + r) / 2 as mono from (select {track} as track,
      row_number() over (partition by {track} order by {', '.join(ORDER)}) - 1 as n,
      (l_quantity - 25.5::double) / 24.5::double as l, l_discount * 20 - 1 as r from lineitem)"""


LONG = f"long as ({signals_sql('l_returnflag || l_linestatus')})"
SHORT = f"short as ({signals_sql('l_suppkey')})"
EVENTS = "ev as (select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as n, (value - 50) / 500 as mono from events)"


def db(x: str) -> str:
    return f"(case when ({x}) > 0 and isfinite(({x})) then 20 * log10({x}) else '-inf'::double end)"


def lufs(x: str) -> str:
    return f"(case when ({x}) > 0 then -0.691::double + 10 * log10({x}) when ({x}) <= 0 then '-inf'::double end)"

"""Queries of streams: the events table is read as a stream and all of it is handled."""

from __future__ import annotations

import atexit
import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondine.operators.loudness import ABSOLUTE_GATE
from ondine.plans.dynamics import fr, rounded
from ondine.plans.kept import kept
from ondine.plans.loudness import pole
from ondine.plans.registry import query
from ondine.plans.views import lufs, table
from ondine.staging import remove, shared_dir, staged
from ondine.streaming import histogram, live


def source(spark: SparkSession, d: str) -> DataFrame:
    """(track, ts, n, x) of the events as a stream."""
    path = f"{d}/events.parquet"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(table(spark, d, "events").schema)
    raw = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.col("user_id").alias("track"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"), ((F.col("value") - 50) / 500).alias("x"))


#: Files of the mixed stream but the last two, days that each brings, and how late a sample may come.
FILES, DAYS, LATE = 6, 5, "3 days"


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """(track, ts, n, x, expected) of the events as a stream of several files, one a batch. A sample comes up to two days after its time, so files
    bring samples out of order; last rows without a track move the watermark past all. ``expected`` is the number of a track's samples, and one more
    for every fifth track, which so is never whole."""
    raw = table(spark, d, "events")
    sizes = raw.groupBy("user_id").agg((F.count("*") + (F.col("user_id") % 5 == 0).cast("int")).alias("expected"))
    made = kept(spark, d, "mixed", lambda: raw.join(sizes, "user_id").select(F.col("user_id").cast("bigint").alias("track"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("n"), ((F.col("value") - 50) / 500).alias("x"), "expected"), source="events")
    first, last = made.agg(F.min("ts"), F.max("ts")).first()
    base = f"{shared_dir(spark)}/ondine-events-{uuid.uuid4().hex}"
    atexit.register(remove, spark, base)
    day = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / 86_400_000_000) + F.pmod(F.xxhash64("n"), F.lit(3))
    part = F.least(F.floor(day / DAYS), F.lit(FILES - 1))
    closing = spark.createDataFrame([(None, last + datetime.timedelta(days=60), None, None, None)], made.schema)
    for k in range(FILES):
        made.where(part == k).coalesce(1).write.mode("append").parquet(base)
    for _ in range(2):  # the watermark that the first one moves holds from the next batch on
        closing.coalesce(1).write.mode("append").parquet(base)
    return spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(base)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is and returns what its sink holds at the end."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/ondine-stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces what it wrote; a complete one replaces all before it
        batch.write.mode("overwrite").parquet(f"{base}/out/{0 if mode == 'complete' else number}")

    try:
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
        running.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    made = staged(spark.read.schema(stream.schema).parquet(f"{base}/out/*"), "stream")
    remove(spark, base)
    return made.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in made.dtypes])


EV = "ev as (select user_id as track, ts, event_id as n, (value - 50) / 500 as x from events)"


@query(f"""with {EV}, w as (select *, unnest([time_bucket(interval 1 hour, ts) - interval 2 hour, time_bucket(interval 1 hour, ts) - interval 1 hour, time_bucket(interval 1 hour, ts)]) as start from ev)
  select track, start, count(*) as samples, round(case when avg(x * x) > 0 then -0.691 + 10 * log10(avg(x * x)) else '-inf'::double end, 6) as lufs from w group by track, start""")
def q_stream_loudness(spark, d):
    return rounded(drained(live.loudness(source(spark, d), "3 hours", "1 hour", "1 day"), "complete"))


@query(f"with {EV} select track, time_bucket(interval 6 hour, ts) as start, count(*) as samples, round(sum(x * x), 12) as energy from ev group by 1, 2")
def q_stream_tumbling(spark, d):
    return rounded(drained(live.tumbling_energy(source(spark, d), "6 hours", "1 day"), "complete"), 12)


@query(f"""with {EV}, g as (select *, case when ts - lag(ts) over (partition by track order by ts, n) < interval 12 hour then 0 else 1 end as b from ev where abs(x) >= 0.2), s as (select *, sum(b) over (partition by track order by ts, n rows unbounded preceding) as k from g)
  select track, min(ts) as start, count(*) as samples, round(max(abs(x)), 6) as peak from s group by track, k""")
def q_stream_clip_sessions(spark, d):
    return rounded(drained(live.loud_sessions(source(spark, d), 0.2, "12 hours", "1 day"), "complete"))


@query(f"""with recursive ev as (select user_id as track, event_id, row_number() over (partition by user_id order by ts, event_id) as n, (value - 50) / 500 as x from events),
  s as (select track, n, event_id, (1 - {pole(100)}) * x as y from ev where n = 1 union all select ev.track, ev.n, ev.event_id, (1 - {pole(100)}) * ev.x + {pole(100)} * s.y from s join ev on ev.track = s.track and ev.n = s.n + 1)
  select track, event_id as n, round(y, 6) as y from s""")
def q_stream_iir_state(spark, d):
    return rounded(drained(live.folded(mixed(spark, d), LATE, live.LowPass("bigint", 100, 1000)), "append"))


@query(f"""with {EV}, g as (select *, abs(x) >= 0.2 as loud, row_number() over (partition by track order by ts, n) - row_number() over (partition by track, abs(x) >= 0.2 order by ts, n) as island from ev)
  select track, min(ts) as ts, count(*) as samples, round(max(abs(x)), 6) as peak from g where loud group by track, island""")
def q_stream_clip_runs(spark, d):
    return rounded(drained(live.folded(mixed(spark, d), LATE, live.LoudRuns("bigint", 0.2)), "append"))


@query(f"""with recursive {EV}, l as (select track, ts, n from ev where abs(x) >= 0.1),
  o as (select track, min(ts) as ts from l group by track union all select l.track, min(l.ts) from o join l on l.track = o.track and l.ts >= o.ts + interval 2 day group by l.track, o.ts)
  select track, min(n) as n, ts from o join l using (track, ts) group by track, ts""")
def q_stream_onsets(spark, d):
    return drained(live.folded(mixed(spark, d), LATE, live.Onsets("bigint", 0.1, 2 * 86_400_000_000)), "append")


@query(f"""with {EV} select track, count(*) as samples, track % 5 <> 0 as whole, round(avg(x), 6) as dc, round(avg(x * x), 6) as power, round(max(abs(x)), 6) as peak, min(ts) as first, max(ts) as last from ev group by track""")
def q_stream_results(spark, d):
    return rounded(drained(live.folded(mixed(spark, d), LATE, live.Ends("bigint")), "append"))


#: Events as tracks of ten samples a second, with one channel.
TEN = "te as (select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as n, (value - 50) / 500 as l from events)"


def _percentile_sql(share: float, dropped: str) -> str:
    return f"bs[least(c - 1, {dropped} + floor((c - {dropped}) * {share}::double)::bigint) + 1]"


@query(f"""with {TEN}, g as (select track, p, floor({lufs('p')} / 0.01::double) as b from ({fr('te', 4, 3, 'sum(l * l) / 4 as p', strict=False)}) where p >= {ABSOLUTE_GATE!r}::double),
  m as (select track, floor({lufs('avg(p) * 0.1')} / 0.01::double) as e from g group by track),
  q as (select track, {lufs('avg(p)')} as low, {lufs('avg(p) filter (b > e)')} as high from g join m using (track) where b >= e group by track),
  s as (select track, {lufs('p')} as v from ({fr('te', 30, 1, 'sum(l * l) / 30 as p', strict=False)}) where {lufs('p')} > -70), t as (select track, count(*) as c, floor((avg(v) - 20) / 0.01::double) as e from s group by track),
  u as (select track, c, list(floor(v / 0.01::double) order by v) as bs, count(*) filter (floor(v / 0.01::double) < e) as few, count(*) filter (floor(v / 0.01::double) <= e) as many from s join t using (track) group by track, c)
  select track, samples, round(coalesce(low, '-inf'::double), 6) as gated_low, round(coalesce(high, '-inf'::double), 6) as gated_high,
    round(case when c >= 2 then greatest(0, ({_percentile_sql(0.95, 'few')} - {_percentile_sql(0.1, 'many')} - 1) * 0.01::double) else 0 end, 6) as lra_low,
    round(case when c >= 2 then ({_percentile_sql(0.95, 'many')} + 1 - {_percentile_sql(0.1, 'few')}) * 0.01::double else 0 end, 6) as lra_high
  from (select track, count(*) as samples from te group by track) left join q using (track) left join u using (track)""")
def q_stream_gated(spark, d):
    """Bounds of gated loudness and loudness range from a stream in mixed order."""
    return rounded(drained(live.folded(mixed(spark, d), LATE, histogram.Loudness("bigint", 10)), "append"))

"""Queries of files: WAV reading and writing, file lists, pictures, and the kernels of the joined channels."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ondine.operators import raster, spectral
from ondine.plans.registry import query
from ondine.plans.spectral import BINS, FS, GRAM, SIZE, spectra
from ondine.plans.views import LONG, RATE, long_signals, table
from ondine.sources import wav
from ondine.staging import remove, shared_dir


def written(spark, d):
    """The long signals as WAV files, read in splits: at least four of the longest, and none above what a task takes."""
    path = f"{shared_dir(spark)}/ondine-wav-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    signals = long_signals(spark, d)
    wav.write(signals, path, RATE, block=1 << 14)
    longest = signals.groupBy("track").count().agg(F.max("count")).first()[0] or 1
    return wav.read(spark, path, split=min(wav.SPLIT, max(4096, longest * 6 // 4)))


@query(f"""with {LONG}, q as (select track, n, floor(greatest(-1, least(1, l)) * 8388607 + 0.5) / 8388608 as l, floor(greatest(-1, least(1, r)) * 8388607 + 0.5) / 8388608 as r from long)
  select track, count(*) as samples, round(avg(l), 5) as mean_l, round(sqrt(avg(r * r)), 5) as rms_r from q group by track""")
def q_wav_roundtrip(spark, d):
    back = wav.samples(written(spark, d)).withColumn("track", F.regexp_extract("track", r"([^/]+)\.wav$", 1))
    return back.groupBy("track").agg(F.count("*").alias("samples"), F.round(F.avg("l"), 5).alias("mean_l"), F.round(F.sqrt(F.avg(F.col("r") * F.col("r"))), 5).alias("rms_r"))


@query(f"with {LONG} select track as path, {RATE} as sample_rate, 2 as channels, 24 as bit_depth, count(*) as frames from long group by track")
def q_wav_header(spark, d):
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("path")
    return written(spark, d).groupBy(name, "sample_rate", "channels", "bit_depth").agg(F.sum(F.size("l")).alias("frames"))


@query("""select 'text ' || doc_id as path, null::int as sample_rate, null::int as channels, null::int as samples, 'no RIFF/WAVE file' as error from documents where text is not null
  union all select 'head ' || vec_id, null, null, null, 'no data chunk' from embeddings union all select 'file ' || vec_id, 8000, 2, (len(embedding) // 2)::int, null from embeddings""")
def q_reader_wav(spark, d):
    """Vectors as files of two channels, their heads alone, and texts: what is broken gives a row with the reason."""
    texts = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("text "), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    vectors = table(spark, d, "embeddings")

    @F.pandas_udf("binary")
    def encoded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: wav.encoded(np.asarray(v, float).reshape(-1, 2), 8000))

    files = vectors.select(F.concat(F.lit("file "), "vec_id").alias("path"), encoded("embedding").alias("content"))
    heads = vectors.select(F.concat(F.lit("head "), "vec_id").alias("path"), F.lit("RIFFxxxxWAVE").cast("binary").alias("content"))
    made = wav.parsed(texts.unionByName(files).unionByName(heads))
    return made.select("path", "sample_rate", "channels", F.size("l").alias("samples"), "error")


@query()
def q_file_scan_order(spark, d):
    """The table files themselves, kept by a name filter and numbered in collation order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d).select("path", "length")
    parts = F.split("path", "/")
    rows = found.select(F.element_at(parts, -2).alias("album"), F.element_at(parts, -1).alias("name"), "length").where(F.rlike("name", F.lit(r"(?i)\.parquet$")) | wav.is_audio(F.col("name")))
    return wav.numbered(rows).select("album", "name", "track_number")


COLOR = "greatest(0, least(255, floor((db + 90) / 90 * 255 + 0.5)))::int"
ROW = "(case when k <= 1 then 59 else 59 - floor(log10(k::double) / log10(30::double) * 59) end)::int"


@query(f"""with {BINS}, {GRAM}, z as (select track, max(t) + 1 as c from sg group by track), wc as (select track, floor(t * (100 / c::double))::bigint as x0, least(floor((t + 1) * (100 / c::double))::bigint, 100) - 1 as x1, {ROW} as y, k, {COLOR} as color from sg join z using (track)),
  o as (select track, x0, x1, y, arg_max(color, k) as color from wc where x1 >= x0 group by track, x0, x1, y), f as (select *, coalesce(lead(y) over (partition by track, x0 order by y desc) + 1, y) as y0 from o), p as (select track, x, unnest(range(y0, y + 1)) as y, color from f, range(100) q(x) where x between x0 and x1)
  select track, x // 25 as part, count(*) as cells, sum(color)::bigint as color_sum, sum(y)::bigint as y_sum from p group by track, part""")
def q_raster_cells(spark, d):
    gram = spectral.spectrogram(spectra(spark, d), FS, SIZE)
    made = raster.cells(gram, 30, 100, 60)
    return made.groupBy("track", F.floor(F.col("x") / 25).alias("part")).agg(F.count("*").alias("cells"), F.sum("color").alias("color_sum"), F.sum("y").alias("y_sum"))


@query(("""with q as (select event_id, """ + COLOR.replace("db", "(-value / 8)") + """ as i from events) select event_id, i, {0} as r, {1} as g, {2} as b from q""").format(*[f"greatest(0, least(255, floor(case when i / 255::double < 0.25 then {a[0]} + i / 255::double / 0.25 * {a[1]} when i / 255::double < 0.5 then {b[0]} + (i / 255::double - 0.25) / 0.25 * {b[1]} when i / 255::double < 0.75 then {c[0]} + (i / 255::double - 0.5) / 0.25 * {c[1]} else {e[0]} + (i / 255::double - 0.75) / 0.25 * {e[1]} end + 0.5)))::int" for a, b, c, e in (((68, -10), (58, -25), (33, 90), (123, 130)), ((1, 40), (41, 80), (121, 70), (191, 60)), ((84, 40), (124, -20), (104, -60), (44, -30)))]))
def q_color_map(spark, d):
    """The colours of the events, whose values count as levels."""
    index = raster.color_index(-F.col("value") / 8)
    return table(spark, d, "events").select("event_id", index.alias("i"), raster.colors(index).alias("c")).select("event_id", "i", "c.*")

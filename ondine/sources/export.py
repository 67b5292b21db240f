"""The JSON report of an album, one document per album."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondine.functions.scalar import finite, iso_text, slug
from ondine.operators.album import findings, key_findings, ready_note, recommendations, summary
from ondine.sources.committed import write_text

VERSION = "1.0"


def plain(df: DataFrame) -> DataFrame:
    """Doubles that JSON has no number for become null."""
    return df.select(*[F.when(finite(F.col(c)), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def file_name(name: Column) -> Column:
    return F.concat(slug(name), F.lit("-analysis.json"))


def report(tracks: DataFrame, kind: str, exported: Column | None = None) -> DataFrame:
    """(album, file, json): summary with findings and recommendations, an overview of the tracks in order, and the time of the export (now, if none is given)."""
    told = {"findings": findings(), "key_findings": key_findings(), "recommendations": recommendations(), "note": ready_note(F.col("ready"), F.col("avg_lufs"))}
    heads = plain(summary(tracks)).withColumns(told)
    overview = plain(tracks.select("album", "track_number", "seconds", "lufs", "tp", "dr", "n_issues", "n_warnings"))
    packed = overview.groupBy("album").agg(F.array_sort(F.collect_list(F.struct("track_number", "seconds", "lufs", "tp", "dr", "n_issues", "n_warnings"))).alias("tracks"))
    both = heads.withColumn("summary", F.struct(*[c for c in heads.columns if c != "album"])).select("album", "summary").join(packed, "album")
    made = F.struct(F.lit(VERSION).alias("version"), iso_text(F.current_timestamp() if exported is None else exported).alias("exported"), F.lit(kind).alias("kind"), F.col("album").alias("name"), "summary", "tracks")
    return both.select("album", file_name(F.col("album")).alias("file"), F.to_json(made, {"ignoreNullFields": "false"}).alias("json"))


def write(reports: DataFrame, path: str) -> None:
    """A file for each album in the folder ``path``, under the report's file name."""
    write_text(reports.select("file", F.col("json").alias("content")), path)

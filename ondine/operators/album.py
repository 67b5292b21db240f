"""Albums: what their tracks give together. Rows are measured tracks with album and track_number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondine.functions.scalar import at_share, half_up


def summary(tracks: DataFrame) -> DataFrame:
    """Means, extremes, deviations and counts; a missing metric counts in none of them."""
    r = lambda x, d: F.round(x, d)
    return tracks.groupBy("album").agg(
        F.count("*").alias("tracks"), r(F.avg("lufs"), 1).alias("avg_lufs"), r(F.min("lufs"), 1).alias("min_lufs"), r(F.max("lufs"), 1).alias("max_lufs"), r(F.stddev_pop("lufs"), 2).alias("lufs_sd"), r(F.avg("lra"), 1).alias("avg_lra"),
        r(F.coalesce(F.max("tp"), F.lit(-3.0)), 1).alias("max_tp"), r(F.avg("tp"), 1).alias("avg_tp"), r(F.avg("dr"), 1).alias("avg_dr"), r(F.avg("crest"), 1).alias("avg_crest"), r(F.avg("corr"), 2).alias("avg_corr"), r(F.avg("tilt"), 1).alias("avg_tilt"),
        r(F.avg("harsh"), 0).alias("avg_harsh"), r(F.coalesce(F.avg("ai_score"), F.lit(0.0)), 1).alias("avg_ai"), F.count_if(F.coalesce("tp", F.lit(-10.0)) > -1).alias("above_peak"), F.count_if("clipped").alias("with_clipping"), F.count_if("low_phase").alias("with_phase"),
        F.count_if(F.coalesce("ai_score", F.lit(0.0)) > 30).alias("with_artifacts"), F.count_if(F.col("n_issues") > 0).alias("with_issues"), F.count_if(F.col("n_warnings") > 0).alias("with_warnings"), F.sum("n_issues").alias("issues"), F.sum("n_warnings").alias("warnings"),
        F.every(F.col("n_issues") == 0).alias("ready"), F.sum("seconds").alias("seconds"),
    )


def sequence(tracks: DataFrame) -> DataFrame:
    """Spread of loudness, the largest jump between neighbours and where it is (the first among equals), and the score it leaves."""
    some = tracks.where(F.col("lufs").isNotNull())
    order = Window.partitionBy("album").orderBy("track_number")
    rows = some.withColumns({"place": F.row_number().over(order) - 1, "jump": F.abs(F.col("lufs") - F.lag("lufs").over(order))})
    made = rows.groupBy("album").agg((F.max("lufs") - F.min("lufs")).alias("spread"), F.coalesce(F.max("jump"), F.lit(0.0)).alias("jump"), F.min_by("place", F.when(F.col("jump").isNotNull(), F.struct(-F.col("jump"), "place"))).alias("at"))
    score = F.greatest(F.lit(0), half_up(100 - F.col("jump") * 10))
    return made.select("album", "spread", "jump", F.when(F.col("jump") > 0, F.col("at")).alias("at"), score.alias("score"))


def deviating(tracks: DataFrame) -> DataFrame:
    """Tracks that lie far from their album's mean tilt, harshness or width, in albums of three or more."""
    w = Window.partitionBy("album")
    means = {f"m_{c}": F.coalesce(F.avg(c).over(w), F.lit(0.0)) for c in ("tilt", "harsh", "width")}
    rows = tracks.withColumns(means | {"size": F.count("*").over(w)})
    far = lambda c, most: F.abs(F.coalesce(c, f"m_{c}") - F.col(f"m_{c}")) > most
    return rows.where((F.col("size") >= 3) & (far("tilt", 2) | far("harsh", 15) | far("width", 25))).select("album", "track_number")


def outliers(tracks: DataFrame) -> DataFrame:
    """Tracks far from their album's (upper) median loudness or tilt, with the reasons."""
    medians = tracks.groupBy("album").agg(F.count("*").alias("size"), at_share(F.collect_list("lufs"), 0.5).alias("ml"), at_share(F.collect_list("tilt"), 0.5).alias("mt"))
    rows = tracks.join(medians, "album").where(F.col("size") >= 3)
    lufs, tilt = F.coalesce("lufs", "ml"), F.coalesce("tilt", "mt")
    reasons = F.filter(F.array(
        F.when(F.abs(lufs - F.col("ml")) > 4, F.when(lufs > F.col("ml"), "louder").otherwise("quieter")),
        F.when(F.abs(tilt - F.col("mt")) > 3, F.when(tilt > F.col("mt"), "brighter").otherwise("darker")),
    ), lambda x: x.isNotNull())
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("album", "track_number", F.array_join("reasons", " and ").alias("reason"))


def breakdown(tracks: DataFrame) -> DataFrame:
    """Five scores of an album, each the rounded mean of its tracks' points."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    lufs, corr, harsh, tp = c("lufs", -14.0), c("corr", 0.8), c("harsh", 20.0), F.coalesce(F.col("tp") - 14 - F.col("lufs"), F.lit(-3.0))
    mean = lambda points: half_up(F.avg(points))
    return tracks.groupBy("album").agg(
        mean(F.when((lufs > -9) | (lufs < -20), 6).when((lufs > -11) | (lufs < -18), 8).otherwise(10)).alias("loudness"),
        mean(F.when(F.col("clipped"), 5).otherwise(10)).alias("dynamics"),
        mean(F.when(corr < 0, 4).when(corr < 0.5, 7).otherwise(10)).alias("translation"),
        mean(F.when(harsh > 35, 6).when(harsh > 28, 8).otherwise(10)).alias("spectral"),
        mean(F.when(tp > 0, 5).when(tp > -1, 7).otherwise(10)).alias("streaming"),
    )


#: Wording of the findings, with the column that they name, and what to do about them.
FINDINGS = {
    "loud": ("Album is very loud (avg %.1f LUFS)", "avg_lufs", "Consider reducing loudness for better streaming platform performance"),
    "quiet": ("Album is relatively quiet (avg %.1f LUFS)", "avg_lufs", "May be normalized up on streaming platforms, which is generally fine"),
    "optimal": ("Album loudness is in optimal range (avg %.1f LUFS)", "avg_lufs", None),
    "peaks": ("%d track(s) exceed -1 dBTP true peak", "above_peak", "Consider reducing peaks to below -1 dBTP for codec safety margin"),
    "clipping": ("%d track(s) contain clipping", "with_clipping", "Review clipped tracks and consider re-mastering"),
    "dynamics": ("Limited dynamic range detected", None, "Consider preserving more dynamics for improved listening experience"),
    "phase": ("%d track(s) have phase issues", "with_phase", "Check mono compatibility and low-end phase alignment"),
}


def findings() -> Column:
    """Codes of what to tell about a summarised album, in the order of FINDINGS; nothing on its loudness where that is missing."""
    c = F.col
    each = F.array(
        F.when(c("avg_lufs") > -10, "loud").when(c("avg_lufs") < -16, "quiet").when(c("avg_lufs").isNotNull(), "optimal"),
        F.when(c("above_peak") > 0, "peaks"), F.when(c("with_clipping") > 0, "clipping"), F.when(c("avg_dr") < 6, "dynamics"), F.when(c("with_phase") > 0, "phase"),
    )
    return F.filter(each, lambda x: x.isNotNull())


def key_findings() -> Column:
    """The findings in words."""
    text = lambda pattern, of: F.format_string(pattern, F.col(of)) if of else F.lit(pattern)
    return _worded({code: text(pattern, of) for code, (pattern, of, _) in FINDINGS.items()})


def recommendations() -> Column:
    """What to do about the findings, in words; some ask for nothing."""
    return _worded({code: F.lit(advice) for code, (_, _, advice) in FINDINGS.items() if advice})


def _worded(texts: dict[str, Column]) -> Column:
    held = findings()
    each = F.array(*[F.when(F.array_contains(held, code), text) for code, text in texts.items()])
    return F.filter(each, lambda x: x.isNotNull())


# Wording of the note.
def ready_note(ready: Column, avg_lufs: Column) -> Column:
    return F.when(ready, F.when(avg_lufs > -14, "Distribution Ready (with normalization)").otherwise("Distribution Ready")).otherwise("Address issues before distribution")

"""Search over a catalog of named rows: filters, ranked search and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows whose columns hold the text, in any case; all rows for a blank one."""
    q = text.lower().strip()
    if not q:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return rows.where(hit)


def relevance(text: str, name: Column, **parts: Column) -> Column:
    """Points of a row: its name equal to, starting with or holding the text, and what else holds it.

    parts: category 40, unit 50, standard 45, description 30, good_range 25, action 20.
    """
    q = F.lit(text.lower())
    low = F.lower(name)
    points = F.when(low == q, 100).when(F.startswith(low, q), 80).when(F.contains(low, q), 60).otherwise(0)
    for part, worth in (("category", 40), ("unit", 50), ("standard", 45), ("description", 30), ("good_range", 25), ("action", 20)):
        if part in parts:
            points = points + F.when(F.coalesce(F.contains(F.lower(parts[part]), q), F.lit(False)), worth).otherwise(0)
    return points


def ranked(rows: DataFrame, score: Column, ordinal: str) -> DataFrame:
    """Rows with points, best first; the catalog's order breaks ties."""
    return rows.withColumn("score", score).where(F.col("score") > 0).orderBy(F.desc("score"), ordinal)


def suggestions(rows: DataFrame, text: str, score: Column, ordinal: str, most: int = 6) -> DataFrame:
    """The best rows for a text of two characters or more."""
    if len(text.strip()) < 2:
        return ranked(rows, score, ordinal).limit(0)
    return ranked(rows, score, ordinal).limit(most)


def highlighted(text: Column, query: str) -> Column:
    """Struct of what stands before the first match, the match, and what follows; all of it before where there is none."""
    at = F.instr(F.lower(text), query.lower())
    n = F.lit(len(query))
    return F.when(at > 0, F.struct(F.substr(text, F.lit(1), at - 1).alias("before"), F.substr(text, at, n).alias("match"), F.substr(text, at + n).alias("after"))).otherwise(F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


def toggled(held: Column, changed: Column) -> Column:
    """Symmetric difference of two arrays, sorted."""
    return F.array_sort(F.array_union(F.array_except(held, changed), F.array_except(changed, held)))

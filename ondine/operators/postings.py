"""Search of a catalog by postings: runs of three characters, each with the rows whose texts hold it.

Postings carry the texts that are searched and scored and lie sorted by their run. A search reads the postings of its rarest run alone, keeps the
rows that really hold the text and scores these; it doesn't read the catalog.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondine.operators.catalog import matching, ranked
from ondine.staging import staged

#: Characters of a run.
RUN = 3


class Postings(NamedTuple):
    """``lists``: (run, columns of the rows), sorted by run; ``sizes``: (run, rows), how many rows hold it; ``columns``: those searched."""

    lists: DataFrame
    sizes: DataFrame
    columns: tuple[str, ...]
    rows: DataFrame


def runs_of(text: str) -> list[str]:
    low = text.lower()
    return sorted({low[i : i + RUN] for i in range(len(low) - RUN + 1)})


def indexed(rows: DataFrame, *columns: str, keep: Callable[[DataFrame, str], DataFrame] = staged) -> Postings:
    """Postings over the text columns of ``rows``. A row stands once under each of its runs, whichever columns hold it; nulls and texts of fewer
    characters have none. A run that many rows hold is spread over several files. ``keep`` writes a table."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - (RUN - 1))), lambda i: F.substr(x, i, F.lit(RUN)))
    runs = F.array_distinct(F.filter(F.concat(*[cut(x) for x in low]), lambda r: F.length(r) == RUN))
    every = rows.select(F.explode(runs).alias("run"), *rows.columns)
    lists = keep(every.repartitionByRange("run", F.xxhash64(*columns)).sortWithinPartitions("run"), "postings")
    sizes = keep(lists.groupBy("run").agg(F.count("*").alias("rows")).repartitionByRange("run").sortWithinPartitions("run"), "posting-sizes")
    return Postings(lists, sizes, columns, rows)


def found(index: Postings, text: str) -> DataFrame:
    """Rows whose columns hold the text in any case, with the columns of the catalog. A text of fewer than three characters has no run and scans
    the catalog; one with a run that no row holds finds nothing. At most as many sizes as the text has runs come to the driver."""
    if not text.strip():
        return index.rows
    wanted = runs_of(text.strip())
    if not wanted:
        return matching(index.rows, text, *index.columns)
    sizes = {r["run"]: r["rows"] for r in index.sizes.where(F.col("run").isin(wanted)).collect()}
    rarest = min(wanted, key=lambda r: (sizes.get(r, 0), r))
    return matching(index.lists.where(F.col("run") == rarest), text, *index.columns).select(*index.rows.columns)


def search(index: Postings, text: str, score: Column, ordinal: str) -> DataFrame:
    """The hits with points, best first; the catalog's order breaks ties. ``score`` must be 0 for rows that don't hold the text."""
    return ranked(found(index, text), score, ordinal)

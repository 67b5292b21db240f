"""Magnitude spectrum of a signal of any length: a transform in four steps over blocks, with two shuffles.

A signal of N = a * b samples, padded with zeros to a power of two, is a matrix of a rows and b columns. Columns are transformed, their values turned by
the angle of their place, and the rows of what comes out are transformed: X[p + a q] is the q-th value of row p. A task holds a group of
columns or of rows, ``cells`` values or one column, so neither a task nor a cell of a table holds a signal.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondine.functions.scalar import next_power_of_2
from ondine.staging import staged

#: Values that a task holds at a time.
CELLS = 1 << 18


#: Values of a batch that goes back to Spark.
BATCH = 1 << 17


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), np.concatenate(parts))


@functools.lru_cache(maxsize=4)
def _turn(rows: int, columns: int, first: int, wide: int) -> np.ndarray:
    angle = np.outer(np.arange(rows), first + np.arange(wide)) % (rows * columns)
    return np.exp(-2j * np.pi / (rows * columns) * angle)


def _columns(cells: int):
    """Of rows (track, a, b, group, n, x), each a group of columns: chunks (track, a, b, rows, group, re, im) for each group of rows, turned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, chunks, held = [], [], 0
            for i in range(batch.num_rows):
                rows, columns, g = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                n, x = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                wide, high = min(columns, max(1, cells // rows)), min(rows, max(1, cells // columns))
                own = np.zeros((rows, wide))
                own[n // columns, n % columns - g * wide] = x
                made = np.fft.fft(own, axis=0) * _turn(rows, columns, g * wide, wide)
                own_chunks = [(k, made[r : r + high].ravel()) for k, r in enumerate(range(0, rows, high))]
                chunks, at, held = chunks + own_chunks, at + [i] * len(own_chunks), held + made.size
                if held >= BATCH or i == batch.num_rows - 1:
                    place = pa.array(at, pa.int64())
                    track, a, b, group = (batch.column(c).take(place) for c in range(4))
                    yield pa.RecordBatch.from_arrays([track, a, b, pa.array([k for k, _ in chunks], pa.int64()), group, _lists([z.real for _, z in chunks]), _lists([z.imag for _, z in chunks])], ["track", "a", "b", "rows", "group", "re", "im"])
                    at, chunks, held = [], [], 0

    return run


def _rows(cells: int):
    """Of rows (track, a, b, rows, re, im), each a group of rows whose chunks are in order of their columns: (track, k, mag) of the lower half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, levels, held = [], [], [], 0
            for i in range(batch.num_rows):
                rows, columns, g = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                high = min(rows, max(1, cells // columns))
                re, im = ([c.values.to_numpy(zero_copy_only=False).reshape(high, -1) for c in batch.column(c)[i].values] for c in (4, 5))
                mags = np.abs(np.fft.fft(np.concatenate(re, 1) + 1j * np.concatenate(im, 1), axis=1))
                k = (g * high + np.arange(high))[:, None] + rows * np.arange(columns)
                lower = k < rows * columns // 2
                at.append(np.full(int(lower.sum()), i))
                places.append(k[lower])
                levels.append(mags[lower])
                held += mags.size
                if held >= BATCH or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(places)), pa.array(np.concatenate(levels))], ["track", "k", "mag"])
                    at, places, levels, held = [], [], [], 0

    return run


def magnitudes(signals: DataFrame, cells: int = CELLS) -> DataFrame:
    """Of (track, n, x), n from 0 without gaps: (track, k, mag) for the lower half of the padded length, without a window.

    A null sample counts as 0. A signal of one sample has no lower half and no rows. A group of columns that holds padding only goes along, as its
    chunks are zeros that the rows need.
    """
    own = staged(signals.select("track", F.col("n").cast("bigint").alias("n"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")), "samples")
    sizes = own.groupBy("track").agg(next_power_of_2(F.max("n") + 1).alias("size"))
    bits = F.length(F.bin("size")) - 1
    power = lambda e: F.call_function("shiftleft", F.lit(1).cast("bigint"), e.cast("int"))
    shapes = sizes.select("track", power(F.ceil(bits / 2)).alias("a"), power(F.floor(bits / 2)).alias("b"))
    wide = F.least("b", F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("a"))))
    laid = own.join(shapes, "track").withColumn("group", F.floor(F.col("n") % F.col("b") / wide))
    packed = laid.groupBy("track", "a", "b", "group").agg(F.collect_list(F.struct("n", "x")).alias("s"))
    # columns behind a short signal's end have no sample, and their group none at all
    every = shapes.select("track", "a", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("b") / wide) - 1)).alias("group"))
    whole = every.join(packed, ["track", "a", "b", "group"], "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<n: bigint, x: double>>")))
    kind = own.schema["track"].dataType.simpleString()
    asked = whole.select("track", "a", "b", "group", F.transform("s", lambda v: v["n"]).alias("n"), F.transform("s", lambda v: v["x"]).alias("x"))
    turned = asked.mapInArrow(_columns(cells), f"track {kind}, a bigint, b bigint, rows bigint, group bigint, re array<double>, im array<double>")
    crossed = turned.groupBy("track", "a", "b", "rows").agg(F.sort_array(F.collect_list(F.struct("group", "re", "im"))).alias("s"))
    chunks = crossed.select("track", "a", "b", "rows", F.transform("s", lambda v: v["re"]).alias("re"), F.transform("s", lambda v: v["im"]).alias("im"))
    return chunks.mapInArrow(_rows(cells), f"track {kind}, k bigint, mag double")

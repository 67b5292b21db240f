"""Whitening of embeddings by an exact integer scatter.

Each component c becomes the integer floor(scale * c) + shift. Tasks take the shift away again, add up vectors and their products in
integers without a bound (products in doubles only where all sums stay below 2**53), and send them as limbs of 2**48, which
Spark adds as decimals. From the sums S and products P of all n vectors n * P - S S' is formed exactly, a shift cancels in it, and only then are
numbers rounded to doubles and decomposed. A second pass projects n * x - S, an exact integer, so nothing is lost in the
difference to the mean. The covariance of what comes out is measured on the vectors that were made.

The fit list is every vector that takes part. Null vectors and those that hold null or non-finite entries take no part, and neither do
those of another length than the commonest (ties: the shorter), as no covariance joins them. Rows with a null id take part, repeated rows count
each. Where a component has no variance (one vector, equal vectors, fewer vectors than dimensions) its whitened value and share are 0, and
the covariance is compared over the others. Entries of any size are exact; a ``deviation`` that no long holds is null. Without vectors there
are no rows. Other columns are not read.

The driver holds d * d numbers for d dimensions, whatever the number of rows, and tasks the means and the components.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondine.llm._common import staged

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of a limb; 2**78 of them fit the sum of a decimal.
LIMB = 48
#: Below this doubles hold every integer.
EXACT = 1 << 53
#: Vectors that a task works on at once.
ROWS = 4096


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fine


def integers(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT of doubles, exactly: 64-bit where they fit, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(c * SCALE)  # a power of two rounds nothing
    if not scaled.size or np.abs(scaled).max() < EXACT:
        return scaled.astype(np.int64) + SHIFT
    whole = lambda v: int(np.floor(v * SCALE)) if abs(v) < 1e300 else int(v) * SCALE  # noqa: E731  so large a double is whole
    return np.array([[whole(v) + SHIFT for v in row] for row in c.tolist()], dtype=object)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns and of the products of any two, as Python's integers."""
    d = x.shape[1]
    sums, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
    most = max(1, int(np.abs(x).max()) if x.size else 1)
    step = EXACT // most**2
    if x.dtype == object or step < 1:
        x = x.astype(object)
        return x.sum(0) + sums, x.T @ x + products
    for k in range(0, len(x), min(step, ROWS)):
        part = x[k : k + min(step, ROWS)].astype(np.float64)
        sums += part.sum(0).astype(np.int64).astype(object)
        products += (part.T @ part).astype(np.int64).astype(object)
    return sums, products


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) of an integer; the limbs of a negative one are negative."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        place += 1


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and products of all vectors. A task sends d * (d + 3) / 2 + 1 integers, however many vectors it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                s, p = scatter(integers(_matrix(batch.column(0).slice(k, ROWS), d)) - SHIFT)
                n, sums, products = n + min(ROWS, batch.num_rows - k), sums + s, products + p
        if n:
            cells = [(-1, -1, n)] + [(-1, j, int(sums[j])) for j in range(d)] + [(i, j, int(products[i, j])) for i in range(d) for j in range(i, d)]
            rows = [(i, j, place, limb) for i, j, v in cells for place, limb in limbs(v)]
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if a < 3 else pa.int64()) for a, c in enumerate(zip(*rows[k : k + 10_000]))], ["i", "j", "place", "limb"])

    parts = vectors.select("vector").mapInArrow(run, "i int, j int, place int, limb bigint")
    total: Counter[tuple[int, int]] = Counter()
    for r in parts.groupBy("i", "j", "place").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("v")).collect():  # d * d cells
        total[r.i, r.j] += int(r.v) << (LIMB * r.place)
    return total[-1, -1], [total[-1, j] for j in range(d)], [[total[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


def _matrix(cells: pa.Array, d: int) -> np.ndarray:
    return cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), d)


class Whitening:
    """The first components of the covariance and their variances, from the exact sums."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> None:
        d = len(sums)
        self.n, self.sums = n, sums
        exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        # a common power of two keeps any size within doubles; it changes no component, and the variances by its own factor
        self.half = max(0, max((abs(v).bit_length() for row in exact for v in row), default=0) - 900) // 2
        self.power = 2 * self.half
        scaled = np.array([[v / (1 << self.power) for v in row] for row in exact], dtype=np.float64).reshape(d, d)
        values, vectors = np.linalg.eigh(scaled) if d else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")[:components]
        trace = sum(exact[i][i] for i in range(d)) / (1 << self.power)
        known = values[order] > max(1, d) * np.finfo(float).eps * max(trace, 0)
        #: Variance of n * x, over 2**power.
        self.values = np.where(known, values[order], 0.0)
        self.vectors = vectors[:, order]
        self.explained = self.values / trace if trace > 0 else np.zeros(len(order))

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of rows y = n * x - S: y's projection over the root of its variance."""
        y = np.array([[v / (1 << self.half) for v in row] for row in y.tolist()], np.float64).reshape(y.shape) if y.dtype == object else y / 2.0**self.half
        size = np.sqrt(self.values)
        return np.where(size > 0, (y @ self.vectors) / np.where(size > 0, size, 1), 0.0)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    if x.dtype != object and n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows; None where a long can't hold them."""
    most = int(np.abs(y).max()) if y.size else 0
    if y.dtype != object and most**2 * max(1, y.shape[1]) < 1 << 63:
        return (y * y).sum(1).tolist()
    made = [sum(v * v for v in row) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in made]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    return Whitening(*_sums(vectors, d), components)


def _projected(vectors: DataFrame, model: Whitening, d: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                y = centred(integers(_matrix(some.column(1), d)) - SHIFT, own.n, own.sums)
                made = own.project(y)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(deviations(y), pa.int64()), pa.array(made.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    kind = T.StructType([vectors.schema["id"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return vectors.select("id", "vector").mapInArrow(run, kind)


def _identity_error(made: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened values, less the identity; means are taken away before multiplying."""
    known = [i for i, v in enumerate(model.values) if v > 0]
    if not known:
        return 0.0
    means = made.agg(*[F.avg(F.col("whitened")[i]) for i in known]).first()
    own = {i: F.col("whitened")[i] - F.lit(m) for i, m in zip(known, means)}
    pairs = [(i, j) for i in known for j in known if i <= j]
    found = made.agg(*[F.avg(own[i] * own[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening, float]:
    """Per vector id, deviation and its whitened values (an array), with the model and its measured error."""
    part = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    widths = part.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = widths.d if widths else 0
    part = part.where(F.size("vector") == d)
    model = fit(part, d, components)
    made = staged(_projected(part, model, d), "whitened")
    return made, model, _identity_error(made, model)


def rows(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component, numbered from 1: id_col, component, n, deviation, whitened, explained, identity_error."""
    made, model, error = whitened(vectors, components, id_col, vector_col)
    shares = F.array(*[F.lit(float(v)) for v in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    each = made.select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))

"""Nearest neighbours of a stated query set by a block matrix join.

Vectors are quantised to int8 with a scale of their own, and the norm of what that loses is kept. Queries and
candidates are dealt into tiles; in a tile products of int8 codes give all distances between the quantised vectors. They are made
in float32 over slices of 1,024 dimensions, in which its sums are exact, and the slices are added in double precision, so any
width is exact. By the triangle inequality the true distance lies within the two losses
of that, so a candidate whose lower bound is above the k-th smallest upper bound of a query cannot be among its k. The others
are computed again in double precision from the original vectors, each tile keeps a heap of k per query, and heaps are merged in
rounds of bounded groups. The result is exact. Bounds are made on vectors scaled by a tile's common power of two, and a distance whose
squares leave the range of doubles is computed at a scale of its own, so sizes from 1e-300 to 1e300 may meet. Tiles hold fewer vectors the longer these are,
and each length has tiles of its own.

Vectors that are null, all zero, or hold null or non-finite components take no part, neither as queries nor as candidates;
only vectors of one length are compared. Rows are their own selves: a repeated row is a candidate of its twin. Rows with a null id
take no part. Ties go to the smaller id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondine.llm._common import joined_by_count, spread, staged

#: Rows of a tile: of its candidates and of its queries.
TILE_CANDIDATES = 8192
TILE_QUERIES = 4096
#: Components that one side of a tile holds at most; longer vectors come in tiles of fewer rows.
TILE_COMPONENTS = 1 << 22
#: Dimensions over which float32 adds up products of int8 codes without rounding.
EXACT = 1024
#: Heaps of a query that one merge takes.
MERGED = 32

HEAP = "query_row bigint, query_id bigint, tile bigint, vec_id bigint, row bigint, score double"


def usable(vector: Column) -> Column:
    value = lambda x: x.cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and an upper bound of the norm that rounding loses; components are at most 1."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    lost = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale, lost * (1 + 1e-9) + 1e-12 * np.abs(x).max(1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of int8 codes, exact: 1,024 products of at most 127 * 127 stay below 2**24."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        out += a[:, d : d + EXACT].astype(np.float32) @ b[:, d : d + EXACT].astype(np.float32).T
    return out


def added(x: np.ndarray, q: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows ``q`` of x and ``c`` of y; one dimension after the other, as a plain loop adds them up."""
    total = np.zeros(len(q))
    for d in range(x.shape[1]):
        total += (x[q, d] - y[c, d]) ** 2
    return np.sqrt(total)


def distances(x: np.ndarray, q: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """As ``added``; a pair whose squares overflow or vanish is computed again at the power of two of its largest component."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = added(x, q, y, c)
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-145))
        for k in range(0, len(odd), 512):
            some = odd[k : k + 512]
            u, v, every = x[q[some]], y[c[some]], np.arange(len(some))
            power = np.frexp(np.maximum(np.abs(u).max(1), np.abs(v).max(1)))[1]
            out[some] = np.ldexp(added(np.ldexp(u, -power[:, None]), every, np.ldexp(v, -power[:, None]), every), power)
    return out


def near(queries: np.ndarray, candidates: np.ndarray, k: int, own: np.ndarray, names: np.ndarray) -> list[tuple[int, int, float]]:
    """(query, candidate, distance) of each query's k nearest in the tile; ``own`` is its own place or -1."""
    power = -int(np.frexp(max(np.abs(queries).max(), np.abs(candidates).max()))[1])
    a, sa, ea = quantised(np.ldexp(queries, power))
    b, sb, eb = quantised(np.ldexp(candidates, power))
    na, nb = (a.astype(np.float64) ** 2).sum(1) * sa**2, (b.astype(np.float64) ** 2).sum(1) * sb**2
    out = []
    for at in range(0, len(a), 256):
        part = slice(at, at + 256)
        rough = np.sqrt(np.maximum(0, na[part, None] + nb - 2 * products(a[part], b) * sa[part, None] * sb))
        # the difference of large squares is rounded, and what is far below 1 vanishes; both stay below these shares
        slack = ea[part, None] + eb + 1e-7 * (np.sqrt(na[part, None]) + np.sqrt(nb)) + 1e-150
        low, high = rough - slack, rough + slack
        held = np.flatnonzero(own[part] >= 0)
        high[held, own[part][held]] = np.inf
        limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(high), np.inf)
        asked = low <= limit[:, None]
        asked[held, own[part][held]] = False
        q, c = np.nonzero(asked)
        exact = distances(queries[part], q, candidates, c)
        order = np.lexsort((c, names[c], exact, q))
        q, c, exact = q[order], c[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < k
        out += zip((at + q[best]).tolist(), c[best].tolist(), exact[best].tolist())
    return out


def _tile(table: pa.Table, k: int) -> pa.Table:
    is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(table.num_rows, -1)
    row, name = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
    tile = table.column("tile")[0].as_py() if table.num_rows else 0
    qi, ci = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    found: list[tuple[int, int, float]] = []
    if len(qi) and len(ci):
        place = {r: i for i, r in enumerate(row[ci].tolist())}
        own = np.array([place.get(r, -1) for r in row[qi].tolist()])
        found = near(x[qi], x[ci], k, own, name[ci])
    q, c, d = (np.array([f[i] for f in found], dtype=t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    at, to = (qi[q], ci[c]) if found else (q, c)
    columns = [pa.array(v) for v in (row[at], name[at], np.full(len(at), tile, np.int64), name[to], row[to], d)]
    return pa.table(columns, names=["query_row", "query_id", "tile", "vec_id", "row", "score"])


def _merge(table: pa.Table, k: int) -> pa.Table:
    """The k nearest of a query's heaps."""
    rows = zip(*(table.column(c).to_pylist() for c in ("score", "vec_id", "row")))
    best = heapq.nsmallest(k, rows)
    first = {c: table.column(c)[0].as_py() for c in ("query_row", "query_id", "tile")}
    made = [[first[c]] * len(best) for c in ("query_row", "query_id", "tile")] + [[b[1] for b in best], [b[2] for b in best], [b[0] for b in best]]
    return pa.table([pa.array(v, pa.float64() if i == 5 else pa.int64()) for i, v in enumerate(made)], names=["query_row", "query_id", "tile", "vec_id", "row", "score"])


def tiling(dims: DataFrame, tile_candidates: int, tile_queries: int, tasks: int, tile_components: int) -> DataFrame:
    """Into how many stripes of candidates and belts of queries the vectors of each length are dealt. dims: dim, n, n_queries."""
    fit = F.greatest(F.lit(1), F.floor(F.lit(tile_components) / F.col("dim")))
    parts = lambda n, most: F.ceil(F.col(n) / F.least(F.lit(most), fit))
    wide = F.least(F.lit(tasks), F.ceil(F.col("n") / 1024))
    return dims.withColumns({"stripes": F.greatest(F.lit(1), parts("n", tile_candidates), wide).cast("bigint"), "belts": F.greatest(F.lit(1), parts("n_queries", tile_queries)).cast("bigint")})


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", tile_candidates: int = TILE_CANDIDATES, tile_queries: int = TILE_QUERIES, tile_components: int = TILE_COMPONENTS) -> DataFrame:
    """Queries are the rows whose id ``every`` divides; returns query_id, rank (from 1), vec_id and score."""
    part = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].alias("vector"))
    part = part.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = staged(part.select("vec_id", "vector", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("n_queries"))
    dims = staged(tiling(dims, tile_candidates, tile_queries, spread(vectors.sparkSession), tile_components), "dims")
    total, stripes = dims.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("stripes"), F.lit(1))).first()
    rows = joined_by_count(rows, dims.select("dim", "n", "stripes", "belts"), "dim", "n", total)
    stripe, belt = F.pmod(F.xxhash64("row"), F.col("stripes")), F.pmod(F.xxhash64("row", F.lit(1)), F.col("belts"))
    series = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    here = rows.withColumns({"stripe": stripe, "is_query": F.lit(False)}).withColumn("belt", series("belts"))
    asked = rows.where(F.col("vec_id") % every == 0).withColumns({"belt": belt, "is_query": F.lit(True)}).withColumn("stripe", series("stripes"))
    tiles = here.unionByName(asked).drop("n", "stripes", "belts").withColumn("tile", F.col("stripe"))
    heaps = tiles.groupBy("dim", "belt", "stripe").applyInArrow(lambda t: _tile(t, k), HEAP)
    left = stripes
    while left > 1:
        heaps = heaps.withColumn("tile", F.floor(F.col("tile") / MERGED)).groupBy("query_row", "tile").applyInArrow(lambda t: _merge(t, k), HEAP)
        left = math.ceil(left / MERGED)
    flat = heaps.groupBy("query_row", "query_id").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "row"))).alias("best"))
    return flat.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


SQL = """
with v as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, c.r as cr, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, x: a + x)) as score
      from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
p as (select *, row_number() over (partition by r order by score, vec_id, cr)::int as rank from s)
select query_id, rank, vec_id, score from p where rank <= 10
"""

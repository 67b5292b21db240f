"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

Texts are lower-cased in A-Z and cut into words at ASCII white space; a document's set is its distinct
shingles of ``words`` words (all its words, if they are fewer; nothing without words). Documents of one set are
a class, and each class is treated once, however many copies it has. Classes that share a band of minima meet in a bucket:

1. each member is paired with the bucket's least member; pairs whose signatures agree too little go, the others are confirmed on
   their full sets; the links are joined to components by alternating large-star and small-star;
2. in a bucket whose other members fall in several components, all members outside its largest component meet
   all members in tiles of bounded bytes, and only links come out. In a tile a pair is compared on its full sets only if both sets hold
   one of the shingles that each has rarest in the tile, a fifth of its set: two sets of similarity 0.8 always do. So no link of two
   classes that share a bucket is lost, no list of pairs is made within a group, and what many members share causes no comparisons.

With 24 bands of 4 minima a pair at similarity 0.8 shares no bucket with a probability of 3e-6, and agrees in under
60 % of 96 minima with one of 1e-6.

Null and empty texts have an empty set, link with nothing, and are their own component. A null id doesn't count for the smallest id
of a component. Repeated rows are copies. An empty table gives an empty result; other columns are kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondine.llm._common import joined_by_count, released, staged

BANDS, ROWS = 24, 4
#: Share of agreeing minima under which a pair is not confirmed on its sets.
LEAST_AGREEMENT = 0.6
#: Bytes of the sets on each side of a tile of a bucket that is compared whole; one set may be larger.
TILE_BYTES = 4 << 20
MIX, ONE_MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def coefficients(count: int = BANDS * ROWS, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the hashes a * x + b modulo 2**64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. bytes.lower and bytes.split know ASCII alone."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.array([*map(xxhash.xxh3_64_intdigest, parts)], np.uint64)
    words = min(words, len(h))
    n = len(h) - words + 1
    s = np.full(n, words, np.uint64)
    for j in range(words):
        s = s * MIX + h[j : j + n]
        s ^= s >> ONE_MORE
    return np.unique(s)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = (s[:4096, None] * a + b).min(0)
    for k in range(4096, len(s), 4096):
        np.minimum(least, (s[k : k + 4096, None] * a + b).min(0), out=least)
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        s = (s ^ column) * MIX
        s ^= s >> ONE_MORE
    return s


def _sketched(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, digest of the text, set size, digest of the set, its bands' hashes and its signature in 32-bit pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bands * rows)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                n, prints, hashes, signs = [], [], [], []
                for text in some.column(2):
                    s = shingles(text.as_py(), words)
                    n.append(len(s))
                    prints.append(hashlib.blake2b(s.data, digest_size=16).digest())
                    least = signature(s, a, b) if len(s) else None
                    hashes.append(None if least is None else band_hashes(least, bands, rows).view(np.int64))
                    signs.append(None if least is None else (least >> np.uint64(32)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(signs, pa.binary())], ["id", "key", "n", "fp", "bands", "sign"])

    text = docs[text_col].cast("string").cast("binary")
    part = docs.select(docs[id_col].cast("bigint").alias("id"), F.md5(text).alias("key"), text.alias("text"))
    return part.mapInArrow(run, "id bigint, key string, n bigint, fp binary, bands array<bigint>, sign binary")


def _sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """fp and set (bytes) of the needed classes, each from the text of one of its rows. needed: fp, id, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                sets = [shingles(t.as_py(), words).tobytes() for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], ["fp", "members"])

    text = docs[text_col].cast("string").cast("binary")
    rows = docs.select(docs[id_col].cast("bigint").alias("__id"), F.md5(text).alias("__key"), text.alias("text"))
    found = rows.join(needed, (F.col("__key") == F.col("key")) & F.col("__id").eqNullSafe(F.col("id"))).select("fp", "text")
    return found.mapInArrow(run, "fp binary, members binary").dropDuplicates(["fp"])


def _agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in (2, 3))
        keep = (a == b).mean(1) >= least if batch.num_rows else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        keep = [linked(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), percent) for p, q in zip(x, y)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def prefixes(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set its rarest shingles among all of ``sets``, as many as two linked sets can't both do without; with the numbers of their sets.

    Linked sets share at least percent / 100 of either, so the first n - ceil(n * percent / 100) + 1 of both, in one
    order of all shingles, hold one in common.
    """
    sizes = np.array([len(s) for s in sets])
    owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    names, at, times = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((names[at], times[at], owner))
    place = np.arange(len(every)) - np.repeat(sizes.cumsum() - sizes, sizes)
    first = place < np.repeat(sizes - -(-sizes * percent // 100) + 1, sizes)
    return every[order][first], owner[order][first]


def _tile(table: pa.Table, percent: int) -> pa.Table:
    """Links between the tile's outside members and its members of other components; one link into each other component is enough."""
    is_out = table.column("outside").to_numpy(zero_copy_only=False).astype(bool)
    outside, inside = np.flatnonzero(is_out), np.flatnonzero(~is_out)
    links: list[tuple[int, int]] = []
    if len(outside) and len(inside):
        _, comps = np.unique(np.array([c.hex() for c in table.column("comp").to_pylist()]), return_inverse=True)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("members").to_pylist()]
        keys, owner = prefixes(sets, percent)
        asked = is_out[owner]
        there, of = keys[~asked], owner[~asked]
        order = np.argsort(there, kind="stable")
        there, of = there[order], of[order]
        low, high = np.searchsorted(there, keys[asked]), np.searchsorted(there, keys[asked], "right")
        who, starts = owner[asked], np.cumsum([0, *np.bincount(np.searchsorted(outside, owner[asked]), minlength=len(outside))])
        by = np.argsort(who, kind="stable")
        for k, i in enumerate(outside.tolist()):
            mine = by[starts[k] : starts[k + 1]]
            met = np.unique(np.concatenate([of[a:b] for a, b in zip(low[mine], high[mine])])) if len(mine) else mine
            done = {comps[i]}
            for j in met.tolist():
                if comps[j] not in done and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])) and linked(sets[i], sets[j], percent):
                    done.add(comps[j])
                    links.append((i, j))
    fps = table.column("fp")
    a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
    return pa.table([fps.take(a).combine_chunks(), fps.take(b).combine_chunks()], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Per node of the links (a, b): node and comp, the least node it reaches, by alternating large-star and small-star.

    Every round is staged and the one before released; the rounds end when the edges stay the same. Both steps take the least neighbour by sums on the
    map side and a join that treats nodes of very many edges apart, so such a node is no group in one task.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == seen:
            break
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined_by_count(both, least, "u", "n", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # after large-star a node has few edges downwards but where it links many components
        small = joined_by_count(large, least, "u", "n", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        released(edges, large)
        edges = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def groups(docs: DataFrame, words: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: ``id``, ``key`` (md5 of the text), ``n`` (set size), ``component`` (least id) and ``first`` (id and key of the row that stays; a null id only where no other is there)."""
    base = staged(_sketched(docs, id_col, text_col, words, bands, rows), "sketches")
    classes = base.where("n > 0").groupBy("fp").agg(F.min(F.struct("id", "key")).alias("one"), F.first("sign").alias("sign"))
    met = base.where("n > 0").select("fp", F.explode("bands").alias("bucket")).distinct()
    buckets = met.groupBy("bucket").agg(F.count("*").alias("size"), F.min("fp").alias("leader"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("mark")).where("size > 1")
    # buckets of the same members count once
    buckets = buckets.groupBy("size", "leader", "mark").agg(F.min("bucket").alias("bucket")).drop("mark")
    live = staged(met.join(buckets, "bucket"), "buckets")

    pairs = live.where("fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct()
    signs = classes.select("fp", "sign")
    signed = pairs.join(signs.withColumnsRenamed({"fp": "a", "sign": "x"}), "a").join(signs.withColumnsRenamed({"fp": "b", "sign": "y"}), "b")
    near = staged(signed.select("a", "b", "x", "y").mapInArrow(lambda it: _agreeing(it, LEAST_AGREEMENT), "a binary, b binary"), "near")
    wanted = near.select(F.col("a").alias("fp")).union(near.select("b")).union(live.where("size > 2").select("fp")).distinct()
    needed = wanted.join(classes, "fp").select("fp", "one.*")
    sets = staged(_sets(docs, needed, id_col, text_col, words), "sets")
    held = near.join(sets.withColumnsRenamed({"fp": "a", "members": "x"}), "a").join(sets.withColumnsRenamed({"fp": "b", "members": "y"}), "b")
    links = held.select("a", "b", "x", "y").mapInArrow(lambda it: _confirmed(it, percent), "a binary, b binary")
    comps = staged(components(links), "components")

    wide = live.where("size > 2").select("bucket", "fp", "leader").join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    parts = wide.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.count_if(F.col("fp") != F.col("leader")).alias("others"))
    mixed = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count_if(F.col("others") > 0).alias("k")).where("k > 1").drop("k")
    open_ = staged(wide.join(mixed, "bucket").select("bucket", "fp", "comp", "main").join(sets, "fp"), "open")
    held = F.octet_length("members")
    sums = open_.groupBy("bucket").agg(F.sum(held).alias("all"), F.sum(F.when(F.col("comp") != F.col("main"), held).otherwise(0)).alias("out"))
    open_kept, open_ = open_, open_.join(sums, "bucket")
    belts, stripes = F.ceil(F.col("out") / TILE_BYTES), F.ceil(F.col("all") / TILE_BYTES)
    dealt = lambda count, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    asked = open_.where("comp <> main").select("bucket", "fp", "comp", "members", dealt(belts, 1).alias("i"), every(stripes).alias("j"), F.lit(True).alias("outside"))
    there = open_.select("bucket", "fp", "comp", "members", every(belts).alias("i"), dealt(stripes, 2).alias("j"), F.lit(False).alias("outside"))
    # dealt anew: the join before it would leave all tiles of a bucket in one task
    more = asked.unionByName(there).repartition("bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(lambda t: _tile(t, percent), "a binary, b binary")
    more = staged(more, "more-links")
    label = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"comp_{name}"))
    between = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    joined = components(between)

    # rows without a shingle are left out of the joins, where they would share one key
    first = base.where("n > 0").select("id", "key", "n", "fp").join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("comp", "fp")).drop("comp")
    named = first.join(joined.withColumnRenamed("node", "c"), "c", "left").select("id", "key", "n", F.coalesce("comp", "c").alias("group"))
    named = staged(named, "grouped")
    alone = staged(base.where("n = 0").select("id", "key", "n"), "empty-sets")
    least = named.groupBy("group").agg(F.min("id").alias("component"), F.min_by(F.struct("id", "key"), F.struct(F.isnull("id"), "id", "key")).alias("first"), F.count("*").alias("rows"))
    out = joined_by_count(named, least, "group", "rows", named.count())
    released(base, live, near, sets, comps, open_kept, more)
    return out.select("id", "key", "n", "component", "first").unionByName(alone.select("id", "key", "n", F.col("id").alias("component"), F.lit(None).cast(out.schema["first"].dataType).alias("first")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` and ``kept`` (it has its component's least id)."""
    found = groups(docs, words, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the least id stays.

    Rows with an empty set all stay. Of rows that agree in id and text one stays.
    """
    found = groups(docs, words, percent, id_col, text_col)
    gone = found.where((F.col("n") > 0) & ~F.struct("id", "key").eqNullSafe(F.col("first"))).select(F.col("id").alias("__id"), F.col("key").alias("__k")).distinct()
    twice = found.where("n > 0").groupBy("id", "key").agg(F.count("*").alias("__times")).where("__times > 1").select(F.col("id").alias("__twin"), F.col("key").alias("__tk"))
    key = F.md5(docs[text_col].cast("string").cast("binary"))
    left = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (key == gone["__k"]), "left_anti")
    repeated = left.join(twice, left[id_col].eqNullSafe(twice["__twin"]) & (key == twice["__tk"]), "left_semi")
    single = left.join(twice, left[id_col].eqNullSafe(twice["__twin"]) & (key == twice["__tk"]), "left_anti")
    return single.unionByName(repeated.dropDuplicates([id_col, text_col]))

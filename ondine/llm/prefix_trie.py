"""The prefix trie of conversations: which turns they share from their start.

A node is a distinct sequence of first turns. It is owned by the least conversation that starts with it, so the depths that a conversation owns
reach from its first owned one to its end, and these chains are the tree.

1. Turns are numbered, and a running sum of hashes of (depth, role, text) gives each prefix a digest: by ranges over all rows, so
   a conversation may be of any length. Texts are read once and leave their digest and length alone.
2. Digests are summed up to minima: the owner of each node and how many conversations start with it.
3. Each conversation's first owned depth is found by binary search: a round looks up one digest of each conversation in the minima, all in one
   join, and the last owner that was not the conversation itself is its chain's parent.
4. Chains are added up from below by doubling: a round adds to each chain what the chains below it have, and points twice as far up, so chains
   that hang below each other take as many rounds as their number has bits. What hangs at a node and what follows in its chain is summed along the chain.

Keys that hold a large share of the rows (the digest of a widely used opening, a very long conversation, a parent of many) are joined by broadcast of
at most 256 of them, the others by shuffles; sums start on the map side. The hash of the ids that end at a node reads them in
order, in pieces, so a task holds one piece at a time.

``rebuilt`` gives a conversation the start of another, as the query asks; ``trie`` takes any conversations. Turns are ordered by turn, null first, and
ties by a digest of role and text, so repeated rows are turns of their own. Null roles and texts are empty. Rows with a null conv_id take no part. A
conversation without turns is a member of the root alone. Without rows there are no nodes. Other columns are not read.

Digests of prefixes are sums of two 64-bit hashes of 128-bit digests; two different ones of 10**12 prefixes agree with a probability below 10**-14.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondine.llm._common import joined_by_count, prefix_sums, released, staged

#: Conversations of a hundred share the opening of their first, of at most this many turns less one.
OPENINGS, HUNDRED = 6, 100
#: Ids of a piece of the text that is hashed for the ends of a node.
PIECE = 4096


def _key(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, depth (from 1, in the order of turns), key (digest of role and text) and size (code points) of each turn."""
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    role = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    part = turns.select(turns[conv_col].cast("bigint").alias("conv"), turns[turn_col].alias("turn"), _key(role, text).alias("key"), F.length(text).cast("bigint").alias("size"), F.lit(1).alias("one"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("key")]
    return prefix_sums(part.where(F.col("conv").isNotNull()), order, {"depth": "one"}, within="conv", label="turns").select("conv", "depth", "key", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of which each conversation c starts with the first crc32(c) % 6 of conversation c - c % 100, and the lengths of all."""
    total = turns.count()
    lengths = turns.groupBy("conv").agg(F.max("depth").alias("own"))
    convs = lengths.withColumns({"base": F.col("conv") - F.col("conv") % HUNDRED, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS})
    bases = lengths.where(F.col("conv") % HUNDRED == 0).select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = staged(convs.select("conv", "base", "own", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    # a base has at most 5 turns here, and at most 199 conversations take them
    openings = turns.where((F.col("conv") % HUNDRED == 0) & (F.col("depth") < OPENINGS)).withColumnRenamed("conv", "base")
    given = convs.select("conv", "base", "taken").join(openings, "base").where("depth <= taken").select("conv", "depth", "key", "size")
    own = joined_by_count(turns, convs.select("conv", "own", "h", "taken"), "conv", "own", total).where("depth > h")
    own = own.select("conv", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "key", "size")
    return given.unionByName(own), convs.select("conv", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, node (digest of the turns up to this one) and size of its last turn."""
    halves = {f"t{k}": F.xxhash64(F.lit(k), "depth", "key").cast("decimal(20,0)") for k in (1, 2)}
    summed = prefix_sums(turns.withColumns(halves), [F.asc("conv"), F.asc("depth")], {"s1": "t1", "s2": "t2"}, within="conv", label="prefixes")
    node = F.unhex(F.md5(F.concat_ws(":", "depth", "s1", "s2")))
    return summed.select("conv", "depth", node.alias("node"), "size")


def first_owned(prefixes: DataFrame, minima: DataFrame, ends: DataFrame, total: int) -> DataFrame:
    """Per conversation that owns its whole length: conv, top (the first depth that it owns, from 1), length and parent (owner of the depth before; null at 1).

    minima: node, owner and n (rows of prefixes that hold it). ends: conv, length and the node at its end. total: rows of prefixes.
    """
    known = lambda probes: joined_by_count(probes, minima.select("node", "owner", "n"), "node", "n", total)
    state = staged(known(ends).where("owner = conv").select("conv", "length", F.lit(1).cast("bigint").alias("low"), F.col("length").alias("high"), F.lit(None).cast("bigint").alias("parent")), "search")
    while not state.where("low < high").isEmpty():
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        probes = state.where("low < high").select("conv", middle.alias("depth")).join(prefixes.select("conv", "depth", "node"), ["conv", "depth"])
        told = known(probes).select("conv", "depth", "owner")
        mine = F.col("owner") == F.col("conv")
        after = state.join(told, "conv", "left").select(
            "conv", "length",
            F.when(~mine, F.col("depth") + 1).otherwise(F.col("low")).alias("low"),
            F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"),
            F.when(~mine, F.col("owner")).otherwise(F.col("parent")).alias("parent"),
        )
        before, state = state, staged(after, "search")
        released(before)
    return state.select("conv", F.col("low").alias("top"), "length", "parent")


def from_below(chains: DataFrame, values: list[str]) -> DataFrame:
    """conv and its ``values``, each summed over the chain itself and all chains below it. chains: conv, parent (null at the root), values.

    In round k each chain knows the sums over chains less than 2**k below it and the chain 2**k above.
    """
    state = staged(chains.select("conv", F.col("parent").alias("up"), *values), "chains")
    while not (waiting := state.where("up is not null")).isEmpty():
        below = waiting.groupBy("up").agg(F.count("*").alias("n"), *[F.sum(v).alias(f"more_{v}") for v in values])
        # where each chain points after this round; a chain that many point at is broadcast
        further = below.select("up", "n").join(state.select(F.col("conv").alias("up"), F.col("up").alias("next")), "up")
        moved = joined_by_count(waiting.select("conv", "up"), further, "up", "n", waiting.count()).select("conv", "next")
        gained = state.drop("up").join(below.withColumnRenamed("up", "conv").drop("n"), "conv", "left").join(moved, "conv", "left")
        before, state = state, staged(gained.select("conv", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), "chains")
        released(before)
    return state.select("conv", *values)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv): pieces of at most PIECE ids of one node as text: node, first (id), ids."""
    node, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "first", "ids"])

    for batch in batches:
        for other, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (other != node or len(ids) == PIECE):
                yield piece()
                ids = []
            node = other
            ids.append(conv)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces: node and the sha256 of its ids with commas between."""
    node, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for other, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if state is not None and other == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((node, state.hexdigest()))
            node, state = other, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """node and ends: sha256 of the ascending ids of the conversations that end there. ends: node, conv.

    Ids are dealt by ranges, so one node's may fill many tasks, and only pieces of its text meet in the task that hashes it.
    """
    ranged = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    pieces = ranged.mapInArrow(_joined, "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of conversations, under the query's names. turns: conv, depth, key, size; lengths: conv, length (0 without turns)."""
    spark = turns.sparkSession
    least, count = lengths.agg(F.min("conv"), F.count("*")).first()
    at_root = lengths.where(F.col("conv") == least).select("conv", F.lit(0).cast("bigint").alias("top"), "length", F.lit(None).cast("bigint").alias("parent"))
    root = spark.createDataFrame([] if least is None else [(b"", least, 0, count, 0)], "node binary, owner bigint, depth bigint, n bigint, saved bigint")
    prefixes = staged(_prefixes(turns), "prefixes")
    total = prefixes.count()
    minima = staged(prefixes.groupBy("node").agg(F.min("conv").alias("owner"), F.max("depth").alias("depth"), F.count("*").alias("n"), F.max("size").alias("size")), "minima")
    ends = lengths.where("length > 0").join(prefixes.select("conv", F.col("depth").alias("length"), "node"), ["conv", "length"])
    ends = staged(ends.unionByName(lengths.where("length = 0").withColumn("node", F.lit(b""))), "ends")

    # chains: the root is the start of the least conversation's
    found = first_owned(prefixes, minima, ends.where("length > 0"), total)
    chains = staged(found.where(F.col("conv") != least).withColumn("parent", F.coalesce("parent", F.lit(least))).unionByName(at_root), "chains")
    nodes = minima.select("node", "owner", "depth", "n", ((F.col("n") - 1) * F.col("size")).alias("saved")).unionByName(root)
    hung = chains.where("parent is not null").select("conv", F.col("parent").alias("owner"), (F.col("top") - 1).alias("depth"))
    ended = hung.groupBy(F.col("owner").alias("conv"), F.col("depth").alias("length")).agg(F.lit(False).alias("leaf"))
    saved = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum("saved").alias("saved"))
    own = chains.join(ended, ["conv", "length"], "left").join(saved, "conv").select("conv", "parent", F.when(F.col("leaf").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"), "saved")
    below = hung.join(from_below(own, ["leaves", "saved"]), "conv").groupBy("owner", "depth").agg(F.count("*").alias("chains"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))

    # nodes: what hangs at them and what follows in their chain, summed from the chain's end
    each = nodes.join(below, ["owner", "depth"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chains", "hung_leaves", "hung_saved")})
    own = chains.select(F.col("conv").alias("owner"), "top", "length", "parent", (F.col("length") - F.col("top") + 1).alias("held"))
    last = F.col("depth") == F.col("length")
    each = joined_by_count(each, own, "owner", "held", total + 1).select(
        "node", "owner", "depth", "n",
        F.when(F.col("depth") > F.col("top"), F.col("owner")).otherwise(F.col("parent")).alias("above"),
        (F.col("chains") + F.when(last, 0).otherwise(1)).alias("n_children"),
        (F.col("hung_leaves") + F.when(last & (F.col("chains") == 0), 1).otherwise(0)).alias("leaf"),
        (F.col("hung_saved") + F.col("saved")).alias("gain"),
        (-F.col("depth")).alias("back"),
    )
    each = prefix_sums(each, [F.asc("owner"), F.asc("back")], {"n_leaves": "leaf", "saved_tokens": "gain"}, within="owner", label="nodes")
    each = each.join(ends_hashes(ends), "node", "left")
    return each.select(
        F.col("owner").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: The crc32 of column x, byte by byte and bit by bit.
CRC = """xor(4294967295, list_reduce([4294967295] || flatten(list_transform(range(1, length(x::varchar) + 1), lambda i: [ascii(substr(x::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end))"""
#: The same from all prefixes of all conversations, and each node with all those above it.
SQL = f"""
with t as (select conv_id as x, md5(concat(length(coalesce(role, ''))::varchar, ':', coalesce(role, ''), coalesce(text, ''))) as key, length(coalesce(text, ''))::bigint as size, turn from conversations where conv_id is not null),
l as (select x, list(key order by turn nulls first, key) as keys, list(size order by turn nulls first, key) as sizes from t group by x),
h as (select x, keys, sizes, x - x % 100 as base, ({CRC}) % 6 as h from l),
r as (select h.x as c, list_concat(coalesce(l.keys, [])[1:h.h], h.keys[h.h + 1:]) as keys, list_concat(coalesce(l.sizes, [])[1:h.h], h.sizes[h.h + 1:]) as sizes from h left join l on l.x = h.base),
p as (select c, d, array_to_string(keys[1:d], ',') as node, case when d > 0 then array_to_string(keys[1:d - 1], ',') end as above, case when d > 0 then sizes[d] else 0 end as size, d = len(keys) as ended
  from r, lateral (select unnest(range(0, len(keys) + 1)) as d)),
m as (select d, node, min(above) as above, min(c) as c, count(*) as n, (count(*) - 1) * max(size) as saved, coalesce(string_agg(c::varchar, ',' order by c) filter (ended), '') as ends from p group by d, node),
k as (select d - 1 as d, above as node, count(*) as children from m where d > 0 group by all),
f as (select m.*, coalesce(children, 0) as children from m left join k using (d, node)),
s as (select p.d, p.node, count(*) filter (children = 0) as leaves, sum(f.saved)::bigint as saved from f join p on p.c = f.c and p.d <= f.d group by all)
select f.c as conv_id, f.d as depth, u.c as parent_conv_id, f.n as n_convs, f.children as n_children, s.leaves as n_leaves, s.saved as saved_tokens, sha256(f.ends) as ends_sha256
from f join s using (d, node) left join m u on u.d = f.d - 1 and u.node = f.above
"""

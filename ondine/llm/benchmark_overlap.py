"""Benchmark decontamination by a prefix-filtered set join.

Texts are lower-cased in A-Z and cut into words (runs of ASCII letters and digits and of everything beyond ASCII). A window is
``size`` consecutive words of an item; an item of fewer words, but not none, is one window. A document word is hit where a window
occurs around it, word by word.

1. A table of bits, of a set size, marks the hashes of the items' shingles (five words; a shorter window is one shingle). One pass over
   the documents keeps, of each text, the stretches whose shingles are all marked, if they are as long as a window. Every window
   that occurs stands within a stretch; what stretches hold besides does no harm, as all that follows compares words.
2. The shingles of the stretches of all documents are counted. A window that occurs has all of its shingles there, so its rarest one, the
   prefix that exact containment needs, must stand where it occurs; windows of which a shingle is absent go.
3. Shingles of stretches meet windows by these prefixes; a window's place follows from the place of its prefix (positional bound) and must lie within
   the stretch (length bound); the words there are compared with the window's.

What windows hold is broadcast up to ``BROADCAST_BYTES``, as measured, and shuffled beyond; no other table is. Hits are grouped by document, of which
each place is the start of at most ``size`` windows of different lengths.

Null and empty texts have no words and no hits, null and empty items no windows. A document with a null id counts like any other, and so does each
repeated row. An item with a null id marks words but is not counted or listed; rows of one item id are one item. No items: no
hits. No documents: no rows. Other columns are not read, but ``clean`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondine.llm._common import released, staged

SHINGLE = 5
#: The table of marked shingles has two to the power of this many bits (4 MB).
FILTER_BITS = 25
#: Windows are broadcast up to this size.
BROADCAST_BYTES = 32 << 20
#: Words of a stretch that one record holds; longer ones come in several, which overlap by a window.
STRETCH = 4096
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIX, ONE_MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)
#: Bytes as words hold them, and a space for those that no word holds.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

PARTS = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))]))


def cut(text: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    clean, at = (text or b"").translate(BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + piece)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def word_hashes(text: bytes | None, piece: int = PIECE) -> np.ndarray:
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in cut(text, piece)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def bits_of(hashes: np.ndarray, k: int, bits: int = FILTER_BITS) -> np.ndarray:
    """Which bit stands for each shingle of k words."""
    n = max(0, len(hashes) - k + 1)
    s = np.full(n, k, np.uint64)
    for j in range(k):
        s = s * MIX + hashes[j : j + n]
        s ^= s >> ONE_MORE
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def stretches(hashes: np.ndarray, marks: np.ndarray, lengths: list[int], size: int, longest: int = STRETCH) -> list[tuple[int, int, int]]:
    """(shingle, start, end) of the runs of marked shingles that can hold a window of one of these lengths."""
    out = []
    for k in sorted({min(SHINGLE, w) for w in lengths}):
        least = min(w for w in lengths if min(SHINGLE, w) == k)
        places = bits_of(hashes, k)
        marked = np.zeros(len(places) + 2, np.int8)
        marked[1:-1] = (marks[places >> 3] >> (places & 7).astype(np.uint8)) & 1
        turns = np.flatnonzero(np.diff(marked))
        for a, b in zip(turns[::2].tolist(), (turns[1::2] + k - 1).tolist()):
            if b - a >= least:
                out += [(k, s, min(b, s + longest)) for s in range(a, max(a + 1, b - size + 1), longest - size + 1)]
    return out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: window (words with a space between), w (how many), k (words of its shingles), ids (as strings, of the items that hold it)."""
    words = items.select(items[id_col].cast("string").alias("id"), _words(items[text_col]).alias("words")).where(F.size("words") > 0)
    places = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))).alias("i")
    each = words.select("id", "words", places).select("id", F.slice("words", F.col("i"), F.lit(size)).alias("part"))
    each = each.select("id", F.array_join("part", " ").alias("window"), F.size("part").alias("w"))
    return each.groupBy("window", "w").agg(F.collect_set("id").alias("ids")).withColumn("k", F.least("w", F.lit(SHINGLE)))


def marked(items: DataFrame, size: int, text_col: str) -> bytes:
    """The bits of all shingles of the items, as a table of a set size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                h = word_hashes(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(bits_of(h, min(SHINGLE, size, len(h)))) if len(h) else [], pa.int64())], ["bit"])

    bits = items.select(items[text_col].cast("string").cast("binary").alias("text")).mapInArrow(run, "bit bigint")
    numbered = F.col("bit") + 1  # bitmaps count from 1
    found = bits.groupBy(F.bitmap_bucket_number(numbered).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(numbered)).alias("bits"))
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for bucket, part in found.collect():  # at most 2**FILTER_BITS bits
        at = (bucket - 1) * 4096
        table[at : at + 4096] = np.frombuffer(part, np.uint8)
    return table.tobytes()


def _kept(docs: DataFrame, id_col: str, text_col: str, table: bytes, lengths: list[int], size: int) -> DataFrame:
    """row, id, n_words and stretches of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    part = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                counts, found = [], []
                for cell in some.column(2):
                    text = cell.as_py()
                    hashes = word_hashes(text)
                    spans = stretches(hashes, marks, lengths, size)
                    counts.append(len(hashes))
                    found.append(_read(text, spans) if spans else [])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(counts, pa.int64()), pa.array(found, kind)], ["row", "id", "n_words", "stretches"])

    return part.mapInArrow(run, T.StructType([*part.schema.fields[:2], T.StructField("n_words", T.LongType()), T.StructField("stretches", PARTS)]))


def _read(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    """The words of these stretches, read in one walk over the text."""
    held: list[list[bytes]] = [[] for _ in spans]
    before = 0
    for words in cut(text):
        for i, (_, a, b) in enumerate(spans):
            if a < before + len(words) and b > before:
                held[i] += words[max(0, a - before) : b - before]
        before += len(words)
    return [{"k": k, "start": a, "words": [w.decode() for w in own]} for (k, a, _), own in zip(spans, held)]


def _shingles(words: str, k: str, more: str = "") -> str:
    """SQL of an array with a struct for each shingle of ``words``: i (its place, from 0), shingle, and ``more``."""
    return f"transform(sequence(0, size({words}) - {k}), i -> named_struct('i', i, 'shingle', array_join(slice({words}, i + 1, {k}), ' '){more}))"


def prefixes(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest shingle (ties: the first by words) and that one's place in it; windows of which a shingle is nowhere go."""
    each = parts.withColumn("words", F.split("window", " ")).select("window", "w", "ids", F.inline(F.expr(_shingles("words", "k"))))
    known = each.join(counts, "shingle")
    best = known.groupBy("window").agg(F.first("w").alias("w"), F.first("ids").alias("ids"), F.min(F.struct("n", "shingle", "i")).alias("best"), F.count("*").alias("held"), F.first(F.col("w") - F.least("w", F.lit(SHINGLE)) + 1).alias("wanted"))
    return best.where("held = wanted").select(F.col("best.shingle").alias("shingle"), F.col("best.i").alias("offset"), "window", "w", "ids")


def overlaps(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: id_col, n_words, spans (start word and number of words of each occurrence of a window, by start) and items (ids of
    their items as strings, sorted)."""
    parts = staged(windows(items, size, item_id_col, item_text_col), "windows")
    lengths = [r.w for r in parts.select("w").distinct().collect()]  # at most ``size`` of them
    kept = staged(_kept(docs, id_col, text_col, marked(items, size, item_text_col), lengths, size), "stretches")
    place = F.explode("stretches").alias("s")
    each = kept.select(place).select(F.inline(F.expr(_shingles("s.words", "s.k"))))
    found = staged(prefixes(parts, each.groupBy("shingle").agg(F.count("*").alias("n"))), "prefixes")
    released(parts)
    held = found.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("shingle") + F.aggregate("ids", F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0))) + 64), F.lit(0))).first()[0]
    # words around the shingle, as far as a window reaches
    around = f"slice(s.words, greatest(i - {size}, 0) + 1, {2 * size} + s.k)"
    asked = kept.select("row", place).select("row", F.col("s.start").alias("start"), F.inline(F.expr(_shingles("s.words", "s.k", f", 'around', {around}"))))
    met = asked.join(F.broadcast(found) if held <= broadcast_bytes else found, "shingle")
    at = F.least("i", F.lit(size)) - F.col("offset")
    met = met.where((at >= 0) & (at + F.col("w") <= F.size("around")))
    hits = met.where(F.array_join(F.slice("around", at + 1, F.col("w")), " ") == F.col("window"))
    span = F.struct((F.col("start") + F.col("i") - F.col("offset")).alias("start"), F.col("w").cast("bigint").alias("words"))
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    none = {"spans": F.array().cast("array<struct<start:bigint,words:bigint>>"), "items": F.array().cast("array<string>")}
    clear = kept.where(F.size("stretches") == 0).select("row", "id", "n_words").withColumns(none)
    asked_for = kept.where(F.size("stretches") > 0).select("row", "id", "n_words").join(spans, "row", "left")
    every = clear.unionByName(asked_for.withColumns({c: F.coalesce(c, e) for c, e in none.items()}))
    return every.select(F.col("id").alias(id_col), "n_words", "spans", "items", "row")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``overlaps``: how many words are hit, how many items, which, and whether any."""
    end = lambda x: x["start"] + x["words"]
    nothing = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("hit"))
    step = lambda a, x: F.struct(F.greatest(a["end"], end(x)).alias("end"), (a["hit"] + F.greatest(F.lit(0).cast("bigint"), end(x) - F.greatest(a["end"], x["start"]))).alias("hit"))
    made = found.withColumn("n_hit", F.aggregate("spans", nothing, step)["hit"])
    return made.select(id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all of their columns, in which no window of an item occurs. Rows are told apart by the text's digest, so
    that ids may repeat."""
    key = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    named = docs.select(key.alias("__key"), docs[text_col].alias("__text"))
    found = overlaps(named, items, id_col="__key", text_col="__text", **how)
    hit = found.where(F.size("spans") > 0).select("__key").distinct()
    return docs.withColumn("__key", key).join(hit, "__key", "left_anti").drop("__key")


SQL = f"""
with iw as (select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as words from benchmark),
it as (select distinct item_id::varchar as item, array_to_string(words[i:i + 9], ' ') as part, least(len(words), 10) as w
  from iw, lateral (select unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i) where len(words) > 0),
d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) as words from documents),
dw as (select r, i, w, array_to_string(words[i:i + w - 1], ' ') as part from d, (select distinct w from it), lateral (select unnest(range(1, len(words) - w + 2)) as i)),
h as (select r, i, w, item from dw join it using (w, part)),
p as (select r, count(distinct j) as n_hit from h, lateral (select unnest(range(i, i + w)) as j) group by r),
s as (select r, count(item) as n_items, coalesce(string_agg(item, ',' order by item), '') as ids from (select distinct r, item from h) group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (r) left join s using (r)
"""

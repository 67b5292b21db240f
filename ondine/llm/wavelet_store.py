"""Token ids in wavelet-matrix shards.

A shard holds whole documents, in ascending order of their ids, up to a number of tokens. Its ids are mapped
to their ranks among the shard's distinct ids; of these ranks each bit, from the highest on, is a plane, and each plane
orders the ids for the next one: zeros first, both sides stable. With counts of ones at
every 512th place a plane answers rank and select, so a token, the count of an id before a
place and the k-th place of an id are read from the shard's bytes without decoding it. ``tokens_at``, ``counts``,
``occurrences`` and ``kth`` ask the stored table so; ``read`` decodes every document, and counts its end ids by rank.

Format, little-endian: ``b"WVM1"``, then as uint32 the numbers of tokens, documents, distinct ids and planes;
the distinct ids (uint32, ascending); the documents' lengths (uint32), ids (int64) and null flags (uint8); per plane the number of
zeros (uint32), the packed bits (first bit highest) and the ones before each 512th place (uint32).

Null texts count as empty: their document is the end id alone. Null ids come first. Repeated rows are stored repeatedly. An
empty table makes no shard. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ondine.llm._common import spread, staged

#: Tokens from which on a shard is full; it ends with the document that fills it.
SHARD_TOKENS = 1 << 20
#: Pieces that a worker's table holds before it starts anew, and the length from which on a piece is not kept.
TABLE_PIECES = 1_600_000
LONG = 200
BLOCK = 512


class WaveletMatrix:
    """Bit planes over the ranks of ids, with access, rank and select."""

    def __init__(self, alphabet: np.ndarray, n: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        self.alphabet, self.n, self.planes, self.zeros, self.ones = alphabet, n, planes, zeros, ones

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        if len(ids) and ids.max() < 1 << 20:
            alphabet = np.flatnonzero(np.bincount(ids)).astype(np.uint32)
            table = np.zeros(int(alphabet[-1]) + 1, np.uint32)
            table[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
            x = table[ids]
        else:
            alphabet, x = np.unique(ids, return_inverse=True)
        x = x.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        planes, zeros, ones = [], [], []
        for b in range(max(0, len(alphabet) - 1).bit_length() - 1, -1, -1):
            bits = (x >> b & 1).astype(bool)
            low = np.compress(~bits, x)
            x = np.concatenate([low, np.compress(bits, x)])
            plane = np.packbits(bits)
            planes.append(plane)
            zeros.append(len(low))
            ones.append(cls.counts(plane))
        return cls(alphabet.astype(np.uint32), len(ids), planes, zeros, ones)

    @staticmethod
    def counts(plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        full = np.zeros(-(-len(plane) * 8 // BLOCK) * BLOCK // 8, np.uint8)
        full[: len(plane)] = plane
        return np.concatenate([[0], np.bitwise_count(full).reshape(-1, BLOCK // 8).sum(1).cumsum()]).astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        block, plane = i // BLOCK, self.planes[level]
        part = plane[block * BLOCK // 8 : -(-i // 8)]
        inside = int(np.unpackbits(part)[: i - block * BLOCK].sum()) if len(part) else 0
        return int(self.ones[level][block]) + inside

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit, one = self._bit(k, i), self._rank1(k, i)
            value, i = value << 1 | bit, self.zeros[k] + one if bit else i - one
        return int(self.alphabet[value])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before place ``i``."""
        code = self._code(token)
        if code is None:
            return 0
        low, i = 0, min(max(i, 0), self.n)
        for k in range(len(self.planes)):
            a, b = self._rank1(k, low), self._rank1(k, i)
            low, i = (self.zeros[k] + a, self.zeros[k] + b) if code >> (len(self.planes) - 1 - k) & 1 else (low - a, i - b)
        return i - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, level: int, bit: int, k: int) -> int:
        ones = self.ones[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones), dtype=np.int64) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence (from 0) of ``token``."""
        code = self._code(token)
        if code is None or not 0 <= k < self.count(token):
            raise IndexError((token, k))
        low = 0
        for level in range(len(self.planes)):
            one = self._rank1(level, low)
            low = self.zeros[level] + one if code >> (len(self.planes) - 1 - level) & 1 else low - one
        i = low + k
        for level in reversed(range(len(self.planes))):
            bit = code >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] * bit)
        return i

    def _ranks1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, rest = at // BLOCK, at % BLOCK
        plane = np.zeros((self.n // BLOCK + 1) * (BLOCK // 8), np.uint8)
        plane[: len(self.planes[level])] = self.planes[level]
        place, edge = np.arange(BLOCK // 8), (rest // 8)[:, None]
        mask = np.where(place < edge, 0xFF, np.where(place == edge, (0xFF00 >> rest % 8)[:, None] & 0xFF, 0)).astype(np.uint8)
        return self.ones[level][block].astype(np.int64) + np.bitwise_count(plane.reshape(-1, BLOCK // 8)[block] & mask).sum(1, dtype=np.int64)

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The ids at many places."""
        at, value = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for k in range(len(self.planes)):
            bit = self.planes[k][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            one = self._ranks1(k, at)
            value, at = value << 1 | bit, np.where(bit, self.zeros[k] + one, at - one)
        return self.alphabet[value]

    def ranks(self, token: int, at: np.ndarray) -> np.ndarray:
        """How often ``token`` stands before each of many places."""
        code, at = self._code(token), np.asarray(at, np.int64)
        if code is None:
            return np.zeros(len(at), np.int64)
        low = np.zeros(1, np.int64)
        for k in range(len(self.planes)):
            a, b = self._ranks1(k, low), self._ranks1(k, at)
            low, at = (self.zeros[k] + a, self.zeros[k] + b) if code >> (len(self.planes) - 1 - k) & 1 else (low - a, at - b)
        return at - low

    def places(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending, by selecting upwards from the last plane."""
        n = self.count(token)
        if not n:
            return np.zeros(0, np.int64)
        code, low = self._code(token), 0
        for k in range(len(self.planes)):
            one = self._rank1(k, low)
            low = self.zeros[k] + one if code >> (len(self.planes) - 1 - k) & 1 else low - one
        at = np.arange(low, low + n)
        for k in reversed(range(len(self.planes))):
            bit = code >> (len(self.planes) - 1 - k) & 1
            at = np.flatnonzero(np.unpackbits(self.planes[k], count=self.n) == bit)[at - self.zeros[k] * bit]
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, from the last plane back to the first."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        x = np.zeros(self.n, kind)
        for k in reversed(range(len(self.planes))):
            mask = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~mask)] = x[: self.zeros[k]]
            up[np.flatnonzero(mask)] = x[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            x = up
        return self.alphabet[x] if self.n else np.zeros(0, np.uint32)


def to_bytes(matrix: WaveletMatrix, lengths: np.ndarray, names: list[int | None]) -> bytes:
    head = struct.pack("<4s4I", b"WVM1", matrix.n, len(lengths), len(matrix.alphabet), len(matrix.planes))
    null = np.array([x is None for x in names], np.uint8)
    out = [head, matrix.alphabet.astype("<u4").tobytes(), np.asarray(lengths, "<u4").tobytes(), np.array([x or 0 for x in names], "<i8").tobytes(), null.tobytes()]
    for plane, zeros, ones in zip(matrix.planes, matrix.zeros, matrix.ones):
        out += [struct.pack("<I", zeros), plane.tobytes(), ones.astype("<u4").tobytes()]
    return b"".join(out)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, np.ndarray, list[int | None]]:
    """The matrix, the documents' lengths and ids; arrays are views of ``data``."""
    magic, n, docs, sigma, levels = struct.unpack_from("<4s4I", data)
    if magic != b"WVM1":
        raise ValueError("no shard of this format")
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, kind, count, at)
        at += part.nbytes
        return part

    alphabet, lengths, names, null = take("<u4", sigma), take("<u4", docs), take("<i8", docs), take("u1", docs)
    planes, zeros, ones = [], [], []
    for _ in range(levels):
        zeros.append(int(take("<u4", 1)[0]))
        planes.append(take("u1", -(-n // 8)))
        ones.append(take("<u4", -(-len(planes[-1]) * 8 // BLOCK) + 1))
    return WaveletMatrix(alphabet, n, planes, zeros, ones), lengths, [None if z else int(x) for x, z in zip(names, null)]


class Pieces:
    """Encodes with the tokenizers library, each distinct piece of text once.

    A space before a character that is no white space always starts a pretoken, so a text may be cut
    there; a text with another white space (or its end) after a space, or with a
    special token's opening, is encoded whole. New pieces are encoded many in one string; there the tokens that begin with the
    space show where each piece starts.
    """

    def __init__(self, path: str, table_pieces: int = TABLE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        split, special = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if spec["normalizer"] or split.get("type") != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("not the byte-level pretokeniser that texts are cut for here")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # how byte-level vocabularies write a space
        self.table: dict[str, bytes] = {}  # by piece, without its space
        self.most = table_pieces
        self.marks = dict(zip(",.", self._fresh([",", "."])))
        self.whole = re.compile("|".join([r" (?:\s|\Z)", *(re.escape(t["content"][:2]) for t in special)]))

    def _fresh(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], at_once: int = 500) -> None:
        """Encodes new pieces. One of letters and a last comma or stop is two pretokens: its letters' and the mark's."""
        wide = self.kind().itemsize
        marked = [p for p in new if p[-1] in self.marks and p[:-1].isalpha()]
        whole = {p for p in new if not (p[-1] in self.marks and p[:-1].isalpha())}
        new = [*(whole | {p for p in (m[:-1] for m in marked) if p not in self.table})]
        for k in range(0, len(new), at_once):
            some = new[k : k + at_once]
            ids = self._fresh([" " + " ".join(some)])[0]
            starts = (np.flatnonzero(self.opens[np.frombuffer(ids, self.kind)]) * wide).tolist()
            if len(starts) != len(some):
                raise ValueError("a piece is no run of whole tokens; is the vocabulary byte-level?")
            self.table.update(zip(some, map(ids.__getitem__, map(slice, starts, [*starts[1:], len(ids)]))))
        self.table.update((p, self.table[p[:-1]] + self.marks[p[-1]]) for p in marked)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``kind``."""
        if len(self.table) > self.most:
            self.table.clear()
        get = self.table.get
        cut = [None if self.whole.search(t) else t.split(" ") for t in texts]
        heads = self._fresh([t if words is None else words[0] for t, words in zip(texts, cut)])
        found = [[] if words is None else [*map(get, words[1:])] for words in cut]
        gaps = [[i for i, v in enumerate(values) if v is None] for values in found]
        fresh = {words[i + 1] for words, missing in zip(cut, gaps) for i in missing}
        self._learn([*fresh])
        for words, values, missing in zip(cut, found, gaps):
            for i in missing:
                values[i] = self.table[words[i + 1]]
        for p in fresh:
            if len(p) >= LONG:
                self.table.pop(p, None)
                self.table.pop(p[:-1], None)
        return [head + b"".join(values) for head, values in zip(heads, found)]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _written(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    code, part = pieces(tokenizer), TaskContext.get().partitionId()
    end = np.array([end_id], code.kind).tobytes()
    names: list[int | None] = []
    held: list[bytes] = []
    seq = itertools.count()
    base = n = 0

    def shard() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(held), code.kind)
        lengths = np.array([len(x) // code.kind().itemsize for x in held], np.uint32)
        row = [[part], [next(seq)], [base], [len(ids)], [to_bytes(WaveletMatrix.of(ids), lengths, names)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "base", "n", "shard"])

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            for name, ids in zip(some.column(0).to_pylist(), code.encode([t or "" for t in some.column(1).to_pylist()])):
                names.append(name)
                held.append(ids + end)
                n += len(held[-1]) // code.kind().itemsize
                if n >= most:
                    yield shard()
                    base, n, names, held = base + n, 0, [], []
    if held:
        yield shard()


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the documents and stores their shards; returns the stored table (part, seq, base, n, shard).

    The documents are ranged by id; a range's shards are in its order, ``base`` counts the range's
    tokens before a shard. Spark's committed Parquet writer stores one shard in each row.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(spread(docs.sparkSession), *order).sortWithinPartitions(*order)
    made = ranged.mapInArrow(lambda batches: _written(batches, tokenizer, end_id, shard_tokens), "part int, seq bigint, base bigint, n bigint, shard binary")
    return staged(made, "wavelet", codec="none")


def _read(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, base, data in zip(batch.column(0), batch.column(1), batch.column(2)):
            matrix, lengths, names = from_bytes(data.as_py())
            ids = matrix.ids().astype("<u4").tobytes()
            ends = lengths.cumsum(dtype=np.int64)
            starts = ends - lengths
            view = memoryview(ids)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            ended = matrix.ranks(end_id, ends) - matrix.ranks(end_id, starts)
            if not (matrix.tokens(ends - 1) == end_id).all():
                raise ValueError("a document of the shard doesn't close with the end id")
            columns = [pa.array([part.as_py()] * len(crc), pa.int32()), pa.array(names, pa.int64()), pa.array(starts + base.as_py()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(ended)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "id", "at", "n_tokens", "ids_crc32", "n_end"])


def offsets(stored: DataFrame) -> DataFrame:
    """Per part the tokens of all parts before it; a part is a partition of the writer, so these are few rows."""
    sizes = stored.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read(stored: DataFrame, end_id: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Per document of the stored shards: id, ``start`` among all ids, ``n_tokens``, ``ids_crc32`` and ``n_end``, its end ids counted by rank."""
    rows = stored.select("part", "base", "shard").mapInArrow(lambda it: _read(it, end_id), "part int, id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, n_end bigint")
    return rows.join(offsets(stored), "part").select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_end")


def _per_shard(stored: DataFrame, ask: Callable[[WaveletMatrix], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """(part, seq, base, token, value) for the values that ``ask`` yields for the tokens of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, base, data in zip(*(c.to_pylist() for c in batch.columns)):
                for token, values in ask(from_bytes(data)[0]):
                    n = len(values)
                    columns = [pa.array(np.full(n, x, t)) for x, t in ((part, np.int32), (seq, np.int64), (base, np.int64), (token, np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], ["part", "seq", "base", "token", "value"])

    return stored.select("part", "seq", "base", "shard").mapInArrow(run, "part int, seq bigint, base bigint, token bigint, value bigint")


def counts(stored: DataFrame, tokens: list[int]) -> DataFrame:
    """Per asked id: token and ``n``, how often it stands in all shards; nothing for an id that is in none."""
    found = _per_shard(stored, lambda m: ((t, np.array([n])) for t in dict.fromkeys(tokens) if (n := m.count(t))))
    return found.groupBy("token").agg(F.sum("value").alias("n"))


def occurrences(stored: DataFrame, tokens: list[int]) -> DataFrame:
    """A row for each place ``at`` (among all ids) of each asked id."""
    found = _per_shard(stored, lambda m: ((t, m.places(t)) for t in dict.fromkeys(tokens)))
    return found.join(F.broadcast(offsets(stored)), "part").select("token", (F.col("before") + F.col("base") + F.col("value")).alias("at"))


def kth(stored: DataFrame, asked: list[tuple[int, int]]) -> DataFrame:
    """Per (token, k) the place ``at`` of the id's k-th occurrence (from 0) among all ids; null if there are fewer.

    Counts of the shards, summed within their part and over the parts, name the one shard that each k falls into.
    """
    spark, tokens = stored.sparkSession, sorted({t for t, _ in asked})
    wanted = spark.createDataFrame(sorted(set(asked)), "token bigint, k bigint")
    n = _per_shard(stored, lambda m: ((t, np.array([c])) for t in tokens if (c := m.count(t)))).withColumnRenamed("value", "n")
    inside = Window.partitionBy("token", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("token").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = n.groupBy("token", "part").agg(F.sum("n").alias("whole")).select("token", "part", F.coalesce(F.sum("whole").over(over), F.lit(0)).alias("earlier"))
    first = n.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["token", "part"])
    first = first.withColumn("first", F.col("earlier") + F.col("inside"))
    hit = first.join(F.broadcast(wanted), "token").where((F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("n")))
    local = hit.groupBy("part", "seq").agg(F.collect_list(F.struct("token", "k", (F.col("k") - F.col("first")).alias("own"))).alias("wants"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, data, wants in zip(*(c.to_pylist() for c in batch.columns)):
                m = from_bytes(data)[0]
                got = [(part, w["token"], w["k"], base + m.select(w["token"], w["own"])) for w in wants]
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["part", "token", "k", "at"])

    found = stored.join(local, ["part", "seq"]).select("part", "base", "shard", "wants").mapInArrow(run, "part int, token bigint, k bigint, at bigint")
    found = found.join(F.broadcast(offsets(stored)), "part").select("token", "k", (F.col("before") + F.col("at")).alias("at"))
    return wanted.join(found, ["token", "k"], "left")


def tokens_at(stored: DataFrame, places: DataFrame, at_col: str = "at", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per distinct place among all ids: ``at`` and ``token`` (null beyond the last id), by access to the shards that hold them.

    Shards and places meet in cells of ``shard_tokens`` ids, so no table is compared with all of the other. A shard is
    asked for at most ``shard_tokens`` places at once.
    """
    cell = lambda x: F.floor(x / shard_tokens)
    shards = stored.join(F.broadcast(offsets(stored)), "part").select("part", "seq", "n", (F.col("before") + F.col("base")).alias("start"))
    shards = shards.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("n") - 1))))
    asked = places.select(F.col(at_col).cast("bigint").alias("at")).where("at is not null").distinct()
    met = asked.withColumn("cell", cell(F.col("at"))).join(shards, "cell").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n")))
    local = met.groupBy("part", "seq", "cell").agg(F.first("start").alias("start"), F.sort_array(F.collect_list("at")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, wants in zip(*batch.columns):
                at = wants.values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(from_bytes(data.as_py())[0].tokens(at - start.as_py()).astype(np.int64))], ["at", "token"])

    found = stored.join(local, ["part", "seq"]).select("start", "shard", "places").mapInArrow(run, "at bigint, token bigint")
    return asked.join(found, "at", "left")

"""BPE encoding and decoding by forced-boundary splitting.

A merge joins two neighbours into a vocabulary token, so a pair of symbols that stands inside no token
can never be merged over: the place between them is a certain cut. A pretoken falls apart
at its cuts into fragments that are merged independently; their ids, put one
after the other, are the ids of the pretoken. A long fragment is merged through a heap of its pairs, so the time grows with
n log n. Fragments and white-space separated pieces repeat a lot
and are kept in bounded tables of the worker, long ones excepted; a table that is full starts anew, which costs time only.

Null texts count as empty and have no ids. White space is no part of any pretoken. The strings of
the special tokens are recognised in the raw text, as the library does.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces that a worker's table holds before it starts anew, and the length from which on a piece is not kept.
TABLE_PIECES = 600_000
LONG = 200
#: Symbols from which on a fragment is merged through a heap.
HEAP_FROM = 48

#: Unicode's White_Space, where the pretokeniser's \s splits.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def refuse_others(spec: dict) -> None:
    """Raises unless the file's added tokens are plain strings and its steps those that are done here."""
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    model = spec["model"]
    fine = (
        steps == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
        and not (splits[1]["use_regex"] or splits[1]["add_prefix_space"])
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and spec["decoder"] is None
    )
    if not fine:
        raise ValueError("no tokenizers file of the kind that is encoded here")


class Bounded(dict):
    """A table that fills itself by ``make`` and starts anew when full; the values of long keys are not kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) < LONG:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class ForcedBpe:
    """Encoder and decoder of a tokenizers file whose model is byte-level BPE with a word end.

    ``truncation`` and ``padding`` of the file are unused; its post-processor too. A file that asks for anything else
    than what is done here is refused.
    """

    def __init__(self, path: str, table_pieces: int = TABLE_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        refuse_others(spec)
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.letters = byte_letters()
        #: Neighbours that some token holds; any other pair of neighbours is a cut.
        self.joined = {t[i : i + 2] for token in self.vocab for t in [token.removesuffix(self.end)] for i in range(len(t) - 1)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.openings = sorted({t[:2] for t in self.added})
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}")
        self.pretokens = regex.compile(pattern)
        self.fragments = Bounded(lambda key: self._merge(key[:-1], key[-1] == "1"), table_pieces // 4)
        self.words = Bounded(self._word, table_pieces)
        self.pieces = Bounded(self._piece, table_pieces)
        self.texts = Bounded(self._names_of, table_pieces)
        self.runs = re.compile(f"[^{SPACE}]+")

    def cuts(self, symbols: str) -> list[int]:
        """Places in a pretoken's symbols that no token spans."""
        joined = self.joined
        return [i for i in range(1, len(symbols)) if symbols[i - 1 : i + 1] not in joined]

    def _merge(self, text: str, last: bool) -> list[int]:
        parts = list(text)
        if last:
            parts[-1] += self.end
        if len(parts) >= HEAP_FROM:
            return self._merge_long(parts)
        ranks, none = self.ranks, len(self.ranks)
        order = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while order and (least := min(order)) < none:
            i = order.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(order):
                order[i] = ranks.get((parts[i], parts[i + 1]), none)
        return [*map(self.vocab.__getitem__, parts)]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """Pairs wait in a heap by rank and place; a part that was merged away is None, and its neighbours are linked."""
        ranks, n = self.ranks, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [self.vocab[p] for p in parts if p is not None]

    def pretoken_ids(self, pretoken: str) -> list[int]:
        letters = self.letters
        # printable ASCII stands for itself
        symbols = pretoken if pretoken.isascii() and pretoken.isprintable() else "".join([letters[b] for b in pretoken.encode()])
        cuts = self.cuts(symbols)
        if not cuts:
            return self._merge(symbols, True)
        at = [0, *cuts, len(symbols)]
        return [i for a, b in zip(at, at[1:]) for i in self.fragments[symbols[a:b] + ("1" if b == len(symbols) else "0")]]

    def _word(self, pretoken: str) -> bytes:
        ids = self.pretoken_ids(pretoken)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        text = unicodedata.normalize("NFC", piece)
        # each character by itself: a final sigma is not special here
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return b"".join(map(self.words.__getitem__, self.pretokens.findall(text)))

    def _plain(self, text: str) -> list[bytes]:
        # str.split also splits at four control characters that are no white space to the pretokeniser
        words = text.split() if text.isprintable() or not re.search("[\x1c-\x1f]", text) else self.runs.findall(text)
        return list(map(self.pieces.__getitem__, words))

    def encode_pieces(self, text: str | None) -> list[bytes]:
        """The ids of each white-space separated piece, as little-endian unsigned 32-bit integers."""
        if not text:
            return []
        if not any(o in text for o in self.openings):
            return self._plain(text)
        out: list[bytes] = []
        for k, part in enumerate(self.specials.split(text)):
            out += [self.added[part].to_bytes(4, "little")] if k % 2 else self._plain(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        return memoryview(b"".join(self.encode_pieces(text))).cast("I").tolist() if text else []

    def _names_of(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))

    def decode_pieces(self, pieces: list[bytes]) -> str:
        """As the library without a decoder: the tokens' strings with spaces between them."""
        return " ".join(filter(None, map(self.texts.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def coder(path: str) -> ForcedBpe:
    """One coder for each file and worker."""
    return ForcedBpe(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids`` (binary: little-endian unsigned 32-bit).

    Rows are independent: repeated rows give repeated rows, an empty table an empty one, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                ids = [b"".join(code.encode_pieces(t.as_py())) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of ``ids_col`` as the library decodes it; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = [None if (b := x.as_py()) is None else " ".join(map(code.names.__getitem__, memoryview(b).cast("I"))) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def roundtrip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, and ``decoded_sha256`` of the text that ``ids`` decode to; one decoded text at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                ids = [b"".join(code.encode_pieces(t.as_py())) for t in some.column(1)]
                decoded = [hashlib.sha256(code.decode(memoryview(b).cast("I")).encode()).hexdigest() for b in ids]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded_sha256"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded_sha256 string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; digests are taken where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                pieces = code.encode_pieces(text.as_py())
                ids = b"".join(pieces)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(code.decode_pieces(pieces).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

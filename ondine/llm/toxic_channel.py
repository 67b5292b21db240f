"""Toxicity by noisy-channel deobfuscation.

A character language model (trigrams over letters, counted over all documents) and a channel (a letter may be written as
itself, as a look-alike sign, several times, or with a separator after it) restore disguised words: a token with look-alikes, separators or
repetitions is a lattice of the letters that it may stand for, and Viterbi decoding finds its likeliest reading; a separator may part words or not.
A run of single letters is one lattice whose spaces may be real or not. Tokens of letters without repetition have one
reading, so no lattice is built for them; neither is one for plain numbers. The parts of a token and a word as it is written count beside the decoder's reading.

The restored words are scored. Their whole forms and prefixes are evidence that is counted over a bounded sample of labelled
documents; the strongest are the features of a logistic model, whose probability is the score. Empty and null texts are
scored by the model's bias. Repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondine.llm._common import staged

#: Bounds of the labelled sample, and of the features that are kept.
SAMPLE_ROWS = 20_000
FEATURES = 4096
#: Documents of the sample that must hold a feature.
LEAST_DOCUMENTS = 4
#: Lower bound of the share of toxic documents from which on a feature counts by itself.
CERTAIN = 0.97
#: Words that a worker remembers before it starts anew, and the length from which on a word is not kept.
TABLE_WORDS, LONG = 400_000, 200

#: Signs and the letters that they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "µ": "u"}
SEPARATORS = ".-_*~'’^,`"
#: Costs of the channel, in nats.
COST_SIGN, COST_SEPARATOR, COST_REPEAT, COST_SPACE, COST_LOST = 1.0, 1.5, 1.0, 0.3, 14.0
#: In a run of single letters a space seldom parts words.
COST_KEPT = 2.0
#: A separator that parts words, and a letter of a pair that is a repetition: many words have pairs.
COST_PARTED, COST_PAIR = 1.5, 2.0

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
#: Code 0 is any other character and the border of a word; the last code is any other letter.
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
K = len(LETTERS) + 2

SPACED = re.compile(r"(?<!\S)(?:\S(?:\s+|[.\-_*])){2,}\S(?!\S)")
CLEAN = re.compile(r"[^\W\d_]+\Z")
PAIR = re.compile(r"(.)\1")
PARTS = re.compile("[" + re.escape(SEPARATORS) + r"\s/:;=\"]+")
#: Digits with marks between them, a sign of currency before or after.
NUMBER = re.compile(r"[$€£¥§+(<]?\d[\d\s.,:;/'’^*_~=+-]*[$€£¥§]?\Z")
EDGE = re.compile(r"\A[^\w@$!|+(<€£¥§]+|[^\w@$€£¥§]+\Z")


def codes() -> np.ndarray:
    """Code of each character up to U+FFFF, in lower case."""
    table = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i).lower()
        if len(c) == 1 and c.isalpha():
            table[i] = CODE.get(c, K - 1)
    return table


@dataclass
class CharModel:
    """Interpolated trigrams; ``cost[a, b, c]`` is the negative log of c after a and b."""

    cost: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> CharModel:
        tri = counts.reshape(K, K, K).astype(np.float64)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + K)
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5)
        return cls((-np.log(p3)).astype(np.float32))

    def decode(self, lattice: list[list[tuple[str, float]]]) -> tuple[str, float]:
        """The likeliest reading of a lattice: per place the letters (or a space, or nothing) and their costs."""
        code, cost = CODE, self.cost
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for place in lattice:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (total, path) in best.items():
                for letter, price in place:
                    if letter:
                        c = code.get(letter, 0 if letter == " " else K - 1)
                        key, value, way = (b, c), total + price + float(cost[a, b, c]), (path, letter)
                    else:
                        key, value, way = (a, b), total + price, path
                    held = after.get(key)
                    if held is None or value < held[0]:
                        after[key] = (value, way)
            best = after
        total, path = min((t + float(cost[a, b, 0]), p) for (a, b), (t, p) in best.items())
        out: list[str] = []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out)), total


def lattice_of(token: str) -> list[list[tuple[str, float]]]:
    """Per sign of a token its readings; of a run of one letter all but the first may be repetitions."""
    out: list[list[tuple[str, float]]] = []
    for i, c in enumerate(token):
        if c.isalpha():
            run = c == token[i - 1] if i else False
            long = run and (token[i - 2 : i + 1] == c * 3 or token[i - 1 : i + 2] == c * 3)
            out.append([(c, 0.0), ("", COST_REPEAT if long else COST_PAIR)] if run else [(c, 0.0)])
        elif c in LOOKALIKES:
            out.append([(x, COST_SIGN) for x in LOOKALIKES[c]] + [("", COST_LOST)])
        elif c == " ":
            out.append([(" ", COST_KEPT), ("", COST_SPACE)])
        else:
            out.append([("", COST_SEPARATOR), (" ", COST_PARTED)])
    return out


def restored(token: str, model: CharModel) -> str:
    """The words (with spaces between them) that a lower-case token stands for."""
    core = " ".join(EDGE.sub("", token).split())
    if not core or CLEAN.match(core) and not PAIR.search(core):
        return core
    if NUMBER.match(core):
        return ""
    return " ".join(model.decode(lattice_of(core))[0].split())


def readings(token: str, model: CharModel) -> set[str]:
    """The words of the likeliest reading; also those of each part between separators, and a word of letters as it is written."""
    out = set(restored(token, model).split())
    parts = PARTS.split(token)
    if len(parts) > 1 and sum(map(len, parts)) > 2 * len(parts):
        for part in parts:
            out |= readings(part, model)
    elif CLEAN.match(core := EDGE.sub("", token)):
        out.add(core)
    return out


_met: dict[str, dict[str, tuple[int, ...]]] = {}


@dataclass
class Scorer:
    """Scores texts by the logistic model over the features of their restored words."""

    chars: CharModel
    weights: dict[str, int]
    values: np.ndarray
    bias: float
    #: Log-odds that a feature gives by itself (-inf: not certain).
    alone: np.ndarray = field(default_factory=lambda: np.zeros(0))
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def words(self) -> dict[str, tuple[int, ...]]:
        """Features of the words that this worker has met; one model's at a time."""
        if self.name not in _met:
            _met.clear()
            _met[self.name] = {}
        return _met[self.name]

    def features(self, word: str) -> tuple[int, ...]:
        words = self.words
        if len(words) > TABLE_WORDS:
            words.clear()
        get = self.weights.get
        found = {i for w in readings(word, self.chars) for f in forms(w) if (i := get(f)) is not None}
        out = tuple(found)
        if len(word) < LONG:
            words[word] = out
        return out

    def score(self, text: str | None) -> float:
        text = (text or "").lower()
        known, found = self.words, set()
        for token in set(text.split()):
            hit = known.get(token)
            if hit is None:
                hit = self.features(token)
            if hit:
                found.update(hit)
        for run in SPACED.finditer(text):
            found.update(self.features(run.group()))
        z = self.bias + sum(self.values[i] for i in sorted(found))
        z = max([z, *(self.alone[i] for i in found)])
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def forms(word: str) -> list[str]:
    """A word's whole form and its prefixes of 4 to 6 letters."""
    return [word + "$", *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


def language_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counts character trigrams over all documents; each task sums its own, so K**3 sums at most come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = codes(), np.zeros(K**3, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                text = "\n\n".join(t for t in batch.column(0).slice(k, 200).to_pylist() if t)
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                c = table[np.minimum(points, 0xFFFF)].astype(np.int32)
                both = np.concatenate([[0, 0], c, [0, 0]])
                total += np.bincount((both[:-2] * K + both[1:-1]) * K + both[2:], minlength=K**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    grams = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "gram bigint, n bigint")
    counts = np.zeros(K**3)
    for row in grams.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():  # K**3 rows at most
        counts[row.gram] = row.n
    return CharModel.of(counts)


def held_out(name: str = "doc_id", folds: int = 5):
    """Rows kept from learning: crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % folds == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """Text and label of at most ``most`` labelled ids outside the held-out fold, by the hash of the ids; of an id's rows, that of the least hash of its
    text, so there are at most ``most`` rows."""
    some = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    some = some.select(F.col(id_col).cast("bigint").alias("__id"), (F.col(label) > 0).cast("int").alias("label"))
    some = some.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    text = docs.select(docs[id_col].cast("bigint").alias("__id"), docs[text_col].cast("string").alias("text"))
    first = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text"))["text"]
    return text.join(F.broadcast(some), "__id").groupBy("__id").agg(first.alias("text"), F.max("label").alias("label"))


def _evidence(sample: DataFrame, chars: CharModel) -> DataFrame:
    """Per form: how many toxic and how many other documents of the sample hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(document_forms(text, chars))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield made(counts)
                counts = (Counter(), Counter())
        yield made(counts)

    def made(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = [*(counts[0].keys() | counts[1].keys())]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][f] for f in names], pa.int64()) for k in (1, 0))], ["form", "toxic", "other"])

    rows = sample.select("text", "label").mapInArrow(run, "form string, toxic bigint, other bigint")
    return rows.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def document_forms(text: str | None, chars: CharModel) -> set[str]:
    text = (text or "").lower()
    tokens = [*set(text.split()), *(m.group() for m in SPACED.finditer(text))]
    return {f for t in tokens for w in readings(t, chars) for f in forms(w)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = SAMPLE_ROWS, features: int = FEATURES) -> Scorer:
    """The language model of all documents, and a logistic model fitted on the labelled sample.

    The features are those whose share of toxic documents is surely above that of all, strongest first. Only their
    places in each sampled document come to the driver, which descends the log-loss with a ridge. As toxic documents often hold
    several such words, the model gives one alone too little; so a feature that is toxic with certainty sets
    a least score by itself. Without labels of both kinds the score is 0.5 or the one label's.
    """
    chars = language_model(docs, text_col)
    sample = staged(labelled_sample(docs, labels, label, id_col, text_col, most), "toxic-sample")
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n1 or n1 == n:
        return Scorer(chars, {}, np.zeros(0), 0.0 if not n else (4.0 if n1 else -4.0))
    seen = F.col("toxic") + F.col("other")
    excess = F.col("toxic") - seen * (n1 / n)
    sure = excess / F.sqrt(seen * (n1 / n) * (1 - n1 / n))
    top = _evidence(sample, chars).where((seen >= LEAST_DOCUMENTS) & (sure > 4)).orderBy(sure.desc(), "form").limit(features).collect()
    top = sorted(top, key=lambda r: r.form)
    names = {r.form: i for i, r in enumerate(top)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(i for f in document_forms(t, chars) if (i := names.get(f)) is not None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(held, pa.list_(pa.int32()))], ["id", "label", "held"])

    rows = sample.select("__id", "text", "label").mapInArrow(run, "id bigint, label int, held array<int>").orderBy("id", "label", "held").collect()
    w, b = fit([r.held for r in rows], np.array([r.label for r in rows], float), len(names))
    toxic, seen_ = (np.array([f(r) for r in top], float) for f in (lambda r: r.toxic, lambda r: r.toxic + r.other))
    sure_ = (least_share(toxic, seen_) >= CERTAIN) & (w > 0)
    alone = np.where(sure_, np.log((toxic + 0.5) / (seen_ - toxic + 0.5)), -np.inf)
    return Scorer(chars, names, w, b, alone)


def least_share(hits: np.ndarray, n: np.ndarray, z: float = 1.64) -> np.ndarray:
    """Wilson's lower bound of a share."""
    p, more = hits / n, z * z / n
    return (p + more / 2 - np.sqrt(more * p * (1 - p) + more * more / 4)) / (1 + more)


def fit(held: list[list[int]], y: np.ndarray, width: int, ridge: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights over sets of features by gradient descent with per-feature steps; the bias is not shrunk."""
    at = np.repeat(np.arange(len(held)), [len(h) for h in held])
    of = np.array([i for h in held for i in h], np.int64)
    w, b = np.zeros(width), math.log(y.mean() / (1 - y.mean()))
    seen = np.bincount(of, minlength=width) / 4 * 3 + ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[of], len(held)) + b, -30, 30)))
        w -= (np.bincount(of, (p - y)[at], width) + ridge * w) / seen
        b -= (p - y).sum() / (len(y) / 4 * 3)
    return w, float(b)


def scores(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``held_out``, ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most K**3 costs and FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["id", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)

"""Language of code-switched text by a linear-chain conditional random field.

Each word has affix, character n-gram and lexicon features; a transition between languages costs what the field has learned. The
posteriors of all words come from the forward-backward algorithm, and a text's language is the one with the most posterior
words; ``switches`` gives the stretches of one language instead. The chains of many texts are laid end to end and cut into columns of equal length: the products of the columns'
transfer matrices are made side by side, then handed from column to column, so numpy steps over the length of a column and not of a text.
Of more than FEW languages no such matrices are made: texts stand side by side and are walked forward and back, a column at a time, with the same results.

The field is fitted by the gradient of its conditional likelihood on chains that are spliced from segments of labelled documents, a
bounded sample of them with an equal part for each language, so a rare language is learned from all that it has, up to its part. It has a weight for each pair of a
feature and a language that the sample holds, and of moves what it is worth to stay in each language, to leave it and to enter it, so the model grows with the sample and not
with the number of languages times the features; values of ``lang`` have no bound, and each one gives a row at least. A null text or one without letters is ``und`` with score 0; so is every text where no label was
learned. Words without letters are passed over. Repeated rows get equal results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ondine.llm._common import staged

#: Bounds of the sample: labelled rows, and segments and words of a segment that each gives.
SAMPLE_ROWS, SEGMENTS, SEGMENT_WORDS = 4_000, 4, 24
#: Words that are in the lexicon of a language, hashed feature buckets, gradient steps.
LEXICON, BUCKETS, STEPS = 2_000, 1 << 16, 40
#: Segments of a training chain, steps of a column, words that are labelled together.
CHAIN, COLUMN, TOGETHER = 32, 128, 200_000
#: Words that a worker remembers before it starts anew, and the length from which on a word is not kept.
TABLE_WORDS, LONG = 600_000, 100
NONE = "und"

#: The feature of a word in no lexicon.
NO_LEXICON = [zlib.crc32(b"none", 5)]

#: Languages up to which transfer matrices are made; pairs of place (or feature) and language that are worked on together.
FEW, BLOCK = 16, 1 << 22
TINY = 1e-30

#: Splits where str.split does.
TOKEN = re.compile(r"\S+")
EDGES = re.compile(r"\A(?:[\W\d_])+|(?:[\W\d_])+\Z")


def plain(token: str) -> str:
    """A token in lower case without signs at its edges; empty if it has no letter."""
    if token.isalpha():
        return token.lower()
    if token[:-1].isalpha() and token[-1] in ".,!?;:":
        return token[:-1].lower()
    word = EDGES.sub("", token.lower())
    return word if any(map(str.isalpha, word)) else ""  # what is left may be a number such as a half or a Roman eight


def word_features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Buckets of a word's features: itself, affixes and trigrams (of its UTF-8 bytes, with borders), and its lexicons."""
    crc, edge = zlib.crc32, f"^{word}$".encode()
    n = len(edge)
    out = [crc(edge, 1), crc(edge[:2], 2), crc(edge[:3], 2), crc(edge[:4], 2), crc(edge[:5], 2), crc(edge[-2:], 3), crc(edge[-3:], 3), crc(edge[-4:], 3), crc(edge[-5:], 3)]
    out += [crc(edge[i : i + 3], 4) for i in range(n - 2)]
    out += lexicon.get(word, NO_LEXICON)
    return [x & (BUCKETS - 1) for x in out]


def scan(e: np.ndarray, reset: np.ndarray, a: np.ndarray, pi: np.ndarray, column: int = COLUMN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward values, posteriors, and (emission times backward) values of chains laid end to end.

    e (n, k): emissions, positive. reset (n): a chain starts here. a (k, k): transitions from row to column. Every value is scaled to sum 1.
    """
    n, k = e.shape
    columns = max(1, -(-n // column))
    full = columns * column
    pad = lambda x, v: np.concatenate([x, np.full((full - n, *x.shape[1:]), v, x.dtype)])
    e3 = pad(e, 1.0).reshape(columns, column, k).transpose(1, 0, 2)
    r2 = pad(reset, True).reshape(columns, column).T
    start = lambda x: x.sum(-1, keepdims=True) * pi

    m = np.broadcast_to(np.eye(k), (columns, k, k)).copy()
    for t in range(column):
        stepped = (m.reshape(-1, k) @ a).reshape(columns, k, k)
        m = np.where(r2[t][:, None, None], start(m), stepped) * e3[t][:, None, :]
        m /= m.sum((1, 2), keepdims=True)
    into, last = np.empty((columns, k)), np.empty((columns, k))
    x = np.full(k, 1 / k)
    for c in range(columns):
        into[c] = x
        x = x @ m[c]
        x = x / x.sum()
    x = np.full(k, 1 / k)
    for c in range(columns - 1, -1, -1):
        last[c] = x
        x = m[c] @ x
        x = x / x.sum()
    alpha = np.empty((column, columns, k))
    x = into
    for t in range(column):
        x = np.where(r2[t][:, None], start(x), x @ a) * e3[t]
        x = x / x.sum(1, keepdims=True)
        alpha[t] = x
    ahead, gamma = np.empty_like(alpha), np.empty_like(alpha)
    x = last
    for t in range(column - 1, -1, -1):
        both = alpha[t] * x
        gamma[t] = both / both.sum(1, keepdims=True)
        x = e3[t] * x
        x = x / x.sum(1, keepdims=True)
        ahead[t] = x
        x = np.where(r2[t][:, None], (x @ pi)[:, None], x @ a.T)
        x = x / x.sum(1, keepdims=True)
    flat = lambda v: v.transpose(1, 0, 2).reshape(full, k)[:n]
    return flat(alpha), flat(gamma), flat(ahead)


@dataclass
class Weights:
    """Weights of pairs of bucket and language, in the order of buckets; all others are 0."""

    k: int
    start: np.ndarray  # (BUCKETS + 1)
    language: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, feature: np.ndarray, language: np.ndarray, k: int) -> Weights:
        """Zeros for the pairs that are given."""
        pairs = np.unique(feature.astype(np.int64) * k + language)
        return cls(k, np.searchsorted(pairs, np.arange(BUCKETS + 1) * k), (pairs % max(1, k)).astype(np.int32), np.zeros(len(pairs)))

    def pieces(self, row: np.ndarray, feature: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row and place of each pair that the rows' features hold, at most BLOCK (or those of one feature) at a time."""
        counts = self.start[feature + 1] - self.start[feature]
        ends, a = counts.cumsum(), 0
        while a < len(feature):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - counts[a] + BLOCK, "right")))
            n = counts[a:b]
            at = np.arange(n.sum()) + np.repeat(self.start[feature[a:b]] - n.cumsum() + n, n)
            yield np.repeat(row[a:b], n), at
            a = b

    def scores(self, pieces: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """(n, languages): sums over each row's features."""
        out = np.zeros(n * self.k)
        for row, at in pieces:
            least, most = int(row[0]) * self.k, (int(row[-1]) + 1) * self.k
            out[least:most] += np.bincount((row - row[0]) * self.k + self.language[at], self.value[at], most - least)
        return out.reshape(n, self.k)

    def sums(self, pieces: Iterable[tuple[np.ndarray, np.ndarray]], by_row: np.ndarray) -> np.ndarray:
        """For each weight the sum of ``by_row`` (rows, languages) over the rows that hold its bucket."""
        out = np.zeros(len(self.value))
        for row, at in pieces:
            out += np.bincount(at, by_row[row, self.language[at]], len(out))
        return out

    def __getitem__(self, feature: list[int]) -> np.ndarray:
        """(features, languages)"""
        return self.scores(self.pieces(np.arange(len(feature)), np.array(feature, np.int64)), len(feature))


@dataclass
class Moves:
    """Logs, for each language: to stay in it, to leave it for another, to enter it from another, to start in it."""

    stay: np.ndarray
    leave: np.ndarray
    enter: np.ndarray
    start: np.ndarray

    @property
    def full(self) -> np.ndarray:
        """From row to column; the largest is 0."""
        t = self.leave[:, None] + self.enter
        np.fill_diagonal(t, self.stay)
        return t - t.max(initial=-np.inf)

    def __post_init__(self):
        if len(self.stay):
            top = max(self.stay.max(), self.leave.max() + self.enter.max())
            self.out, self.into = np.exp(self.leave - self.leave.max()), np.exp(self.enter + self.leave.max() - top)
            self.same = np.exp(self.stay - top)
            self.more = self.same - self.out * self.into
            self.pi = np.exp(self.start - self.start.max())
            self.pi /= self.pi.sum()

    def forth(self, x: np.ndarray) -> np.ndarray:
        """x times the transitions: what stays, and what all leave, dealt among those that are entered."""
        return np.maximum(x * self.more + (x @ self.out)[:, None] * self.into, TINY)

    def back(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.more + (x @ self.into)[:, None] * self.out, TINY)

    def ahead(self, e: np.ndarray, reset: np.ndarray, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Forward values of columns side by side, and their last ones. e (steps, columns, k), reset (steps, columns), x: values before."""
        alpha = np.empty_like(e) if keep else None
        for t in range(len(e)):
            x = np.where(reset[t][:, None], self.pi, self.forth(x)) * e[t]
            x = x / x.sum(1, keepdims=True)
            if keep:
                alpha[t] = x
        return alpha, x

    def behind(self, e: np.ndarray, reset: np.ndarray, alpha: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors, (emission times backward) values, and the backward values before the columns. x: those after."""
        gamma, onward = np.empty_like(e), np.empty_like(e)
        for t in range(len(e) - 1, -1, -1):
            both = alpha[t] * x
            gamma[t] = both / both.sum(1, keepdims=True)
            x = e[t] * x
            x = x / x.sum(1, keepdims=True)
            onward[t] = x
            x = np.where(reset[t][:, None], 1 / e.shape[2], self.back(x))
            x = x / x.sum(1, keepdims=True)
        return gamma, onward, x


def emitted(score: np.ndarray) -> np.ndarray:
    return np.exp(score - score.max(1, keepdims=True)) + 1e-12


class Table(dict):
    """Places of tokens, filled by the field as they come; those of long ones are not kept."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, token: str) -> int:
        at = self.field.place(token)
        if len(token) < LONG:
            self[token] = at
        return at


@dataclass
class Field:
    languages: list[str]
    weights: Weights
    moves: Moves
    lexicon: dict[str, list[int]]

    def __post_init__(self):
        self.table = Table(self)
        self.words: dict[str, int] = {}
        self.places = 1
        self.features: list[np.ndarray] = [np.zeros(0, np.uint16)]
        self.learned = 1
        self.emissions = np.ones((1, len(self.languages)))

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("languages", "weights", "moves", "lexicon")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def few(self) -> bool:
        return len(self.languages) <= FEW

    @property
    def transitions(self) -> np.ndarray:
        return self.moves.full

    @property
    def starts(self) -> np.ndarray:
        return self.moves.start

    def place(self, token: str) -> int:
        """Place of a token's features; 0 is that of a token without letters."""
        word = plain(token)
        if not word:
            return 0
        at = self.words.get(word)
        if at is None:
            at, self.places = self.places, self.places + 1
            self.features.append(np.array(word_features(word, self.lexicon), np.uint16))
            if len(word) < LONG:
                self.words[word] = at
        return at

    def _emitted(self, features: list[np.ndarray]) -> np.ndarray:
        row, flat = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate(features).astype(np.int64)
        return emitted(self.weights.scores(self.weights.pieces(row, flat), len(features)))

    def _together(self, held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of few languages: all texts end to end."""
        if self.learned < self.places:
            self.emissions = np.concatenate([self.emissions, self._emitted(self.features[self.learned :])])
            self.features[self.learned :] = [self.features[0]] * (self.places - self.learned)
            self.learned = self.places
        ends = np.cumsum([len(p) for p in held])
        reset = np.zeros(ends[-1], bool)
        reset[[0, *ends[:-1]]] = True
        _, gamma, _ = scan(self.emissions[np.concatenate(held)], reset, np.exp(self.moves.full), self.moves.pi)
        for g in np.split(gamma, ends[:-1]):
            yield g.argmax(1), g.max(1), g.mean(0)

    def _column(self, held: list[np.ndarray], c: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Column c of texts that reach it: emissions and starts, with ones and starts behind a text's end, and each text's words there."""
        parts = [p[c * COLUMN : (c + 1) * COLUMN] for p in held]
        n = [len(p) for p in parts]
        at, back = np.unique(np.concatenate(parts), return_inverse=True)
        own = self._emitted([self.features[i] for i in at.tolist()])
        e, reset = np.ones((max(n), len(held), len(self.languages))), np.ones((max(n), len(held)), bool)
        for i, rows in enumerate(np.split(back, np.cumsum(n)[:-1])):
            e[: n[i], i], reset[: n[i], i] = own[rows], False
        reset[0] |= c == 0
        return e, reset, n

    def _aside(self, held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of many languages: texts side by side, as many as BLOCK holds; what enters each column is kept on the way forward."""
        k = len(self.languages)
        deal = max(1, BLOCK // (COLUMN * k))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [None] * len(held)
        order = sorted(range(len(held)), key=lambda i: -len(held[i]))
        for a in range(0, len(order), deal):
            own = order[a : a + deal]
            texts = [held[i] for i in own]
            active = [sum(len(p) > c * COLUMN for p in texts) for c in range(-(-len(texts[0]) // COLUMN))]
            before, x = [], np.full((len(texts), k), 1 / k)
            for c, m in enumerate(active):
                before.append(x[:m])
                if c + 1 < len(active):
                    e, reset, _ = self._column(texts[:m], c)
                    x = self.moves.ahead(e, reset, x[:m], keep=False)[1]
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
            share, after = np.zeros((len(texts), k)), np.zeros((0, k))
            for c in range(len(active) - 1, -1, -1):
                m = active[c]
                e, reset, n = self._column(texts[:m], c)
                after = np.concatenate([after, np.full((m - len(after), k), 1 / k)])
                alpha, _ = self.moves.ahead(e, reset, before[c])
                gamma, _, after = self.moves.behind(e, reset, alpha, after)
                for i in range(m):
                    g = gamma[: n[i], i]
                    share[i] += g.sum(0)
                    found[i].append((g.argmax(1), g.max(1)))
            for i, at in enumerate(own):
                best, top = (np.concatenate(x[::-1]) for x in zip(*found[i]))
                out[at] = best, top, share[i] / len(best)
        yield from out

    def posteriors(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per text with a word: its place in the list, the numbers of its tokens that are words, the likeliest language of each and its posterior, and the mean posterior of each language."""
        if not self.languages:
            return
        if max(len(self.table), self.places) > TABLE_WORDS:
            self.__post_init__()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        n = 0
        for i, text in enumerate(texts):
            tokens = (text or "").split()
            at = np.fromiter(map(self.table.__getitem__, tokens), np.int64, len(tokens))
            words = np.flatnonzero(at)
            if len(words):
                held.append((i, words, at[words]))
                n += len(words)
            if n >= TOGETHER or (i == len(texts) - 1 and n):
                found = (self._together if self.few else self._aside)([p for _, _, p in held])
                yield from ((k, words, *told) for (k, words, _), told in zip(held, found))
                held, n = [], 0

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and mean posterior of each text."""
        out: list[tuple[str, float]] = [(NONE, 0.0)] * len(texts)
        for i, _, _, _, share in self.posteriors(texts):
            k = int(share.argmax())
            out[i] = self.languages[k], float(min(1.0, share[k]))
        return out

    def stretches(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """Per text its stretches of one language: start and end (code points), language, mean posterior of their words."""
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for i, words, best, top, _ in self.posteriors(texts):
            spans = [m.span() for m in TOKEN.finditer(texts[i] or "")]
            first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(best)]):
                out[i].append((spans[words[a]][0], spans[words[b - 1]][1], self.languages[best[a]], float(min(1.0, top[a:b].mean()))))
        return out


def held_out(name: str):
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of segments at places drawn over the whole text, by a generator that the id seeds."""
    for batch in batches:
        ids, langs, words = [], [], []
        for name, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            own = [w for t in (text or "").split() if (w := plain(t))]
            rng = np.random.default_rng(zlib.crc32(str(name).encode()))
            for start in rng.integers(0, max(1, len(own) - SEGMENT_WORDS + 1), SEGMENTS if len(own) > SEGMENT_WORDS else 1).tolist():
                some = own[start : start + int(rng.integers(2, SEGMENT_WORDS + 1))]
                if some:
                    ids.append(name)
                    langs.append(lang)
                    words.append(some)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string()))], ["id", "lang", "words"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_ROWS) -> Field:
    """Learns from labelled rows outside the held-out fold: of each language ``most`` by the number of languages (one at least), by the hash of their ids."""
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    sizes = staged(rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids")), "languages")
    kinds = sizes.count()
    part = max(1, most // max(1, kinds))
    # by another hash only some three times the part are drawn, however common a language is; the window takes the part of these
    share = (3 * part + 30) / F.col("ids")
    drawn = rows.select("id", "lang").join(sizes, "lang").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)).select("id", "lang").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= part).select("id", "lang")
    sample = rows.join(F.broadcast(chosen), ["id", "lang"]).select("id", "text", "lang").mapInArrow(_segments, "id bigint, lang string, words array<string>")
    found = staged(sample, "segments").orderBy(F.xxhash64("words", "id"), "lang", "words").limit(max(most, kinds) * SEGMENTS).toArrow()
    return fit(found.column("words").to_pylist(), found.column("lang").to_pylist())


def fit(segments: list[list[str]], langs: list[str], steps: int = STEPS) -> Field:
    """Gradient ascent (Adam) of the log-likelihood of chains, with a ridge."""
    languages = sorted(set(langs))
    k = len(languages)
    if not k:
        return Field([], Weights.of(np.zeros(0, np.int64), np.zeros(0, np.int64), 0), Moves(*[np.zeros(0)] * 4), {})
    counts: dict[str, dict[str, int]] = {lang: {} for lang in languages}
    for some, lang in zip(segments, langs):
        for w in set(some):
            counts[lang][w] = counts[lang].get(w, 0) + 1
    lexicon: dict[str, list[int]] = {}
    for lang in languages:
        for w in sorted((w for w, c in counts[lang].items() if c > 1), key=lambda w: (-counts[lang][w], w))[:LEXICON]:
            lexicon.setdefault(w, []).append(zlib.crc32(lang.encode(), 6))
    number = {lang: i for i, lang in enumerate(languages)}
    chains = Chains.of(segments, [number[x] for x in langs], lexicon, k)
    weights = chains.weights()
    values = [weights.value, *(np.zeros(k) for _ in range(4))]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in values]
    for step in range(1, steps + 1):
        gradients = chains.gradient(weights, Moves(*values[1:]))
        for x, g, (m1, m2) in zip(values, gradients, moments):
            g = g - 0.1 * x
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    stay, leave, enter, start = values[1:]
    return Field(languages, Weights(k, weights.start, weights.language, weights.value.astype(np.float32)), Moves(stay, leave, enter, start - np.log(np.exp(start).sum())), lexicon)


@dataclass
class Chains:
    """Training chains laid end to end: the features of the distinct words, each place's word and language, and where chains start."""

    row: np.ndarray
    feature: np.ndarray
    of_word: np.ndarray
    y: np.ndarray
    reset: np.ndarray
    k: int

    @classmethod
    def of(cls, segments: list[list[str]], langs: list[int], lexicon: dict[str, list[int]], k: int, chain: int = CHAIN) -> Chains:
        """CHAIN segments make a chain, in the order given."""
        words = [w for some in segments for w in some]
        lengths = np.array([len(s) for s in segments])
        reset = np.zeros(len(words), bool)
        reset[(lengths.cumsum() - lengths)[::chain]] = True
        names = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = [word_features(w, lexicon) for w in names]
        row, feature = np.repeat(np.arange(len(ids)), [len(i) for i in ids]), np.array([f for i in ids for f in i])
        return cls(row, feature, np.array([names[w] for w in words]), np.repeat(langs, lengths), reset, k)

    def __post_init__(self):
        self.first = np.searchsorted(self.row, np.arange(int(self.row[-1]) + 2))
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def _features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number in ``words`` and bucket of each of their features."""
        n = self.first[words + 1] - self.first[words]
        at = np.arange(n.sum()) + np.repeat(self.first[words] - n.cumsum() + n, n)
        return np.repeat(np.arange(len(words)), n), self.feature[at]

    def weights(self) -> Weights:
        """Zeros for all pairs of bucket and language in the chains."""
        pairs = np.unique(self.of_word.astype(np.int64) * self.k + self.y)
        row, feature = self._features(pairs // self.k)
        return Weights.of(feature, (pairs % self.k)[row], self.k)

    def _dealt(self) -> Iterator[tuple[int, np.ndarray]]:
        """Chains dealt into groups of at most BLOCK pairs of place and language: first place and the chains' lengths."""
        starts = np.flatnonzero(self.reset)
        lengths = np.diff([*starts, len(self.y)])
        a = 0
        while a < len(starts):
            longest = np.maximum.accumulate(lengths[a:])
            b = a + max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1) * self.k, BLOCK, "right")))
            yield int(starts[a]), lengths[a:b]
            a = b

    def gradient(self, weights: Weights, moves: Moves) -> list[np.ndarray]:
        """Of the log-likelihood, by the weights, stays, leaves, enters and starts: what is there less what is expected."""
        k = self.k
        out = [np.zeros(len(weights.value)), *(np.zeros(k) for _ in range(4))]
        every = np.arange(len(self.first) - 1)
        wide = len(every) * k <= 2 * BLOCK  # then the words are scored at once, else for each group its own
        if wide:
            pieces = self.kept or weights.pieces(*self._features(every))
            if not self.kept and (held := list(itertools.islice(pieces, 2))):  # what is small stays for the next step
                pieces = itertools.chain(held, pieces)
                self.kept = held if len(held) == 1 else []
            score, by_word = emitted(weights.scores(pieces, len(every))), np.zeros((len(every), k))
        for begin, lengths in self._dealt():
            n, longest = int(lengths.sum()), int(lengths.max())
            words, own = np.unique(self.of_word[begin : begin + n], return_inverse=True)
            if not wide:
                score = emitted(weights.scores(weights.pieces(*self._features(words)), len(words)))
            place = words[own] if wide else own
            # chains side by side, with ones and starts behind their ends
            step, chain = np.arange(n) - np.repeat(lengths.cumsum() - lengths, lengths), np.repeat(np.arange(len(lengths)), lengths)
            e, reset = np.ones((longest, len(lengths), k)), np.ones((longest, len(lengths)), bool)
            e[step, chain] = score[place]
            reset[step, chain] = step == 0
            even = np.full((len(lengths), k), 1 / k)
            alpha, _ = moves.ahead(e, reset, even)
            gamma, onward, _ = moves.behind(e, reset, alpha, even)

            y, inner = self.y[begin : begin + n], np.flatnonzero(step > 0)
            left, right = alpha[step[inner] - 1, chain[inner]], onward[step[inner], chain[inner]]
            z = (left * moves.back(right)).sum(1, keepdims=True)
            stays = (left * right * moves.same / z).sum(0)
            told = gamma[step, chain]
            same = y[inner - 1] == y[inner]
            count = lambda x: np.bincount(x, minlength=k)
            out[1] += count(y[inner][same]) - stays
            out[2] += count(y[inner - 1][~same]) - (told[inner - 1].sum(0) - stays)
            out[3] += count(y[inner][~same]) - (told[inner].sum(0) - stays)
            out[4] += count(y[step == 0]) - told[step == 0].sum(0)
            wrong = -told
            wrong[np.arange(n), y] += 1
            order = np.argsort(own, kind="stable")
            summed = np.add.reduceat(wrong[order], np.searchsorted(own[order], np.arange(len(words))))
            if wide:
                by_word[words] += summed
            else:
                out[0] += weights.sums(weights.pieces(*self._features(words)), summed)
        if wide:
            out[0] = weights.sums(self.kept or weights.pieces(*self._features(every)), by_word)
        return out


def predictions(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``held_out``, ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(field)  # weights and lexicons are of the sample's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                found = own.label(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return made.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")


def switches(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each stretch of one language in a text: id, ``start`` and ``end`` (code points, end exclusive), ``lang`` and ``posterior``.

    A stretch goes from its first word to its last; words without letters part nothing. A text without letters has no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                found = own.stretches(some.column(1).to_pylist())
                flat = [x for xs in found for x in xs]
                names = some.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(xs) for xs in found])))
                columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([names, *columns], ["id", "start", "end", "lang", "posterior"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start bigint, end bigint, lang string, posterior double").withColumnRenamed("id", id_col)

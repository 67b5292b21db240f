"""The learned operators: held-out accuracy, the exactness of their inference, and hard rows."""

from __future__ import annotations

import dataclasses
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ondine.llm import crf_language, nbsvm_quality, toxic_channel
from ondine.llm.toxic_channel import CharModel, K, codes, restored

SYLLABLES = {"en": ["the", "ing", "er", "on", "an", "sh", "wh", "tion"], "fr": ["eau", "que", "oi", "è", "ment", "tre", "aux", "le"], "de": ["sch", "ung", "ver", "ich", "keit", "ü", "en", "pf"]}
BAD = ["idiot", "scumbag", "worthless", "pathetic"]


def word(rng, lang):
    return "".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3)))


def corpus(n=500, seed=1):
    """(doc_id, text, lang, toxic, quality)"""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = [word(rng, lang) for _ in range(rng.randint(15, 60))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.75
        if toxic:
            for _ in range(rng.randint(1, 2)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(words), " ".join(w + rng.choice(["***", "%%%"]) for w in words)])
        out.append((i, text, lang, int(toxic), int(good)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").cache()
    marks = spark.createDataFrame([(r[0], r[4], r[3]) for r in rows], "doc_id bigint, quality int, toxic int").cache()
    return rows, docs, marks


@pytest.fixture(scope="module")
def chars():
    text = "\n\n".join(r[1] for r in corpus(2000, 9)).lower()
    c = codes()[np.frombuffer(text.encode("utf-32-le"), "<u4")].astype(np.int32)
    return CharModel.of(np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K**3))


@pytest.mark.parametrize("token,word", [("w0rthle$$", "worthless"), ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("p a t h e t i c", "pathetic"), ("idiooooot", "idiot"), ("p@thet1c!!", "pathetic"), ("the", "the"), ("sh", "sh"), ("123", ""), ("", "")])
def test_disguised_words_are_restored(chars, token, word):
    assert restored(token, chars) == word


@pytest.mark.parametrize("token,word", [("idi.ot", "idiot"), ("wor-thless", "worthless"), ("4$$", "ass"), ("iiddiioott", "idiot"), ("ppaatthheettiicc", "pathetic"), ("the-idiot", "the idiot"), ("$45", ""), ("10:30", ""), ("455", "")])
def test_signs_separators_and_pairs_get_a_lattice(chars, token, word):
    assert restored(token, chars) == word


@pytest.mark.parametrize("text", ["the i d i o t on", "i  d  i  o  t", "the\ni\nd\ni\no\nt\non", "i\td\ti\to\tt", "the i.d-i o t"])
def test_runs_are_joined_by_any_white_space(chars, text):
    assert "idiot$" in toxic_channel.document_forms(text, chars)


def test_short_runs_parts_and_written_words_count(chars):
    found = toxic_channel.document_forms("the a s s on pathetic-idiot worthless scumbag/the", chars)
    assert {"ass$", "pathetic$", "idiot$", "worthless$", "scumbag$", "the$"} <= found


def test_viterbi_finds_the_best_reading(chars):
    rng = random.Random(3)
    for _ in range(60):
        lattice = [[(c, round(rng.random() * 3, 3)) for c in rng.sample(["a", "e", "i", "o", "s", "t", "", " "], rng.randint(1, 3))] for _ in range(rng.randint(1, 6))]
        best = np.inf
        for path in itertools.product(*lattice):
            a = b = 0
            cost = sum(p for _, p in path)
            for letter in (x for x, _ in path if x):
                c = toxic_channel.CODE.get(letter, 0 if letter == " " else K - 1)
                cost, a, b = cost + float(chars.cost[a, b, c]), b, c
            best = min(best, cost + float(chars.cost[a, b, 0]))
        assert chars.decode(lattice)[1] == pytest.approx(best, abs=1e-4)


def test_toxicity_held_out(learned):
    rows, docs, marks = learned
    model = toxic_channel.train(docs, marks)
    got = {r.doc_id: r for r in toxic_channel.scores(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert sum(got[r[0]].predicted == r[3] for r in held) >= 0.95 * len(held)
    assert toxic_channel.clean(docs, model).count() == sum(r.predicted == 0 for r in got.values())
    assert model.score("the on 1d10t er shing") >= 0.5 and model.score("the on er shing s c u m b a g an") >= 0.5 and model.score("the on er shing") < 0.5


def test_disguises_are_toxic(learned):
    model = toxic_channel.train(*learned[1:])
    assert all(model.score(f"the on er shing {x} an") >= 0.5 for x in ("idi.ot", "wor-thless", "iiddiioott", "i\td\ti\to\tt", "s  c  u  m  b  a  g", "idiot/the"))


def test_quality_held_out(learned):
    rows, docs, marks = learned
    got = {r.doc_id: r for r in nbsvm_quality.scores(docs, nbsvm_quality.train(docs, marks)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 50 and sum(got[r[0]].predicted == r[4] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def brute_quality(text):
    """Each n-gram by itself, with Python's integers."""
    m, mult = (1 << 64) - 1, int(nbsvm_quality.MULTIPLY)

    def bucket(gram, salt):
        h = salt
        for x in gram:
            h = (h ^ x) * mult & m
            h ^= h >> 29
        return h >> 48

    def grams(x, n, salt):
        return {bucket(x[i : i + n], salt) for i in range(len(x) - n + 1)}

    data = (text or "").encode()
    words = data.split()
    if not words:
        return set()
    kind = [0 if b <= 32 or b == 127 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b > 127 else b for b in data]
    runs = [(k, len(list(g))) for k, g in itertools.groupby(kind)]
    signs = [k * 4 + min(n, 3) for k, n in runs]
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
    n, parted = len(data), sum(k == 0 for k, _ in runs)
    lines = text.split("\n")
    share = [sum(k == 2 for k in kind) / n, sum(k == 3 for k in kind) / n, sum(k > 4 for k in kind) / n, sum(k == 4 for k in kind) / n, sum(k == 0 for k in kind) / n]
    share += [len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words), sum(w.isupper() for w in words) / len(words)]
    share += [len(set(lines)) / len(lines), min(1, math.log1p(len(words)) / 12), min(1, (sum(map(len, words)) + parted) / len(words) / 20)]
    steps = {bucket([i * 20 + j], 6) for i, s in enumerate(share) for j in range(20) if (j + 1) / 20 <= s}
    return grams(hashes, 1, 1) | grams(hashes, 2, 2) | grams([*map(ord, text)], 3, 3) | grams(signs, 4, 4) | grams(signs, 2, 5) | steps


def test_pieces_of_a_text_make_no_difference():
    rng = random.Random(21)
    base = ["".join(rng.choices("ab cD1 !é\n\U0001f642\x85", k=k)) for k in (1, 6, 7, 8, 9, 21, 500)]
    texts = base + [None, "", "   ", "ONE two", "a" * 5000, "a" * 30 + "XYZ" + " " * 9 + "\n\n1!1!é漢é" * 5, "x", "   y   "]
    for text in texts:
        want = sorted(brute_quality(text))
        for piece in (7, 8, 1000):
            if piece > 8 or len(text or "") < 20_000:
                assert nbsvm_quality.features(text, piece).tolist() == want
    long = "".join(rng.choices("ab cD1 !é\n", k=300_000))
    for at in range(nbsvm_quality.PIECE - 4, nbsvm_quality.PIECE + 3):
        text = long[:at] + "XYZ" + long[at + 3 :]
        assert nbsvm_quality.features(text).tolist() == nbsvm_quality.features(text, 1 << 30).tolist()
    assert nbsvm_quality.features(long).tolist() == sorted(brute_quality(long))


def test_the_labelled_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5000)] + [(2, None), (3, "x"), (3, "x"), (None, "y")], "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame([(i, (i or 0) % 2) for i in (1, 1, 2, 3, 4, None)], "doc_id bigint, quality int")
    for most in (1, 2, 10):
        sample = toxic_channel.labelled_sample(docs, marks, "quality", "doc_id", "text", most).collect()
        assert len(sample) <= most and len({r["__id"] for r in sample}) == len(sample)
    again = toxic_channel.labelled_sample(docs.repartition(5), marks, "quality", "doc_id", "text", 10).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, sample))


def test_quality_query_against_brute_force(spark, learned, hard):
    """Indicators, ratios and scores of the query, each computed again from the texts."""
    rows, docs, marks = learned
    model = nbsvm_quality.train(docs, marks)
    for df in (docs, hard):
        got = Counter((r.doc_id, round(r.score, 9), r.predicted) for r in nbsvm_quality.scores(df, model).collect())
        want = Counter()
        for r in df.collect():
            at = sorted(brute_quality(r.text))
            assert nbsvm_quality.features(r.text).tolist() == at
            z = sum(model.weights[i] for i in at) / max(1e-9, math.sqrt(sum(model.squares[i] for i in at))) + model.bias
            score = 1 / (1 + math.exp(-(model.slope * z + model.shift)))
            want[r.doc_id, round(score, 9), int(score >= 0.3)] += 1
        assert got == want
    train = [r for r in sorted(rows) if zlib.crc32(str(r[0]).encode()) % 5]
    assert nbsvm_quality.train(docs, marks, most_features=1).score("x") == 0.5
    counts = {1: Counter(), 0: Counter()}
    some = nbsvm_quality.fit([nbsvm_quality.features(r[1]) for r in train], np.array([r[4] for r in train]))
    for i, r in enumerate(train):
        if i % 5 != 4:
            counts[r[4]].update(brute_quality(r[1]))
    total = {k: nbsvm_quality.BUCKETS + sum(c.values()) for k, c in counts.items()}
    for i in range(0, nbsvm_quality.BUCKETS, 501):
        ratio = math.log((counts[1][i] + 1) / total[1]) - math.log((counts[0][i] + 1) / total[0]) if counts[1][i] + counts[0][i] > 2 else 0
        assert some.squares[i] == pytest.approx(ratio**2)


def test_toxicity_query_against_brute_force(spark, learned, hard):
    """Scores of the query from the readings of each token and run, without the worker's table."""
    model = toxic_channel.train(*learned[1:])
    for df in (learned[1], hard):
        got = Counter((r.doc_id, round(r.score, 9), r.predicted) for r in toxic_channel.scores(df, model).collect())
        want = Counter()
        for r in df.collect():
            forms = toxic_channel.document_forms(r.text, model.chars)
            held = sorted(model.weights[f] for f in forms if f in model.weights)
            z = max([model.bias + sum(model.values[i] for i in held), *(model.alone[i] for i in held)])
            want[r.doc_id, round(1 / (1 + math.exp(-z)), 9), int(z >= 0)] += 1
        assert got == want


def test_language_query_against_brute_force(learned, hard):
    """Texts one by one, their posteriors from plain forward and backward steps."""
    field = crf_language.train(learned[1])
    a, pi, n = np.exp(field.transitions), np.exp(field.starts), 0
    for df in (learned[1].limit(60), hard):
        got = {}
        for r in crf_language.predictions(df, field).collect():
            got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        for r in df.collect():
            words = [w for t in (r.text or "").split() if (w := crf_language.plain(t))]
            if not words:
                assert ("und", 0.0) in got[r.doc_id]
                continue
            score = np.array([field.weights[crf_language.word_features(w, field.lexicon)].sum(0) for w in words])
            e = np.exp(score - score.max(1, keepdims=True)) + 1e-12
            forward, backward = [pi * e[0]], [np.ones(len(pi))]
            for t in range(1, len(e)):
                forward.append((forward[-1] / forward[-1].sum()) @ a * e[t])
                backward.insert(0, a @ (e[-t] * backward[0] / backward[0].sum()))
            gamma = np.array(forward) * np.array(backward)
            share = (gamma / gamma.sum(1, keepdims=True)).mean(0)
            assert any(lang == field.languages[share.argmax()] and abs(x - min(1, share.max())) < 1e-5 for lang, x in got[r.doc_id])
            n += 1
    assert n > 60


def test_dual_descent_reaches_the_optimum():
    """Against a fine gradient descent of the same objective."""
    rng = np.random.default_rng(0)
    held = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(60)]
    y = np.where(np.array([h[0] + h[1] for h in held]) > 7, 1.0, -1.0)
    r = rng.normal(size=20)
    w, b = nbsvm_quality.descend(held, y, r, rounds=400)
    x = np.zeros((60, 21))
    for i, h in enumerate(held):
        x[i, h] = r[h] / np.sqrt((r[h] ** 2).sum())
    x[:, 20] = 1
    cost = nbsvm_quality.PENALTY * 60 / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    v = np.zeros(21)
    for _ in range(30_000):
        v -= 0.002 * (v - x.T @ (2 * cost * y * np.maximum(0, 1 - y * (x @ v))))
    assert value(np.append(w, b)) <= value(v) + 1e-3


def test_language_held_out(learned):
    rows, docs, _ = learned
    got = {r.doc_id: r for r in crf_language.predictions(docs, crf_language.train(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        e, a, pi = rng.random((n, 2)) + 0.05, rng.random((2, 2)) + 0.05, np.array([0.3, 0.7])
        reset = rng.random(n) < 0.3
        reset[0] = True
        want = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=n):
            p = np.prod([e[t, s] * (pi[s] if reset[t] else a[path[t - 1], s]) for t, s in enumerate(path)])
            for t, s in enumerate(path):
                want[t, s] += p
        want /= want.sum(1, keepdims=True)
        for column in (1, 2, 3, 128):
            assert np.abs(crf_language.scan(e, reset, a, pi, column)[1] - want).max() < 1e-9


def test_gradient_of_the_field_by_differences():
    """Against differences of the log-likelihood, which is summed over all label sequences."""
    rng = np.random.default_rng(7)
    segments = [["un", "deux"], ["ein"], ["one", "two", "one"], ["zwei", "ein"]]
    langs, k = [0, 1, 2, 1], 3
    lexicon = {"ein": [77], "one": [78]}
    chains = crf_language.Chains.of(segments, langs, lexicon, k, chain=2)
    weights = chains.weights()
    v = rng.normal(size=len(weights.value)) * 0.3
    moves = [rng.normal(size=k) for _ in range(4)]
    words = [x for some in segments for x in some]

    def likelihood(v, stay, leave, enter, s):
        w = dataclasses.replace(weights, value=v)
        score = [w[crf_language.word_features(x, lexicon)].sum(0) for x in words]
        t = np.where(np.eye(k) > 0, stay, leave[:, None] + enter)

        def path(labels, at):
            return sum(score[i][c] + (s[c] if chains.reset[i] else t[labels[j - 1], c]) for j, (i, c) in enumerate(zip(at, labels)))

        total, starts = 0.0, [*np.flatnonzero(chains.reset), len(words)]
        for a, b in zip(starts, starts[1:]):
            at = range(a, b)
            every = [path(labels, at) for labels in itertools.product(range(k), repeat=b - a)]
            total += path(chains.y[a:b], at) - np.logaddexp.reduce(every)
        return total

    got = chains.gradient(dataclasses.replace(weights, value=v), crf_language.Moves(*moves))
    places = [(0, i) for i in range(0, len(v), 3)] + [(which, i) for which in range(1, 5) for i in range(k)]
    for which, at in places:
        value = []
        for step in (1e-5, -1e-5):
            moved = [v.copy(), *(x.copy() for x in moves)]
            moved[which][at] += step
            value.append(likelihood(*moved))
        assert got[which][at] == pytest.approx((value[0] - value[1]) / 2e-5, abs=1e-5)
    whole = [x.copy() for x in got]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(crf_language, "BLOCK", 5)  # a chain at a time, some pairs at a time
        parts = dataclasses.replace(chains).gradient(dataclasses.replace(weights, value=v), crf_language.Moves(*moves))
    assert all(np.allclose(a, b, atol=1e-10) for a, b in zip(whole, parts))


def _many_languages(n, seed=31):
    """Segments of n languages, each with three words and an ending of its own."""
    rng = random.Random(seed)
    some = lambda size: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    words = {f"l{i:04}": [some(4) + end for _ in range(3)] for i in range(n) for end in [some(3)]}
    pairs = [(lang, [rng.choice(own) for _ in range(rng.randint(2, 6))]) for lang, own in words.items() for _ in range(3)]
    rng.shuffle(pairs)
    return words, [x for _, x in pairs], [x for x, _ in pairs]


def test_texts_aside_equal_texts_together(monkeypatch):
    """Without transfer matrices, in short columns and small groups, the posteriors are the same."""
    words, segments, langs = _many_languages(5)
    field = crf_language.fit(segments, langs, steps=10)
    rng = random.Random(4)
    own = [w for some in words.values() for w in some]
    texts = [" ".join(rng.choice(own) for _ in range(n)) for n in (1, 3, 7, 8, 30, 61)] + [None, "12"]
    want = list(field.posteriors(texts))
    assert [x[0] for x in want] == list(range(6))
    monkeypatch.setattr(crf_language, "FEW", 0)
    for column, block in ((1, 1), (7, 80), (8, 1 << 20), (128, 1 << 20)):
        monkeypatch.setattr(crf_language, "COLUMN", column)
        monkeypatch.setattr(crf_language, "BLOCK", block)
        got = list(dataclasses.replace(field).posteriors(texts))
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[0] == b[0] and all(np.allclose(x, y, atol=1e-9) for x, y in zip(a[1:], b[1:]))


def test_hundreds_of_languages():
    """The model grows with the sample: weights only of pairs that it holds; each language is found again."""
    words, segments, langs = _many_languages(300)
    field = crf_language.fit(segments, langs, steps=15)
    held = {(f, lang) for some, lang in zip(segments, langs) for w in some for f in crf_language.word_features(w, field.lexicon)}
    assert len(field.languages) == 300 and len(field.weights.value) == len(held) < 20_000
    found = field.label([" ".join(own * 2) for own in words.values()])
    assert sum(a == b for (a, _), b in zip(found, words)) >= 295


def test_rare_languages_are_learned(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(word(rng, "en" if i % 100 else "de") for _ in range(20)), "en" if i % 100 else "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    field = crf_language.train(docs, most=200)
    assert field.languages == ["de", "en"] and field.label([" ".join(word(rng, "de") for _ in range(20))])[0][0] == "de"


def test_stretches_of_one_language(spark, learned, hard):
    field = crf_language.train(learned[1])
    rng = random.Random(8)
    french, german = (" ".join(word(rng, x) for _ in range(40)) for x in ("fr", "de"))
    text = f"¿ 12 {french} 7 -- {german} ½"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "½ 12"), (4, "")], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.start, r.end, r.lang, r.posterior) for r in crf_language.switches(docs, field).collect())
    assert {f[0] for f in found} == {1} and all(0 < f[4] <= 1 for f in found)
    assert found[0][1] == 5 and found[-1][2] == len(text) - 2 and all(a[2] < b[1] and a[3] != b[3] for a, b in zip(found, found[1:]))
    middle = len(text) // 2
    most = lambda spans, lang: sum(b - a for _, a, b, x, _ in spans if x == lang)
    assert most([f for f in found if f[2] < middle + 40], "fr") > 0.8 * len(french) and most([f for f in found if f[1] > middle - 40], "de") > 0.8 * len(german)
    (want,) = [best for _, _, best, _, _ in field.posteriors([text])]
    assert len(want) == 80 and sum((f[4] * 1 for f in found)) > 0
    assert crf_language.switches(hard, field).where("end <= start or start < 0").count() == 0


@pytest.mark.parametrize("text", ["½ Ⅷ", "①", "Ⅷ", "½", "12 ٣ ²", "¾-⅓", "_ Ⅳ_ 7½"])
def test_numbers_are_no_letters(learned, text):
    field = crf_language.train(learned[1])
    assert field.label([text, "the", text])[0] == field.label([text])[0] == ("und", 0.0)


def test_code_switches_are_seen(learned):
    rng = random.Random(6)
    segments, langs = [], []
    for _ in range(600):
        lang = rng.choice(list(SYLLABLES))
        segments.append([word(rng, lang) for _ in range(rng.randint(3, 20))])
        langs.append(lang)
    field = crf_language.fit(segments, langs)
    assert all(field.transitions[i, i] > field.transitions[i, j] for i in range(3) for j in range(3) if i != j)
    mixed = " ".join([word(rng, "fr") for _ in range(30)] + [word(rng, "de") for _ in range(10)])
    (lang, share), *_ = field.label([mixed])
    assert lang == "fr" and 0.6 < share < 0.9


def test_hard_rows(spark, hard, empty, labels):
    for docs in (hard, empty):
        n = docs.count()
        toxic = toxic_channel.scores(docs, toxic_channel.train(docs, labels)).collect()
        good = nbsvm_quality.scores(docs, nbsvm_quality.train(docs, labels)).collect()
        langs = crf_language.predictions(docs, crf_language.train(docs)).collect()
        assert len(toxic) == len(good) == len(langs) == n
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in toxic + good)
        texts = Counter((r.doc_id, r.text) for r in docs.collect())
        unknown = sum(c for (_, t), c in texts.items() if not any(x.isalpha() for x in t or ""))
        assert sum(r.lang_pred == "und" and r.score == 0 for r in langs) == unknown
    assert toxic_channel.train(hard, labels.limit(0)).score("anything") == 0.5
    assert nbsvm_quality.train(hard, labels.limit(0)).score(None) == 0.5
    assert crf_language.predictions(hard, crf_language.train(hard.where("lang is null"))).where("lang_pred <> 'und'").count() == 0

"""Benchmark windows, exact whitening and the prefix trie against brute force, on rows that are hard on purpose."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondine.llm import benchmark_overlap, exact_whitening, prefix_trie


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns or df.columns) for r in df.collect())


# op11


def split(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_overlaps(docs, items, size=10):
    """Rows of the contract from lists of (id, text)."""
    parts = defaultdict(set)
    for name, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            parts[tuple(w[i : i + size])].add(name)
    lengths = {len(p) for p in parts}
    out = Counter()
    for name, text in docs:
        w, hit, found = split(text), set(), set()
        for i in range(len(w)):
            for n in lengths:
                if i + n <= len(w) and (own := parts.get(tuple(w[i : i + n]))):
                    hit |= set(range(i, i + n))
                    found |= own
        ids = sorted(str(f) for f in found if f is not None)
        out[name, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    return out


def overlap_tables():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abé漢Z9", k=rng.randint(1, 3)))
    long = [[word() for _ in range(rng.randint(10, 60))] for _ in range(12)]
    items = [(i, " ".join(w)) for i, w in enumerate(long)]
    items += [(100, "only three words"), (101, "yes"), (102, None), (103, ""), (104, "..."), (None, "an item that has no number but text enough for three whole windows"), (0, "second text of an item whose number comes twice, which is one item"), (105, " ".join(long[0])), (100, "only three words"), (106, "same same same same same same same same same same same same")]
    docs = [(1, None), (2, ""), (3, "!?"), (4, "Yes, YES; yes"), (5, "only THREE words and only three"), (None, items[3][1]), (6, "same " * 30), (7, "an item that has no number but text enough for three whole windows")]
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            own = rng.choice(long)
            a = rng.randint(0, len(own) - 1)
            parts += own[a : a + rng.randint(1, 40)] + [word() for _ in range(rng.randint(0, 5))]
        docs.append((rng.randint(0, 40), rng.choice([" ", "\n", ", ", "\x7f", " - "]).join(parts)))
    docs.append((50, " ".join(" ".join(own) for own in long * 40)))  # one stretch after the other, longer than a record holds
    docs += [docs[20], docs[20]]
    return docs, items


@pytest.mark.parametrize("limit", [benchmark_overlap.BROADCAST_BYTES, 0])
def test_overlaps_against_brute_force(spark, limit):
    docs, items = overlap_tables()
    table = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id bigint, text string, row string, words int").repartition(3)
    found = benchmark_overlap.overlaps(table, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n int"), broadcast_bytes=limit)
    want = brute_overlaps(docs, items)
    assert rows(benchmark_overlap.digests(found), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert sum(w[5] * n for w, n in want.items()) > 40


@pytest.mark.parametrize("size", [1, 7])
def test_overlaps_of_other_sizes(spark, size):
    docs, items = overlap_tables()
    found = benchmark_overlap.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), size=size)
    assert rows(benchmark_overlap.digests(found)) == brute_overlaps(docs, items, size)
    for r in found.where(F.size("spans") > 0).collect():
        assert all(s.words <= size and s.start + s.words <= r.n_words for s in r.spans)


def test_overlaps_of_nothing(spark):
    docs, items = overlap_tables()
    table, none = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert rows(benchmark_overlap.digests(benchmark_overlap.overlaps(table, none))) == brute_overlaps(docs, [])
    assert not benchmark_overlap.overlaps(table.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).collect()


def test_clean_keeps_what_is_not_hit(spark):
    docs, items = overlap_tables()
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, items string")
    kept = benchmark_overlap.clean(table, spark.createDataFrame(items, "item_id bigint, text string"))
    free = {w[:1] + w[1:2] for w in brute_overlaps(docs, items) if not w[5]}
    want = Counter((i, t, "x") for i, t in docs if not next(iter(brute_overlaps([(i, t)], items)))[5])
    assert kept.columns == table.columns and rows(kept) == want and free


def test_every_window_stands_in_a_stretch():
    rng = random.Random(4)
    for _ in range(200):
        size = rng.randint(1, 9)
        text = " ".join(rng.choices("abc", k=rng.randint(0, 80))).encode()
        item = " ".join(rng.choices("abc", k=rng.randint(1, 30))).encode()
        words, own = text.split(), item.split()
        marks = np.zeros((1 << benchmark_overlap.FILTER_BITS) // 8, np.uint8)
        w = min(size, len(own))
        for b in benchmark_overlap.bits_of(benchmark_overlap.word_hashes(item), min(benchmark_overlap.SHINGLE, w)).tolist():
            marks[b >> 3] |= 1 << (b & 7)
        spans = benchmark_overlap.stretches(benchmark_overlap.word_hashes(text, piece=3), marks, [w], size, longest=size + 4)
        for i in range(len(words) - w + 1):
            if any(words[i : i + w] == own[j : j + w] for j in range(len(own) - w + 1)):
                assert any(a <= i and i + w <= b for _, a, b in spans)
        assert all(b - a <= size + 4 for _, a, b in spans)
        assert [p["words"] for p in benchmark_overlap._read(text, spans)] == [[x.decode() for x in words[a:b]] for _, a, b in spans]


# op12


def brute_whitening(vectors, components=8):
    """Rows (vec_id, component) -> (n, deviation, whitened, explained) from a list of (id, vector)."""
    use = [(i, v) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for _, v in use]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3 for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(v))
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for (name, _), r in zip(use, x):
        y = np.array([(n * a - b) / n for a, b in zip(r, s)])
        for k in range(len(e)):
            out[name, k + 1] = (n, sum((n * a - b) ** 2 for a, b in zip(r, s)), float(y @ u[:, k] / np.sqrt(e[k])), e[k] / np.trace(v))
    return out


def checked_whitening(made, want):
    got = made.collect()
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    signs = {}
    for r in got:
        n, deviation, value, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation if deviation < 1 << 63 else None)
        assert r.explained == pytest.approx(share, rel=1e-9)
        sign = signs.setdefault(r.component, 1 if r.whitened * value > 0 else -1) if abs(value) > 0.1 else signs.get(r.component)
        if sign:
            assert r.whitened == pytest.approx(sign * value, rel=1e-6, abs=1e-6)
        assert r.identity_error < 1e-9


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) @ rng.normal(size=(12, 12))
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, []), (1005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "e", 1) for i, v in data + bad], "vec_id bigint, embedding array<float>, component string, n int").repartition(5)
    checked_whitening(exact_whitening.rows(table), brute_whitening(data))


@pytest.mark.parametrize("scale", [1e9, 1e15, 1e150])
def test_whitening_of_any_size(spark, scale):
    """Offsets that lose every digit of the difference in doubles' products, and entries beyond a long."""
    rng = np.random.default_rng(2)
    data = [(i, [float(c) for c in scale * (1 + 1e-3 * rng.normal(size=5) * np.arange(1, 6))]) for i in range(40)]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(3)
    got = {(r.vec_id, r.component): r for r in exact_whitening.rows(table).collect()}
    x = [[int(np.floor(c * 1024)) if c < 1e300 else int(c) * 1024 for c in v] for _, v in data]
    n, s = len(x), [sum(r[j] for r in x) for j in range(5)]
    for i, r in enumerate(x):
        deviation = sum((n * a - b) ** 2 for a, b in zip(r, s))
        assert {got[i, k].deviation for k in range(1, 6)} == {deviation if deviation < 1 << 63 else None}
    assert max(r.identity_error for r in got.values()) < 1e-9
    assert sum(got[0, k].explained for k in range(1, 6)) == pytest.approx(1)


def test_whitening_without_variance(spark):
    make = lambda data: exact_whitening.rows(spark.createDataFrame(data, "vec_id bigint, embedding array<float>")).collect()
    assert make([]) == [] and make([(1, None), (2, [])]) == []
    alone = make([(None, [1.0, 2.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(None, k, 1, 0, 0.0, 0.0, 0.0) for k in (1, 2)]
    line = make([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (2, [1.0, 5.0])])
    assert [round(r.whitened, 9) for r in line if r.component == 2] == [0.0] * 3 and {round(r.explained, 9) for r in line if r.component == 1} == {1.0}


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for size in (10, 1 << 20, 1 << 30, 1 << 52):
        x = rng.integers(-size, size, (50, 4))
        sums, products = exact_whitening.scatter(x)
        plain = x.tolist()
        assert sums.tolist() == [sum(r[j] for r in plain) for j in range(4)]
        assert products.tolist() == [[sum(r[i] * r[j] for r in plain) for j in range(4)] for i in range(4)]
    for v in (0, 5, -5, 1 << 200, -(1 << 47) - 3):
        assert sum(limb << (exact_whitening.LIMB * place) for place, limb in exact_whitening.limbs(v)) == v


# op13


def brute_rebuilt(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute_trie(made):
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    ends = {n: ",".join(str(c) for c in m if len(made[c]) == len(n)) for n, m in members.items()}
    return Counter((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items())


def conversations():
    rng = random.Random(6)
    out = []
    for c in [*range(40), *range(100, 130), *range(250, 290), -3, -100, -120, 2000]:  # 200 is absent
        for t in range(rng.randint(1, 9)):
            out.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é\U0001f642"])))
    out += [(c, t, "user", f"turn {t}") for c in range(300, 312) for t in range(c - 299)]  # each the one before and a turn more
    out += [(c, t, "user", "copy") for c in range(400, 420) for t in range(4)]
    out += [(900, t, "user", str(t % 7)) for t in range(300)]
    out += [(5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "b"), (None, 1, "user", "x"), (None, None, None, None)]
    rng.shuffle(out)
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string"


def checked_trie(spark, turns):
    table = spark.createDataFrame([(*t, "x", 1) for t in turns], TURNS + ", depth string, node int").repartition(3)
    made = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(table)))
    got = rows(made, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert got == brute_trie(brute_rebuilt(turns))
    assert [t for _, t in made.dtypes] == ["bigint"] * 7 + ["string"]


def test_trie_against_brute_force(spark):
    checked_trie(spark, conversations())


def test_trie_of_little(spark):
    table = spark.createDataFrame([], TURNS)
    assert not prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(table))).collect()
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    checked_trie(spark, [(turnless, 0, "user", "x")])
    checked_trie(spark, [(turnless, 0, "user", "x"), (100, 0, None, None)])


def test_trie_of_conversations_as_they_are(spark):
    """Without openings of others: snapshots of one dialogue, each hanging below the one before."""
    turns = [(c, t, "user", f"turn {t}") for c in range(20) for t in range(c + 1)]
    own = prefix_trie.numbered(spark.createDataFrame(turns, TURNS))
    made = prefix_trie.trie(own, own.groupBy("conv").agg(F.max("depth").alias("length")))
    plain = {c: [("user", f"turn {t}") for t in range(c + 1)] for c in range(20)}
    assert rows(made) == brute_trie(plain)


def test_trie_ends_in_pieces(spark, monkeypatch):
    ids = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("node"), F.col("id").alias("conv"))
    got = {bytes(r.node): r.ends for r in prefix_trie.ends_hashes(ids).collect()}
    assert got == {n: hashlib.sha256(",".join(str(i) for i in range(30_000) if (i % 3 > 0) == (n == b"a")).encode()).hexdigest() for n in (b"a", b"b")}

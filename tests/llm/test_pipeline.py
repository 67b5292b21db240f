"""Each stage of the pipeline on its own input, and the entry module without the folder."""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import subprocess
import sys
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ondine.llm import fair_mix, minhash_groups, secret_owners, toxic_channel
from ondine.llm._common import documents, labels, staged
from test_exact import brute_groups, brute_spans

SF = "/root/testdata/sf0.001"


def keys(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_take_effect(spark):
    docs = documents(spark, SF)
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(staged(stage(spark, outs[-1], SF), "test"))
        if name != "bpe":
            assert outs[-1].dtypes == docs.dtypes
    clean, single, cut, mixed, encoded = outs[1:]
    scores = {r.doc_id: r.predicted for r in toxic_channel.scores(docs, toxic_channel.train(docs, labels(spark, SF))).collect()}
    assert keys(clean) == Counter({k: n for k, n in keys(docs).items() if scores[k[0]] == 0})
    kept = {r.doc_id for r in minhash_groups.near_duplicates(clean, 5).where("kept").collect()}
    assert {r.doc_id for r in single.collect()} == kept
    assert cut.count() == single.count() and all("<secret>" in t or (i, t) in keys(single) for i, t in keys(cut))
    live = {r.doc_id for r in secret_owners.scan(single).where("n_live > 0").collect()}
    assert {i for i, t in keys(cut) if "<secret>" in (t or "")} == live
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    taken = {r.doc_id: r.taken // r["size"] for r in fair_mix.mix(cut).where("size > 0").collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter(taken)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    assert Counter((r.doc_id, struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in encoded.collect()) == want


def test_last_stage_decodes_its_ids(spark, hard):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in hard.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    made = corpus_pipeline.encode(spark, hard, SF).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in made) == want
    assert __spark_entry__.queries()["pipeline"](spark, SF).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_stages_on_hard_rows(spark, hard, empty):
    """Each stage on what the one before kept of nulls, empty and long texts, repeated rows and clashing names, against brute force."""
    model = toxic_channel.train(hard, labels(spark, SF))
    clean = staged(corpus_pipeline.drop_toxic(spark, hard, SF), "test")
    assert rows(clean) == rows(hard, lambda r: model.score(r.text) < 0.5)
    single = staged(corpus_pipeline.drop_near_duplicates(spark, clean, SF), "test")
    kept = {(i, n) for i, n, _, keep in brute_groups(clean.collect(), 5) if keep and n}
    some = [r for r in single.collect() if (r.text or "").split()]
    assert {r.doc_id for r in some} == {i for i, _ in kept} and not rows(single) - rows(clean)
    assert len(some) == sum(n for (i, k, _, keep), n in brute_groups(single.collect(), 5).items() if k)
    blank = lambda r: not (r.text or "").split()
    assert rows(single, blank) == rows(clean, blank)
    cut = staged(corpus_pipeline.cut_secrets(spark, single, SF), "test")
    assert cut.columns == hard.columns and cut.count() == single.count()
    for r in cut.collect():
        assert (r.doc_id, r.text) in keys(single) or "<secret>" in r.text
        assert r.n_chars == (None if r.text is None else len(r.text)) and not brute_spans(r.text)
    assert "n_chars" not in corpus_pipeline.cut_secrets(spark, single.drop("n_chars"), SF).columns
    mixed = staged(corpus_pipeline.mix_sources(spark, cut, SF), "test")
    taken = Counter()
    for r in fair_mix.mix(cut).collect():
        taken[r.doc_id] += r.taken // r["size"] if r["size"] else 0
    assert mixed.columns == hard.columns and Counter(r.doc_id for r in mixed.collect() if not blank(r)) == +taken
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in mixed.collect())
    encoded = corpus_pipeline.encode(spark, mixed, SF)
    assert Counter((r.doc_id, struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in encoded.collect()) == want
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def rows(df, keep=lambda r: True):
    return Counter(tuple(r) for r in df.collect() if keep(r))


def test_run_agrees_with_the_stages(spark):
    made = corpus_pipeline.run(spark, SF)
    again = corpus_pipeline.run(spark, SF)
    assert made.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert Counter((r.doc_id, bytes(r.ids)) for r in made.collect()) == Counter((r.doc_id, bytes(r.ids)) for r in again.collect())


def test_the_rest_stands_without_the_folder(tmp_path):
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(top, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=clean)
    shutil.copytree(os.path.join(top, "ondine/llm"), tmp_path / "r/ondine/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert sum(k.startswith('op') for k in q) == 13 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=clean)
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, env=clean)

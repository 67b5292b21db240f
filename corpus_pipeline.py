"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns
of documents. A row that is toxic goes, of near-duplicates one row stays, live-looking secrets are cut from the texts, sources
are mixed to their targets by repeating and leaving out rows, and what is left is encoded and decoded again.

Null texts count as empty: the model's bias scores them, they are no one's duplicate, hold no secret and have size 0, so the mix
repeats them as often as what stands beside them in its queue. Null ids and sources are values of their own. Rows that agree in id and text are duplicates, of which
one stays; rows that share only an id are documents of their own. Very long texts are worked on whole. Further columns pass through all stages but
the last, whatever their names; ``n_chars`` follows the text where it is there. Without rows every stage returns none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondine.llm import fair_mix, forced_bpe, minhash_groups, secret_owners, toxic_channel
from ondine.llm._common import documents, labels, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the scorer, trained on the labelled ones among ``docs``, calls toxic go."""
    return toxic_channel.clean(docs, toxic_channel.train(docs, labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more; the row of the least id stays."""
    return minhash_groups.deduplicated(docs, words=5, percent=80)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by a mark, and n_chars follows; no row goes."""
    cut = secret_owners.redacted(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them."""
    return fair_mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the sha256 of the text that they decode to."""
    made = forced_bpe.roundtrip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", cut_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: Model decisions, components and encodings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents one after the other; each but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs

"""The queries of the operators and their SQL, as the driver's entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ondine.llm import audio_columns, benchmark_overlap, block_neighbours, crf_language, exact_whitening, fair_mix, forced_bpe, minhash_groups, nbsvm_quality, prefix_trie, secret_owners, toxic_channel, wavelet_store
from ondine.llm._common import documents, labels


def op1_toxic_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxic_channel.scores(docs, toxic_channel.train(docs, labels(spark, sf_dir)))


def op2_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op4_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_store.read(wavelet_store.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return crf_language.predictions(docs, crf_language.train(docs))


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return nbsvm_quality.scores(docs, nbsvm_quality.train(docs, labels(spark, sf_dir)))


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(documents(spark, sf_dir))


def op9_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_owners.scan(documents(spark, sf_dir))


def op10_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_columns.digests(audio_columns.store(documents(spark, sf_dir)))


def op11_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlap.digests(benchmark_overlap.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_whitening.rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxic_channel": op1_toxic_channel,
    "op2_block_neighbours": op2_block_neighbours,
    "op3_minhash_groups": op3_minhash_groups,
    "op4_wavelet_ids": op4_wavelet_ids,
    "op5_bpe_roundtrip": op5_bpe_roundtrip,
    "op6_crf_language": op6_crf_language,
    "op7_nbsvm_quality": op7_nbsvm_quality,
    "op8_fair_mix": op8_fair_mix,
    "op9_secret_owners": op9_secret_owners,
    "op10_audio_columns": op10_audio_columns,
    "op11_benchmark_overlap": op11_benchmark_overlap,
    "op12_exact_whitening": op12_exact_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {"op2_block_neighbours": block_neighbours.SQL, "op8_fair_mix": fair_mix.SQL, "op9_secret_owners": secret_owners.SQL, "op11_benchmark_overlap": benchmark_overlap.SQL, "op13_prefix_trie": prefix_trie.SQL}

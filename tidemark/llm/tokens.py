"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settled

#: Vocabulary file; read by the driver and sent to the workers, so that only the driver needs it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts per Arrow batch; bounds what a Python worker holds at once.
BATCH_TEXTS = 500

_loaded: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file's contents; kept per process."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _loaded[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Keeps Arrow batches small enough for long texts in what is run inside; later queries have their own setting again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(docs: DataFrame) -> DataFrame:
    """Texts of an input of fewer partitions than cores, such as one small file, are dealt out; others pass as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def token_counts(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of the whole ``text``; null and empty texts have none. Counted once and settled.

    Special tokens are not read as such: their strings are ordinary text.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(sent.value)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int32")

    with text_batches(docs.sparkSession):
        return settled(spread(docs.select(*keep, "text")).select(*keep, count("text").alias("n_tokens")))

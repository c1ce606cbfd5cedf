"""Public byte-level tokenizers inside tasks. The path of the vocabulary is a parameter; every executor reads it there."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how the byte-level vocabularies of this kind split a text before merging.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a file of ranks, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token."""
    enc = encoding(path)
    out = np.zeros(enc.n_vocab, np.int64)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out


def encoded(text: str, path: str) -> list[int]:
    """Tokens of a text; a lone surrogate counts as the replacement character."""
    return encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8"))


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens; null and empty texts have none."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encoded(t, path)) if t else 0).astype("int32")

    return counted(text)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the files give fewer partitions than there are; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

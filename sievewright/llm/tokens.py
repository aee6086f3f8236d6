"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Place of the ranks, for the driver only: the file is sent to the workers. Queries take another as a parameter.
RANKS = os.environ.get("SIEVEWRIGHT_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how this tokenizer cuts text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(name: str):
    """The tokenizer of a rank file that the session has sent, loaded once per worker."""
    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, path: str = RANKS) -> Column:
    """Tokens of a text as a long; null and empty texts have none. The rank file at `path` is sent to all workers."""
    SparkSession.active().sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(name)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)

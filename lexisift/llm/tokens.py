"""Tokens of a public tokenizer. The vocabulary file's path is a parameter and must lie at the same place on every node."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens; 0 for null and empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for b in batches:
            yield pd.Series([len(enc.encode_ordinary(x)) if x else 0 for x in b], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")(text)

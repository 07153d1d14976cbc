"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files on every machine, and the file used unless another is named.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# How that byte-level vocabulary splits a text before merging; fixed by the published tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, columns: list[str], text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``columns`` and ``n_tokens`` of each row; null and empty texts have 0. Whole texts, whatever their length."""
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens int"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            yield b[columns].assign(n_tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b["_text"]])

    return docs.select(*columns, F.col(text).alias("_text")).mapInPandas(count, schema)

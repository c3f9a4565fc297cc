"""Token counts of a public tokenizer, per Arrow batch."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DEFAULT_RANKS = os.environ.get("LOOMSPAN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published split pattern of this family of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per Python worker: from the session's files if it was shipped, else from its place."""
    import tiktoken
    from pyspark import SparkFiles

    try:
        shipped = SparkFiles.get(os.path.basename(path))
    except Exception:  # outside a session
        shipped = path
    with open(shipped if os.path.exists(shipped) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship(spark: SparkSession, path: str) -> None:
    """Gives the rank file to all executors, which need not have it at the driver's path."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


def token_count(text: Column, path: str = DEFAULT_RANKS) -> Column:
    """Tokens of the whole text; 0 for null and empty. The rank file is shipped with the active session's files."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark, path)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int32")

    return count(text)

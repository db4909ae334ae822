"""Public tokenizers from vocabulary files, as Arrow-batched functions.

The file's path must be readable on every executor. A ``.tiktoken`` file has a token in base64 and its
rank a line.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

#: How text is cut before pairs of bytes are merged.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def load(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    """A pandas UDF from text to ids; NULL and "" have none."""

    @F.pandas_udf("array<int>")
    def udf(texts: pd.Series) -> pd.Series:
        enc = load(path)
        return pd.Series(enc.encode_ordinary_batch([t or "" for t in texts], num_threads=1))

    return udf


def decoder(path: str):
    """A pandas UDF from ids to text; ids that are cut amid a character give a replacement mark."""

    @F.pandas_udf("string")
    def udf(ids: pd.Series) -> pd.Series:
        enc = load(path)
        return ids.map(lambda x: enc.decode([int(i) for i in x]) if x is not None else None)

    return udf


def token_chunks(df, text: str, path: str, size: int = 200, overlap: int = 20):
    """``df`` with chunk_id (from 0 in each row) and chunk_text: windows of a tokenizer's tokens, decoded."""
    from textloom.operators.chunking import window_count

    rows = df.withColumn("_t", encoder(path)(text)).where(F.size("_t") > 0)
    cut = F.transform(F.sequence(F.lit(0), window_count(F.size("_t"), size, overlap) - 1), lambda i: F.slice("_t", i * (size - overlap) + 1, F.lit(size)))
    parts = rows.select(*df.columns, F.posexplode(cut).alias("chunk_id", "_c"))
    return parts.withColumn("chunk_text", F.trim(F.regexp_replace(decoder(path)("_c"), r"\s+", " "))).drop("_c")

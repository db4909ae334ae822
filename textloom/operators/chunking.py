"""Windows of tokens with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 200, 20


def window_count(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of n tokens: none for 0, one up to ``size``; a window that reaches the end is the last."""
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("int")


def token_windows(df: DataFrame, tokens: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row for each window of each row: chunk_id from 0, chunk_text joined by blanks.

    Rows without tokens give none.
    """
    n = F.size(tokens)
    k = window_count(n, size, overlap)
    cut = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.array_join(F.slice(tokens, i * (size - overlap) + 1, F.lit(size)), " "))
    return df.where(n > 0).select("*", F.posexplode(cut).alias("chunk_id", "chunk_text"))

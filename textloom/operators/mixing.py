"""Mixing, splitting and resampling of datasets, seeded by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.sequence import with_ordinal


def shuffle_key(seed: int, key: Column) -> Column:
    """A pseudo-random key that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def numbered(df: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Each row's place ``rn`` in its source from 0, the source's size ``n`` and rank ``source_ord``."""
    rows = with_ordinal(df.where(F.col(source).isNotNull()), order, source, "rn")
    sizes = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count("*").alias("n"))
    ranks = with_ordinal(sizes, [source], name="source_ord")
    return rows.join(ranks, source)


def interleave_under(rows: DataFrame) -> DataFrame:
    """Round robin until the shortest source ends."""
    return rows.crossJoin(F.broadcast(rows.agg(F.min("n").alias("least")))).where("rn < least").drop("least")  # one row


#: A row that is repeated more often than this is spread over as many rows as it has such rounds.
ROUNDS = 4096


def repeated(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``name``.

    A row that is repeated very often first becomes a row for each ROUNDS repeats and is dealt out to
    all tasks, so no task writes more than ROUNDS copies of a row it is given.
    """
    held = rows.withColumn("_times", times.cast("long")).where("_times > 0")
    blocks = held.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / ROUNDS))))
    few, many = blocks.where(F.col("_times") <= ROUNDS), blocks.where(F.col("_times") > ROUNDS).repartition("_block")
    spread = few.unionByName(many)
    last = F.least(F.col("_times") - F.col("_block") * ROUNDS, F.lit(ROUNDS)) - 1
    spread = spread.withColumn("_in", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return spread.withColumn(name, F.col("_block") * ROUNDS + F.col("_in")).drop("_times", "_block", "_in")


def interleave_over(rows: DataFrame) -> DataFrame:
    """Round robin until the longest source ends; shorter ones begin again. ``pos`` is the round."""
    most = rows.agg(F.max("n").alias("most"))
    again = rows.crossJoin(F.broadcast(most))  # one row
    out = repeated(again, F.floor((F.col("most") - 1 - F.col("rn")) / F.col("n")) + 1, "turn")
    return out.withColumn("pos", F.col("turn") * F.col("n") + F.col("rn")).drop("turn", "most")


def interleave_drawn(rows: DataFrame, weights: dict[str, float], source: str, seed: int, default: float = 1.0) -> DataFrame:
    """``pos``: the order of a draw by weights; a row's key is exponential with its source's rate.

    A source without a weight has ``default``; one with a weight of 0 is left out.
    """
    u = (F.conv(F.substring(shuffle_key(seed, F.concat_ws(":", F.col(source), F.col("rn"))), 1, 13), 16, 10).cast("double") + 1) / float(16**13 + 1)
    rate = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(source))
    rate = F.coalesce(rate, F.lit(float(default)))
    return rows.where(rate > 0).withColumn("pos", -F.log(u) / rate)


def split(df: DataFrame, key: str, size: float, seed: int) -> DataFrame:
    """``df`` with ``split``: validation for the first ``size`` rows by seeded hash (a share where
    under 1, rounded up), train for the rest."""
    rows = with_ordinal(df.withColumn("_h", shuffle_key(seed, F.col(key))), ["_h", key])
    if size > 1:
        take = F.lit(int(size))
        return rows.withColumn("split", F.when(F.col("_ord") < take, "validation").otherwise("train")).drop("_h", "_ord")
    total = df.agg(F.ceil(F.count("*") * F.lit(size)).alias("_take"))
    return rows.crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col("_ord") < F.col("_take"), "validation").otherwise("train")).drop("_h", "_ord", "_take")  # one row


def resample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows: a seeded permutation's prefix; beyond the size, whole rounds and then a prefix."""
    rows = with_ordinal(df.withColumn("_h", shuffle_key(seed, F.col(key))), ["_h", key])
    total = df.agg(F.count("*").alias("_total"))
    copies = rows.crossJoin(F.broadcast(total))  # one row
    times = F.floor((F.lit(n) - 1 - F.col("_ord")) / F.col("_total")) + 1
    return repeated(copies.where(F.col("_ord") < n), times, "copy").drop("_h", "_ord", "_total")

"""Tables with a key: insert where absent, append with ids, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.sequence import with_ordinal


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; combined before the shuffle, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in (key, *order)]
    held = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_m"))
    return held.select(key, *[F.col("_m")[c].alias(c) for c in [*order, *rest]]).select(*df.columns)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``existing`` and the rows of ``new`` whose key it lacks; of equal new keys the first by
    ``order``. NULL keys are not inserted; no new rows change nothing."""
    fresh = first_per_key(new.where(F.col(key).isNotNull()), key, order).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def append_messages(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` with ids that go on from the greatest of ``existing``; other roles are refused."""
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m"))
    good = new.where(F.col("role").isin("user", "assistant"))
    return with_ordinal(good, order).crossJoin(F.broadcast(start)).withColumn("id", F.col("_ord") + F.col("_m") + 1).drop("_ord", "_m")  # one row


def oldest(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their place; the limit runs before the shuffle."""
    w = Window.partitionBy(group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def history(df: DataFrame, session: str | None = None, user: str | None = None) -> DataFrame:
    """The messages of a session, of a user, or of both; equality in the scan, so files can be skipped."""
    for column, value in (("session_id", session), ("user_id", user)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def write_indexed(df: DataFrame, path: str, columns: list[str], partitions: int | None = None) -> None:
    """A table sorted by ``columns`` in ranges, so that a filter on them skips files by their statistics;
    what an index of those columns is for."""
    by = [F.col(c).asc_nulls_first() for c in columns]
    rows = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    rows.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def stamped(df: DataFrame, column: str = "created_at") -> DataFrame:
    """``df`` with the time of the query where the column is missing or NULL."""
    return df.withColumn(column, F.coalesce(F.col(column), F.current_timestamp()) if column in df.columns else F.current_timestamp())

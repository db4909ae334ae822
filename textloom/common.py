"""Helpers that every operator shares: reading, de-duplicating, cutting lineage, Arrow mappers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: For ASCII: letters in lower case and digits stay, the rest becomes a blank.
ASCII_WORDS = {i: (chr(i).lower() if chr(i).isalnum() else " ") for i in range(128)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of the folder ``sf_dir`` (one file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests, one machine) a temporary folder is made and set.
    """
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = jdir.get() if jdir.isDefined() else None
    if not held:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(held)
    return held


#: Folders of intermediate tables that have not been dropped.
_written: list[str] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Drops the tables that ``materialize`` writes inside, at the end: to be put around the action
    that consumes a result, as the result reads them."""
    before = len(_written)
    try:
        yield
    finally:
        gone = _written[before:]
        del _written[before:]
        for path in gone:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; this cuts the lineage.

    The table is compressed and columnar, so later readers prune columns; it survives the loss
    of executors, unlike a cache or a local checkpoint. See ``intermediates`` for its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def one_row_per(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: the least by ``columns`` in the order given; NULL keys are dropped.

    Exact second deliveries fall together; where they differ, the choice is the least struct, so
    it does not depend on the order of the rows. Partial aggregation runs before the shuffle, so
    a key that holds a third of the rows is combined on the map side.
    """
    rest = [c for c in columns if c != key]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in rest])
    )


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits in lower case; everything else separates."""
    if not text:
        return []
    if text.isascii():
        return text.translate(ASCII_WORDS).split()
    return [w.lower() for w in _WORD.findall(text)]


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only where the counted size allows it; else the plan's shuffle join holds."""
    return F.broadcast(df) if small_enough(df, rows) else df


def spread(key: Column, n: int) -> Column:
    """A salt in ``0 .. n-1`` from a key's hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

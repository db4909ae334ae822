"""Order-aware operators that split hot groups.

A window partitioned by a session holds that session in one task. These operators sort by
(group, order) with a range shuffle instead, so a group that holds a third of all rows is cut
into as many ranges as its size asks for, and only the few rows at range borders are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.common import materialize


def range_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partitioned and sorted by ``keys`` (NULLs first)."""
    return df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(
        *[F.col(k).asc_nulls_first() for k in keys]
    )


def with_previous(df: DataFrame, group: str, order: list[str], carry: list[str]) -> DataFrame:
    """Each row with ``prev_<c>`` for each of ``carry``: the values of the row before it in its
    group by ``order``; ``has_prev`` is false (and the values NULL) for a group's first row.

    NULL groups count as one group; NULLs in ``order`` come first; ties in ``order`` are broken
    arbitrarily, so end it with a key. An empty input gives an empty result.
    """
    cols = [group, *order, *[c for c in df.columns if c not in (group, *order)]]
    src = range_sorted(df.select(*cols), [group, *order])
    prev = [f"prev_{c}" for c in carry]
    schema = T.StructType(
        [
            *src.schema.fields,
            *[T.StructField(f"prev_{c}", src.schema[c].dataType) for c in carry],
            T.StructField("has_prev", T.BooleanType()),
            T.StructField("_part", T.IntegerType()),
            T.StructField("_first", T.BooleanType()),
            T.StructField("_last", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before: pa.RecordBatch | None = None
        held: list | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield make(held, part, False)
            held = [batch, before]
            before = batch.slice(n - 1, 1)
        if held is not None:
            yield make(held, part, True)

    def make(held: list, part: int, last: bool) -> pa.RecordBatch:
        batch, before = held
        n = batch.num_rows

        def shifted(name: str) -> pa.Array:
            col = batch.column(batch.schema.get_field_index(name))
            head = before.column(before.schema.get_field_index(name)) if before is not None else pa.nulls(1, col.type)
            return pa.concat_arrays([head, col.slice(0, n - 1)])

        g, pg = batch.column(0), shifted(group)
        same = pc.or_(pc.fill_null(pc.equal(g, pg), False), pc.and_(pc.is_null(g), pc.is_null(pg)))
        if before is None:
            same = pa.concat_arrays([pa.array([False]), same.slice(1)])
        arrays = list(batch.columns)
        for c in carry:
            s = shifted(c)
            arrays.append(pc.if_else(same, s, pa.nulls(n, s.type)))
        first = pa.array([before is None and i == 0 for i in range(n)])
        final = pa.array([last and i == n - 1 for i in range(n)])
        arrays += [same, pa.array([part] * n, pa.int32()), first, final]
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

    rows = materialize(src.mapInArrow(run, schema), "previous")
    # At most two rows of each partition: their number is bounded by the number of partitions.
    edge = rows.where("_first or _last")
    w = Window.orderBy("_part", F.col("_first").desc(), "_last")
    stitched = edge.select("_part", "_first", F.lit(True).alias("_m"), *[F.lag(c).over(w).alias(f"_b_{c}") for c in [group, *carry]], F.lag("_part").over(w).alias("_b_part"))
    stitched = stitched.where("_first").drop("_first")
    out = rows.where("not _first").select(*cols, *prev, "has_prev").unionByName(
        rows.where("_first")
        .join(F.broadcast(stitched), "_part", "left")
        .withColumn("_ok", F.coalesce(F.col("_b_part").isNotNull() & F.col(group).eqNullSafe(F.col(f"_b_{group}")), F.lit(False)))
        .select(
            *cols,
            *[F.when(F.col("_ok"), F.col(f"_b_{c}")).alias(f"prev_{c}") for c in carry],
            F.col("_ok").alias("has_prev"),
        )
    )
    return out


def with_ordinal(df: DataFrame, order: list[str], group: str | None = None, name: str = "_ord") -> DataFrame:
    """``df`` with a dense ordinal from 0 by ``order``, over all rows or within each ``group``.

    A range sort numbers the rows of each partition; a table of one row for each partition and
    group reached in it gives the offsets. No group is gathered in one task. NULLs come first; end
    ``order`` with a key, as ties are broken arbitrarily.
    """
    keys = ([group] if group else []) + order
    src = range_sorted(df, keys)
    at = src.columns.index(group) if group else None
    schema = T.StructType([*src.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_run", T.IntegerType()), T.StructField("_at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, no, pos = None, -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if at is None:
                ends, values = np.array([n]), [None]
            else:
                col = batch.column(at)
                same = pc.or_kleene(pc.equal(col[1:], col[:-1]), pc.and_(pc.is_null(col[1:]), pc.is_null(col[:-1]))).fill_null(False)
                ends = np.append(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1, n)
                values = col.take(pa.array(ends - 1)).to_pylist()
            starts = np.concatenate([[0], ends[:-1]])
            goes_on = no >= 0 and values[0] == held
            first = no if goes_on else no + 1
            sizes = ends - starts
            runs = np.repeat(np.arange(first, first + len(ends)), sizes)
            places = np.arange(n) - np.repeat(starts, sizes)
            if goes_on:
                places[: sizes[0]] += pos
            held, no = values[-1], int(runs[-1])
            pos = int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(runs, pa.int32()), pa.array(places, pa.int64())], schema.fieldNames())

    rows = materialize(src.mapInArrow(run, schema), "ordinal")
    by = [F.col(group)] if group else [F.lit(0)]
    sizes = rows.groupBy("_part", "_run", *([group] if group else [])).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_part", "_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_run", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return rows.join(offsets, ["_part", "_run"]).withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_run", "_at", "_before")

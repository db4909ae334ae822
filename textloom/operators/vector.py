"""Cosine distance and exact retrieval with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; missing or NULL entries make it NULL."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL where a vector is NULL, of another length, or zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.lit(1.0) - dot(a, b) / norm)


def usable(vector: str, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers that are not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def nearest_in_blocks(rows: DataFrame, queries: DataFrame, key: str, k: int, dim: int, block: int = 4096, most_queries: int = 200_000) -> DataFrame:
    """(query, key, distance, rank): the ``k`` rows of least cosine distance for each query, exactly.

    ``rows`` (key, v) and ``queries`` (query, q) hold vectors of ``dim`` numbers; others are left out
    before. Ties go to the lesser key. The queries, a stated set, go to the tasks in sets of about
    ``most_queries`` (one pass over the rows each), where they are compared in blocks by matrix products.
    A task takes its rows in the order of their keys and holds one product of bounded size and ``k`` rows
    a query, which it sends on; the tasks are two a core, so what they send follows the queries alone.
    """
    from pyspark.sql import Window

    sets = max(1, -(-queries.count() // most_queries))
    out = None
    for part in range(sets):
        own = queries if sets == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(sets)) == part)
        near = _nearest(rows, own, key, k, dim, block)
        out = near if out is None else out.unionByName(near)
    w = Window.partitionBy("query").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Entries of one product of queries and rows.
_TILE = 1 << 19


def _enter(d, i, cosine, base: int) -> None:
    """Puts the rows of ``cosine`` (queries by rows, numbered from ``base``) that are nearer than a query's
    last one into its least distances ``d``, in order, and their numbers ``i``; of equal ones the first stay."""
    import numpy as np

    k = d.shape[1]
    at, row = np.divmod(np.flatnonzero(cosine > 1.0 - d[:, -1:]), cosine.shape[1])
    far = np.round(1.0 - cosine[at, row], 6) + 0.0  # no negative zero
    fine = far < d[at, -1]
    at, row, far = at[fine], row[fine], far[fine]
    if not len(at):
        return
    first = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(first, append=len(at))
    own, line = at[first], np.repeat(np.arange(len(first)), n)
    place = k + np.arange(len(at)) - np.repeat(first, n)
    both, which = np.full((len(own), k + n.max()), np.inf), np.full((len(own), k + n.max()), -1)
    both[:, :k], which[:, :k] = d[own], i[own]
    both[line, place], which[line, place] = far, base + row
    keep = np.argsort(both, axis=1, kind="stable")[:, :k]
    d[own], i[own] = np.take_along_axis(both, keep, axis=1), np.take_along_axis(which, keep, axis=1)


def _nearest(rows: DataFrame, queries: DataFrame, key: str, k: int, dim: int, block: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    def unit(vectors):
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    held = queries.select("query", F.col("q").cast("array<double>").alias("q")).toArrow()  # one set
    kinds = dict(rows.dtypes) | {"query": dict(queries.dtypes)["query"]}
    schema = f"query {kinds['query']}, {key} {kinds[key]}, distance double"
    if not held.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    types = {c: to_arrow_type(df.schema[c].dataType) for c, df in (("query", queries), (key, rows))}
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((held.column("query").combine_chunks().cast(types["query"]), unit(held.column("q").combine_chunks())))
    del held

    def run(batches):
        names, q = shared.value
        d, i = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        keys, base, seen, most = [pa.array([], types[key])], 0, 0, max(1, _TILE // block)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(1))
            keys.append(batch.column(0).cast(types[key]))
            for at in range(0, len(q), block):
                own, low = slice(at, at + block), 0
                while low < len(x):
                    high = min(low + max(1, min(most, max(k, seen + low))), len(x))  # the first rows in small steps, as many of them are near
                    _enter(d[own], i[own], q[own] @ x[low:high].T, base + low)
                    low = high
            base, seen = base + len(x), seen + len(x)
            if base > 2 * d.size + len(x):  # only the keys that are still asked for, in their order
                used = np.unique(i[i >= 0])
                keys, base = [pa.concat_arrays(keys).take(pa.array(used))], len(used)
                i[i >= 0] = np.searchsorted(used, i[i >= 0])
        everything = pa.chunked_array(keys)
        for at in range(0, len(q), block):
            own = i[at : at + block]
            line, place = np.nonzero(own >= 0)
            if len(line):
                found = everything.take(pa.array(own[line, place])).combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at + line)), found, pa.array(d[at : at + block][line, place])], ["query", key, "distance"])

    few = rows.select(key, F.col("v").cast("array<double>")).coalesce(2 * context.defaultParallelism)
    return few.sortWithinPartitions(key).mapInArrow(run, schema)

"""Problem 6: the most similar vectors for every vector.

Method: a tree of centroids cuts the collection into shards of bounded size, each shard builds a
hierarchical navigable small-world graph in flat neighbour arrays, each vector is searched in its
own shard and in those of its next centroids, and the shards' results are merged.

Equal vectors are one class before anything else, so a group of copies that holds a third of the
rows is one vector in one shard. A cell with more vectors than a shard may hold gets centroids of its
own (Euclidean, so even a dense cell comes apart), level by level, fitted in the executors on a
bounded sample of the cell. A shard that is visited by very many vectors answers them in several
tasks, each with a copy of the shard, so no task's input grows with the collection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.common import materialize, read
from textloom.llm.hnsw import Hnsw

DIM, K, SIMILARITY = 64, 10, 0.95
#: A shard aims at TARGET vectors, more where the tree would have over LEAVES leaves, and is cut again
#: over SLACK times that. A cell gets at most FAN centroids at once, fitted on at most PER_CENTROID
#: vectors for each; every vector is indexed.
TARGET, SLACK, LEAVES, FAN, PER_CENTROID = 4096, 2.5, 262_144, 256, 48
#: One task answers at most this many visitors for each vector that a shard may hold.
VISITORS = 6
PROBES, BEAM = 4, 20
#: For the k nearest at any similarity, which are far apart: more shards, by the root of their number
#: (see ``wide_probes``), and a wider beam.
WIDE_PROBES, WIDE_PER_ROOT, WIDE_BEAM = 8, 2.0, 256
EVERY = 20


def usable(vector: str):
    """Whether a vector has 64 finite numbers that are not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == DIM) & fine & F.exists(v, lambda x: x != 0)


def collection(chunks: DataFrame, chats: DataFrame) -> DataFrame:
    """(key, vec): the usable vectors of both tables, ``c:`` or ``h:`` before the table's key."""
    a = chunks.select(F.concat(F.lit("c:"), "chunk_id").alias("key"), F.col("embedding").alias("vec"))
    b = chats.select(F.concat(F.lit("h:"), F.col("id").cast("string")).alias("key"), F.col("embedding").alias("vec"))
    return a.unionByName(b).where(F.col("key").isNotNull() & usable("vec"))


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, DIM).astype(np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(key, h, vec), one row per key: float32 bytes of its unit vector, and their 64-bit hash."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["key", "vec"])

    one = vectors.mapInArrow(run, "key string, vec binary").groupBy("key").agg(F.min("vec").alias("vec"))
    return one.select("key", F.xxhash64("vec").alias("h"), "vec")


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``, none of them empty."""
    c = x[np.sort(np.random.default_rng(5).choice(len(x), min(k, len(x)), replace=False))].astype(np.float64)
    for _ in range(rounds):
        near = closest(x, c)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=len(c))
        c = total[size > 0] / size[size > 0][:, None]
    return c.astype(np.float32)


def closest(x: np.ndarray, c: np.ndarray, most: int = 1) -> np.ndarray:
    """For each row the ``most`` nearest of the centroids, nearest first."""
    half = 0.5 * (c.astype(np.float64) ** 2).sum(axis=1)
    out = np.empty((len(x), most), dtype=np.int64)
    for at in range(0, len(x), 4096):
        far = half - x[at : at + 4096].astype(np.float64) @ c.T.astype(np.float64)
        if most == 1:
            out[at : at + 4096, 0] = far.argmin(axis=1)
        else:
            top = np.argpartition(far, most - 1, axis=1)[:, :most] if most < len(c) else np.tile(np.arange(most), (len(far), 1))
            out[at : at + 4096] = np.take_along_axis(top, np.argsort(np.take_along_axis(far, top, axis=1), axis=1, kind="stable"), axis=1)
    return out


class Tree:
    """Centroids by cell. A cell without any is a leaf, that is a shard; cell 0 is the root."""

    def __init__(self):
        self.cells = 1
        self.under: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def split(self, cell: int, centroids: np.ndarray) -> None:
        self.under[cell] = (np.arange(self.cells, self.cells + len(centroids)), centroids)
        self.cells += len(centroids)

    def leaves(self) -> np.ndarray:
        """The leaves in order, and where each cell stands among them."""
        return np.array([c for c in range(self.cells) if c not in self.under])

    def own(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centroid at every level."""
        cell = np.zeros(len(x), dtype=np.int64)
        open_ = [0] if 0 in self.under else []
        while open_:
            nxt: list[int] = []
            for c in open_:
                rows = np.flatnonzero(cell == c)
                if len(rows):
                    children, centroids = self.under[c]
                    cell[rows] = children[closest(x[rows], centroids)[:, 0]]
                    nxt += [k for k in children.tolist() if k in self.under]
            open_ = nxt
        return cell

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, their centroids)."""
        leaves = self.leaves()
        at = {k: v for children, centroids in self.under.values() for k, v in zip(children.tolist(), centroids, strict=True)}
        return leaves, np.array([at[k] for k in leaves.tolist()], dtype=np.float32) if at else np.zeros((1, DIM), dtype=np.float32)


#: Up to this many leaves a vector is compared with every leaf's centroid; beyond, with those that a
#: search down the tree reaches, which keeps WIDTH cells a level for each leaf to visit.
FLAT, WIDTH = 1024, 4


def visited(tree: Tree, x: np.ndarray, probes: int) -> np.ndarray:
    """Up to ``probes`` leaves for each row, its own first; -1 for none."""
    own = tree.own(x)
    leaves, centroids = tree.table()
    probes = min(probes, len(leaves))
    if len(leaves) <= FLAT:
        out = leaves[closest(x, centroids, probes)]
    else:
        out = np.concatenate([_descend(tree, x[at : at + 256], probes) for at in range(0, len(x), 256)])
    # The own leaf comes first; where it is not among the nearest, it takes the last place.
    missing = ~(out == own[:, None]).any(axis=1)
    out[missing, -1] = own[missing]
    order = np.argsort(np.where(out == own[:, None], -1, np.arange(probes)), axis=1)
    return np.take_along_axis(out, order, axis=1)


def _descend(tree: Tree, x: np.ndarray, probes: int) -> np.ndarray:
    row, cell, far = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    while True:
        inner = np.array([c for c in np.unique(cell).tolist() if c in tree.under], dtype=np.int64)
        if not len(inner):
            break
        leaf = ~np.isin(cell, inner)
        parts = [(row[leaf], cell[leaf], far[leaf])]
        for c in inner.tolist():
            rows = row[cell == c]
            children, centroids = tree.under[c]
            d = 0.5 * (centroids.astype(np.float64) ** 2).sum(axis=1) - x[rows].astype(np.float64) @ centroids.T
            parts.append((np.repeat(rows, len(children)), np.tile(children, len(rows)), d.ravel()))
        row, cell, far = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((far, row))
        row, cell, far = row[order], cell[order], far[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < WIDTH * probes
        row, cell, far = row[keep], cell[keep], far[keep]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full((len(x), probes), -1, dtype=np.int64)
    out[row[rank < probes], rank[rank < probes]] = cell[rank < probes]
    return out


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=np.float32).reshape(-1, DIM)


def _fitter(fan: dict[int, int]):
    def fit(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        x = np.frombuffer(b"".join(group.sort_by("h").column("vec").to_pylist()), dtype=np.float32).reshape(-1, DIM)
        c = kmeans(x, fan[cell])
        return pa.table({"cell": pa.array([cell] * len(c), pa.int64()), "centroid": pa.array([v.tobytes() for v in c], pa.binary())})

    return fit


def grow(reps: DataFrame, n: int) -> tuple[Tree, int]:
    """(tree, vectors that a shard may hold): cells are cut until every leaf has at most that many.

    What reaches the driver is a count for each leaf and the centroids: at most LEAVES of each.
    """
    target = max(TARGET, -(-n // LEAVES))
    most = int(SLACK * target)
    tree, sizes = Tree(), {0: n}
    while large := {c: k for c, k in sizes.items() if k > most}:
        held = reps.sparkSession.sparkContext.broadcast(tree)
        fan = {c: min(FAN, -(-k // target)) for c, k in large.items()}
        # A share of each cell by hash, the same at every run.
        share = {c: min(1.0, PER_CENTROID * fan[c] / k) for c, k in large.items()}

        def sample(batches, held=held, share=share):
            for batch in batches:
                if batch.num_rows:
                    cell = held.value.own(_vectors(batch, 1))
                    h = batch.column(0).to_numpy()
                    part = (h.view(np.uint64) >> np.uint64(40)).astype(np.float64) / float(1 << 24)
                    keep = np.flatnonzero(part < np.array([share.get(c, 0.0) for c in cell.tolist()]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["cell", "h", "vec"])

        fitted: dict[int, list[np.ndarray]] = {}
        for r in reps.select("h", "vec").mapInArrow(sample, "cell long, h long, vec binary").groupBy("cell").applyInArrow(_fitter(fan), "cell long, centroid binary").collect():
            fitted.setdefault(r["cell"], []).append(np.frombuffer(bytes(r["centroid"]), dtype=np.float32))
        before = {c: sizes[c] for c in fitted}
        for c in sorted(fitted):
            if len(fitted[c]) > 1:
                tree.split(c, np.array(sorted(fitted[c], key=lambda v: v.tobytes())))
        counted = reps.sparkSession.sparkContext.broadcast(tree)

        def count(batches, counted=counted):
            for batch in batches:
                if batch.num_rows:
                    cells, many = np.unique(counted.value.own(_vectors(batch, 0)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(many)], ["cell", "c"])

        sizes = {r["cell"]: r["c"] for r in reps.select("vec").mapInArrow(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect()}
        # A cell that did not come apart is left to cuts by hash (see ``search_shards``).
        stuck = {c for c in before if c in sizes}
        if stuck >= {c for c, k in sizes.items() if k > most}:
            break
    return tree, most


def wide_probes(leaves: int) -> int:
    """Shards to visit for the k nearest at any similarity: a fixed number finds less the more there are."""
    return max(WIDE_PROBES, int(np.ceil(WIDE_PER_ROOT * np.sqrt(leaves))))


def search_shards(reps: DataFrame, n: int, k: int, probes: int | None, beam: int, least: float) -> DataFrame:
    """(h, other, sim): up to ``k`` other classes near each query class in each shard it visits,
    of similarity ``least`` or more. ``reps``: (h, vec, query), one row for each class. ``probes``:
    how many shards, by default ``wide_probes``."""
    spark = reps.sparkSession
    tree, most = grow(reps, n)
    probes = wide_probes(len(tree.leaves())) if probes is None else probes
    held = spark.sparkContext.broadcast(tree)  # at most LEAVES centroids

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                homes = visited(held.value, _vectors(batch, 1), probes)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(homes.ravel()), homes.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["h", "vec", "query", "homes"])

    routed = materialize(reps.select("h", "vec", "query").mapInArrow(route, "h long, vec binary, query boolean, homes array<long>"), "routed")
    # One row for each leaf: how many vectors it holds (cuts) and how many others visit it (turns).
    own = routed.select(F.col("homes")[0].alias("home"), F.lit(1).alias("held"), F.lit(0).alias("visits"))
    seen = routed.where("query").select(F.explode(F.slice("homes", 2, probes)).alias("home"), F.lit(0).alias("held"), F.lit(1).alias("visits"))
    load = own.unionByName(seen).groupBy("home").agg(F.sum("held").alias("held"), F.sum("visits").alias("visits"))
    load = load.select("home", F.greatest(F.lit(1), F.ceil(F.col("held") / most)).cast("int").alias("cuts"), F.greatest(F.lit(1), F.ceil(F.col("visits") / (VISITORS * most))).cast("int").alias("turns"))
    load = materialize(load, "load")
    # One task for each group, so that no task grows with the collection.
    tasks = max(1, load.agg(F.sum(F.col("cuts") * F.col("turns"))).first()[0] or 1)
    load = F.broadcast(load)  # at most LEAVES rows of three numbers
    place = lambda salt, of: F.pmod(F.xxhash64("h", F.lit(salt)), F.col(of)).cast("int")
    kept = routed.select("h", "vec", "query", F.col("homes")[0].alias("home")).join(load, "home")
    kept = kept.select("home", place(1, "cuts").alias("cut"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "h", "vec", "query", F.lit(True).alias("held"))
    visits = routed.where("query").select("h", "vec", "query", F.posexplode("homes").alias("i", "home")).where("home >= 0").join(load, "home")
    visits = visits.withColumn("own", place(1, "cuts")).select("home", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), place(2, "turns").alias("turn"), "h", "vec", "query", "i", "own")
    visits = visits.where("not (i = 0 and cut = own)").select("home", "cut", "turn", "h", "vec", "query", F.lit(False).alias("held"))

    def run(shard: pa.Table) -> pa.Table:
        h = shard.column("h").to_numpy()
        x = np.frombuffer(b"".join(shard.column("vec").to_pylist()), dtype=np.float32).reshape(-1, DIM)
        asked = shard.column("query").to_numpy(zero_copy_only=False).astype(bool)
        held = shard.column("held").to_numpy(zero_copy_only=False).astype(bool)
        # Row order in a shard is arbitrary: by hash, the graph is the same at every run.
        store = np.flatnonzero(held)
        store = store[np.argsort(h[store], kind="stable")]
        index = Hnsw(x[store])
        out = []
        first = shard.column("turn")[0].as_py() == 0  # the shard's own vectors ask in its first turn
        mine = np.flatnonzero(asked[store]) if first else np.empty(0, dtype=np.int64)
        for rows, at in ((store[mine], mine), (np.flatnonzero(~held), None)):
            if len(rows) and len(store):
                near, sims = index.search(x[rows], k + 1, beam, at)
                r, c = np.nonzero((near >= 0) & (sims >= least - 1e-6))
                a, b = h[rows[r]], h[store[near[r, c]]]
                fine = a != b
                exact = np.einsum("md,md->m", x[rows[r[fine]]].astype(np.float64), x[store[near[r[fine], c[fine]]]].astype(np.float64))
                out.append((a[fine], b[fine], exact))
        cols = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"h": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "sim": pa.array(cols[2], pa.float64())})

    return kept.unionByName(visits).repartition(tasks, "home", "cut", "turn").groupBy("home", "cut", "turn").applyInArrow(run, "h long, other long, sim double").where(F.col("sim") >= least)


def nearest(vectors: DataFrame, k: int = K, least: float = -2.0, probes: int | None = None, beam: int = WIDE_BEAM, queries=None) -> DataFrame:
    """(key, other, sim, rank): the ``k`` most similar other vectors of each vector of ``vectors``
    (key, vec) for which the column ``queries`` of key holds (all by default), similarity ``least``
    or more.

    Ties go to the lesser key. A key delivered twice counts once; equal vectors are similar by 1 and
    come first. Unusable vectors must be filtered before (``usable``). Extra columns are dropped; no
    rows give no rows. The result is approximate: recall is measured in the tests and the README.
    """
    units = materialize(unit_vectors(vectors.select("key", "vec")), "units")
    ask = F.lit(True) if queries is None else queries
    classes = units.groupBy("h").agg(F.min(F.struct("key", "vec")).alias("m"), F.count("*").alias("c"), F.max(ask).alias("query"))
    classes = materialize(classes.select("h", F.col("m.vec").alias("vec"), "c", "query"), "classes")
    n = classes.count()
    hits = search_shards(classes.select("h", "vec", "query"), n, k, probes, beam, least)
    # Shards' results merged; the copies of a class are its nearest.
    copies = classes.where("c > 1 and query").select("h", F.col("h").alias("other"), F.lit(1.0).alias("sim"))
    best = Window.partitionBy("h").orderBy(F.desc("sim"), "other")
    hits = hits.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("h", "other", "sim")
    hits = materialize(hits.unionByName(copies), "hits")
    # Of any class the k + 1 least keys are enough to fill a list; the limit runs before the shuffle.
    involved = hits.select("h").union(hits.select("other")).distinct()
    keys = units.join(involved, "h", "left_semi").select("h", "key").distinct()
    firsts = keys.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("key"))).where(F.col("r") <= k + 1).select(F.col("h").alias("other"), F.col("key").alias("other_key"))
    lists = hits.join(firsts, "other")
    ranked = lists.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("sim"), "other_key"))).where(F.col("r") <= k + 1).select("h", "other_key", "sim")
    each = keys.where(ask).join(ranked, "h").where(F.col("key") != F.col("other_key"))
    out = each.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sim"), "other_key"))).where(F.col("rank") <= k)
    return out.select("key", F.col("other_key").alias("other"), "sim", "rank")


def _all(spark, sf_dir: str) -> DataFrame:
    return collection(read(spark, sf_dir, "chunk_embeddings"), read(spark, sf_dir, "chat_history"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    near = nearest(_all(spark, sf_dir), least=SIMILARITY, probes=PROBES, beam=BEAM)
    return near.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


def p6_neighbours(spark, sf_dir: str) -> DataFrame:
    """(key, other, sim, rank) for every query: each chat whose id is divisible by 20, and each
    chunk whose number (the part of chunk_id after the last colon) is."""
    number = F.substring_index(F.col("key"), ":", -1).cast("long")
    near = nearest(_all(spark, sf_dir), queries=F.coalesce(number % EVERY == 0, F.lit(False)))
    return near.withColumn("sim", F.round("sim", 6))


ORACLE = {
    "p6_found": """
        with v as (select 'c:' || chunk_id k, any_value(embedding)::double[] e from chunk_embeddings where chunk_id is not null group by 1
          union all select 'h:' || id, any_value(embedding)::double[] from chat_history where id is not null and embedding is not null group by 1),
        u as (select k, e, row_number() over (order by k) i from v where len(e) = 64 and list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))),
        s as (select a.k ka, b.k kb, list_cosine_similarity(a.e, b.e) c from u a join u b on a.i < b.i),
        t as (select ka q, kb o, c from s where c >= 0.95 union all select kb, ka, c from s where c >= 0.95),
        r as (select q, o, row_number() over (partition by q order by c desc, o) n from t)
        select distinct least(q, o) key_a, greatest(q, o) key_b from r where n <= 10"""
}

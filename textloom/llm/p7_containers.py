"""Problem 7: filling fixed-capacity containers with items.

Method: linear grouping. Large lengths are rounded up to the largest of their equal-cardinality
group; patterns over those few sizes are optimised one after another by a bounded knapsack; the
actual documents are substituted for the rounded ones, which frees the space that rounding cost;
small documents then fill the rest best-fit.

The plan is made on the driver from the histogram of lengths, which has at most ``capacity``
entries whatever the number of documents; containers are planned in runs, never one by one. The
documents themselves are ranked within their length (salted) and joined with the runs.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.common import map_batches, materialize, read, spread

CAPACITY = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# --- fixed value: the public pre-tokenization pattern of that vocabulary ---------------------------
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths above capacity / LARGE are grouped; the number of groups; the least number of salts of a
#: length's ranking, and about how many documents of one length a salt holds.
LARGE, GROUPS, SALTS, SALTED = 8, 32, 64, 500_000

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, loaded once per process."""
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, tokens): tokens of each row's whole text; NULL and empty texts have 0."""
    own = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(path)
        n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["k", "tokens"])

    return map_batches(own, run, f"k {dict(own.dtypes)['k']}, tokens int").withColumnRenamed("k", key)


class _Lengths:
    """What is left of the documents, by length; takes hand out ranks within a length."""

    def __init__(self, histogram: dict[int, int]):
        self.left = dict(histogram)
        self.used: dict[int, int] = defaultdict(int)

    def take(self, length: int, n: int) -> int:
        rank = self.used[length]
        self.used[length] += n
        self.left[length] -= n
        return rank


def _best_pattern(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size fill one container best: a bounded knapsack by reachable sums."""
    reach = np.full(capacity + 1, -1, dtype=np.int64)  # the last size used to reach a sum
    reach[0] = len(sizes)
    took = []
    for i, (s, c) in enumerate(zip(sizes, counts, strict=True)):
        used = np.full(capacity + 1, -1, dtype=np.int64)
        used[reach >= 0] = 0
        for at in range(s, capacity + 1):
            if reach[at] < 0 and used[at - s] >= 0 and used[at - s] < c:
                used[at] = used[at - s] + 1
                reach[at] = i
        took.append(used)
    total = int(np.flatnonzero(reach >= 0)[-1])
    pattern = [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        if total > 0 and took[i][total] > 0:
            n = int(took[i][total])
            pattern[i] = n
            total -= n * sizes[i]
    return pattern


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, container, offset, per_container): the documents of that
    length with rank r in [rank_from, rank_to) go to container + (offset + r - rank_from) //
    per_container. Lengths are in 1 .. capacity; every document of the histogram is in one run.
    """
    lengths = _Lengths({k: v for k, v in histogram.items() if v > 0})
    out: list[tuple[int, int, int, int, int, int]] = []
    runs: list[tuple[int, int, int]] = []  # (space left, first container, containers)
    opened = 0

    # Linear grouping: equal cardinality, from the longest; a group is as long as its longest.
    big = sorted((k for k in lengths.left if k * large > capacity), reverse=True)
    total = sum(lengths.left[k] for k in big)
    queues: list[list[list[int]]] = []  # per group: [length, documents left], longest first
    share = max(1, -(-total // max(1, groups)))
    room = 0
    for k in big:
        n = lengths.left[k]
        while n:
            if room == 0:
                queues.append([])
                room = share
            t = min(n, room)
            queues[-1].append([k, t])
            n, room = n - t, room - t
    while queues:
        queues = [q for q in queues if q]
        if not queues:
            break
        sizes = [q[0][0] for q in queues]  # rounded up: what is left of the group is no longer
        counts = [sum(n for _, n in q) for q in queues]
        # The longest goes in first, so that the pattern never leaves it to the end.
        rest = capacity - sizes[0]
        pattern = _best_pattern(sizes, [min(c - (i == 0), rest // s) for i, (s, c) in enumerate(zip(sizes, counts, strict=True))], rest)
        pattern[0] += 1
        times = min(c // p for c, p in zip(counts, pattern, strict=True) if p)
        deltas: dict[int, int] = defaultdict(int)  # container -> change of the space taken at its place
        for q, p in zip(queues, pattern, strict=True):
            if not p:
                continue
            need, at = p * times, 0
            while need:
                length, n = q[0]
                t = min(n, need)
                rank = lengths.take(length, t)
                out.append((length, rank, rank + t, opened, at, p))
                # Space taken per container changes only at the ends of this run.
                first, last = at // p, (at + t - 1) // p
                if first == last:
                    deltas[first] += length * t
                    deltas[first + 1] -= length * t
                else:
                    head, tail = p - at % p, (at + t - 1) % p + 1
                    deltas[first] += length * head
                    deltas[first + 1] += length * (p - head)
                    deltas[last] -= length * (p - tail)
                    deltas[last + 1] -= length * tail
                at, need = at + t, need - t
                if t == n:
                    q.pop(0)
                else:
                    q[0][1] -= t
        taken = 0
        points = sorted(d for d in deltas if d < times)
        for i, d in enumerate(points):
            taken += deltas[d]
            upto = points[i + 1] if i + 1 < len(points) else times
            runs.append((capacity - taken, opened + d, upto - d))
        opened += times

    # Best fit for the small ones, longest first; a run is a class of equal containers.
    runs = sorted(r for r in runs if r[0] > 0)
    for length in sorted((k for k, v in lengths.left.items() if v > 0), reverse=True):
        while (n := lengths.left[length]) > 0:
            i = bisect.bisect_left(runs, (length, -1, -1))
            if i < len(runs):
                space, first, m = runs.pop(i)
                t = space // length
            else:
                space, first, t = capacity, opened, capacity // length
                m = -(-n // t)
                opened += m
            placed = min(n, m * t)
            rank = lengths.take(length, placed)
            out.append((length, rank, rank + placed, first, 0, t))
            full, part = divmod(placed, t)
            for left, a, b in ((space - t * length, first, full), (space - part * length, first + full, 1 if part else 0), (space, first + full + (part > 0), m - full - (part > 0))):
                if b > 0 and left > 0:
                    bisect.insort(runs, (left, a, b))
    return out


def fill_containers(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """(container, key, part, tokens) for each item of ``sizes`` (key unique, size >= 0).

    An item above the capacity is split into full containers of its own and a rest that is packed
    like any item (part counts from 0); nothing else is split. Items of size 0 or NULL take the
    space of 1. Packed containers are numbered from 0 without gaps; the full ones of oversized items
    have negative numbers from a 63-bit hash of (key, part). An empty table gives an empty result.
    """
    own = sizes.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(1)).cast("int").alias("n"))
    own = own.withColumn("over", ((F.col("n") - 1) / capacity).cast("int"))  # full containers of its own
    by = materialize(own.select("k", (F.col("n") - F.col("over") * capacity).alias("n"), F.col("over").alias("part")), "items")
    # At most ``capacity`` rows reach the driver, however many documents there are.
    histogram = {r["n"]: r["c"] for r in by.groupBy("n").agg(F.count("*").alias("c")).collect()}
    # A length that most documents have is ranked in as many parts as its number asks for.
    salts = max(salts, -(-max(histogram.values(), default=0) // SALTED))
    by = by.withColumn("salt", spread(F.col("k"), salts))
    counts = by.groupBy("n", "salt").agg(F.count("*").alias("c"))
    runs = plan(histogram, capacity)
    spark = sizes.sparkSession
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0, 1)], "n int, lo long, hi long, container long, off long, per long")
    before = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n", "salt", "base")
    ranked = by.withColumn("r", F.row_number().over(Window.partitionBy("n", "salt").orderBy("k")) - 1).join(before, ["n", "salt"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("base"))
    # The runs are bounded by the number of lengths (capacity) and patterns, not by the documents.
    packed = (
        ranked.join(F.broadcast(table), (ranked["n"] == table["n"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
        .select((F.col("container") + F.floor((F.col("off") + F.col("r") - F.col("lo")) / F.col("per"))).cast("long").alias("container"), "k", "part", ranked["n"].alias("tokens"))
    )
    full = (
        own.where("over > 0")
        .select("k", F.explode(F.sequence(F.lit(0), F.col("over") - 1)).alias("part"))
        .select((-1 - F.abs(F.xxhash64("k", "part"))).alias("container"), "k", "part", F.lit(capacity).alias("tokens"))
    )
    return packed.unionByName(full).withColumnRenamed("k", key)


def p7_containers(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return fill_containers(materialize(token_counts(docs, "doc_id", "text"), "tokens"), "doc_id", "tokens")


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Documents that the operator had to split: those with a second part."""
    return p7_containers(spark, sf_dir).where("part = 0 and container < 0").select("doc_id").distinct()

"""Problem 2: near-duplicate records with small edits.

Method: an inverted join over signature coordinates. Each distinct text has a MinHash signature of
COORDINATES values over its runs of three words; it is posted under each (coordinate, value).
A text's postings are put in one order for all texts, the popular last, and only its prefix is
joined: two texts with MATCHES collisions must meet in the prefixes, which skip the last MATCHES - 1
postings. Collisions of the pairs that meet are counted over all coordinates on a packed copy of
the signature (four bits of each value, so the count is never too low), and what passes is verified
on the texts themselves. The order decides the cost only, never the result.

Limit: a pair at similarity 0.5 exactly collides in 24 of 48 coordinates on average and reaches
the 17 asked for with a probability of 0.98, one at 0.6 with 0.9997. Everything after that is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.common import broadcast_if_small, map_batches, materialize, one_row_per, read, words

SHINGLE, SIMILARITY = 3, 0.5
COORDINATES, MATCHES = 48, 17
#: Classes of exact copies up to this size are expanded into all pairs; larger ones are given as
#: pairs of their representative with each member, from which the rest follows.
EXPAND = 64
BROADCAST_ROWS = 50_000
#: A posting shared by this share of the texts is popular: there are at most COORDINATES / POPULAR.
POPULAR, BLOCK = 1e-4, 16384
#: A posting that more texts share than this is salted: its texts are dealt out by hash and meet all
#: others in as many tasks. A task of the join gets about POSTINGS rows, however many there are.
HOT, POSTINGS = 4096, 500_000

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(texts: list[list[str]], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64-bit hashes of the runs of ``width`` words, text after text."""
    codes = _Codes()
    flat = np.array([codes[w] for ws in texts for w in ws], dtype=np.uint64)
    n = np.array([len(ws) for ws in texts], dtype=np.int64)
    counts = np.maximum(n - width + 1, 0)
    starts = np.cumsum(n) - n
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ flat[at + k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h, counts


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash signatures (32 bits a coordinate) of the texts with counts > 0, in their order."""
    some = counts[counts > 0]
    first = np.cumsum(some) - some
    out = np.empty((len(some), COORDINATES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):
            v = ((hashes * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(v, first)
    return out


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, classes, hashes, counts) of a batch (chunk_id, text)."""
    texts = [words(t) for t in batch.column(1).to_pylist()]
    hashes, counts = shingle_hashes(texts)
    keep = np.flatnonzero(counts > 0)
    ident = np.array([xxhash.xxh64_intdigest(" ".join(texts[i])) for i in keep], dtype=np.uint64).view(np.int64)
    return keep, ident, hashes, counts


def _members(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    keys, ident = [], []
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ws = words(t)
        if len(ws) >= SHINGLE:
            keys.append(k)
            ident.append(xxhash.xxh64_intdigest(" ".join(ws)))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.array(ident, dtype=np.uint64).view(np.int64))], ["chunk_id", "doc"])


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    keep, ident, hashes, counts = _texts(batch)
    if not len(keep):
        return None
    sig = signatures(hashes, counts)
    return pa.RecordBatch.from_arrays([pa.array(ident), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc", "sig"])


def _keys(batch: pa.RecordBatch, column: int = 1) -> np.ndarray:
    sig = np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64)


def popular_postings(classes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(postings, texts that share each), sorted by posting, of the popular ones.

    Counted over all texts: a popular posting is so in at least one block of texts, and only what
    is popular in a block is sent on.
    """

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def count():
            keys, c = np.unique(np.concatenate(held).ravel(), return_counts=True)
            some = c >= max(2, POPULAR * size)
            return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(c[some])], ["key", "c"])

        for batch in batches:
            if batch.num_rows:
                held.append(_keys(batch, 0))
                size += batch.num_rows
                if size >= BLOCK:
                    yield count()
                    held, size = [], 0
        if size:
            yield count()

    least = max(3, int(POPULAR * n))
    rows = classes.select("sig").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least).collect()
    keys = np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["c"] for r in rows], dtype=np.int64)[order]


def _pack(sig: np.ndarray) -> list[np.ndarray]:
    """Four bits of each coordinate, sixteen coordinates to a 64-bit word."""
    bits = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64)
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return [(bits[:, i : i + 16] << shift).sum(axis=1, dtype=np.uint64).view(np.int64) for i in range(0, COORDINATES, 16)]


def _unequal(x, y):
    """How many of sixteen packed coordinates differ."""
    t = x.bitwiseXOR(y)
    t = t.bitwiseOR(F.shiftrightunsigned(t, 1))
    t = t.bitwiseOR(F.shiftrightunsigned(t, 2))
    return F.bit_count(t.bitwiseAND(F.lit(0x1111111111111111)))


def similar_texts(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: candidate pairs of distinct texts (doc, sig) by collisions."""
    n = classes.count()
    keys, counts = popular_postings(classes, n)
    held = classes.sparkSession.sparkContext.broadcast((keys, counts))  # at most COORDINATES / POPULAR
    most = COORDINATES - MATCHES + 1

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _keys(batch)
        known, share = held.value
        at = np.searchsorted(known, own) if len(known) else np.zeros(own.shape, dtype=np.int64)
        at = np.minimum(at, max(len(known) - 1, 0))
        rank = np.where(known[at] == own, share[at], 0) if len(known) else np.zeros(own.shape, dtype=np.int64)
        with np.errstate(over="ignore"):
            mixed = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
        order = np.argsort((rank.astype(np.uint64) << np.uint64(30)) | mixed, axis=1)[:, :most]
        key = np.take_along_axis(own, order, axis=1).ravel().view(np.int64)
        salts = np.maximum(1, -(-np.take_along_axis(rank, order, axis=1).ravel() // HOT))
        doc = np.repeat(batch.column(0).to_numpy(), most)
        packed = [np.repeat(p, most) for p in _pack((own & np.uint64(0xFFFFFFFF)).astype(np.uint32))]
        # A hot posting once asks, in the task that the text's hash names, and answers in all of them.
        hot = np.flatnonzero(salts > 1)
        answers = np.repeat(hot, salts[hot])
        rows = np.concatenate([np.arange(len(key)), answers])
        role = np.concatenate([np.where(salts > 1, 1, 0), np.full(len(answers), 2)])
        first = np.cumsum(salts[hot]) - salts[hot]
        salt = np.concatenate([np.where(salts > 1, (doc.view(np.uint64) % salts.astype(np.uint64)).astype(np.int64), 0), np.arange(len(answers)) - np.repeat(first, salts[hot])])
        return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(salt, pa.int64()).cast(pa.int32()), pa.array(role, pa.int64()).cast(pa.int32()), pa.array(doc[rows]), *[pa.array(p[rows]) for p in packed]], ["key", "salt", "role", "doc", "s0", "s1", "s2"])

    posts = map_batches(classes, prefixes, "key long, salt int, role int, doc long, s0 long, s1 long, s2 long")
    posts = posts.repartition(max(1, -(-n * most // POSTINGS)), "key", "salt")
    left = posts.select("key", "salt", F.col("role").alias("asks"), F.col("doc").alias("a"), *[F.col(f"s{i}").alias(f"a{i}") for i in range(3)])
    right = posts.select("key", "salt", F.col("role").alias("answers"), F.col("doc").alias("b"), *[F.col(f"s{i}").alias(f"b{i}") for i in range(3)])
    apart = _unequal(F.col("a0"), F.col("b0")) + _unequal(F.col("a1"), F.col("b1")) + _unequal(F.col("a2"), F.col("b2"))
    # Cold with cold (0, 0) or asking with answering (1, 2); in one expression over both sides, which keeps
    # the filter above the exchange that the two sides share.
    fits = F.col("asks") * 2 - F.col("answers") == 0
    met = left.join(right, ["key", "salt"]).where(fits & (F.col("a") < F.col("b")) & (apart <= COORDINATES - MATCHES))
    return met.select("a", "b").distinct()


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    keep = []
    for i, (s, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
        x, y = words(s), words(t)
        p, q = set(zip(x, x[1:], x[2:], strict=False)), set(zip(y, y[1:], y[2:], strict=False))
        both = len(p & q)
        if both and both >= SIMILARITY * (len(p) + len(q) - both):
            keep.append(i)
    return batch.select([0, 1]).take(pa.array(keep, pa.int64())) if keep else None


def near_pairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of ``df`` (chunk_id, chunk_text).

    members: (chunk_id, doc), each chunk with the class of its text (texts with the same words are
    one class); pairs: (a, b) of different classes whose similarity is at least 0.5, each once.
    NULL ids and texts of under three words have no similarity and are left out; repeated rows
    count once; no rows give no rows.
    """
    rows = materialize(one_row_per(df.where("chunk_text is not null"), "chunk_id", ["chunk_text"]), "rows")
    members = materialize(map_batches(rows, _members, "chunk_id string, doc long"), "members")
    classes = map_batches(rows, _sign, "doc long, sig binary").groupBy("doc").agg(F.min("sig").alias("sig"))
    pairs = materialize(similar_texts(materialize(classes, "classes")), "candidates")
    # The texts of the candidates only, by one chunk of each class.
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    owner = members.join(broadcast_if_small(wanted, BROADCAST_ROWS), "doc").groupBy("doc").agg(F.min("chunk_id").alias("chunk_id"))
    owner = materialize(owner, "owners")
    texts = materialize(rows.join(broadcast_if_small(owner, BROADCAST_ROWS), "chunk_id").dropDuplicates(["doc"]).select("doc", "chunk_text"), "texts")
    left, right = texts.select(F.col("doc").alias("a"), F.col("chunk_text").alias("ta")), texts.select(F.col("doc").alias("b"), F.col("chunk_text").alias("tb"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return members, map_batches(full, _verify, "a long, b long")


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) for ``nodes`` (node) under the links ``pairs`` (a, b): the least node.

    Each round takes the least label of a node's neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of the longest path.
    """
    links = materialize(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialize(nodes.select("node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        near = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "node")
        low = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("m", "component")).alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        nxt = materialize(low.join(jump, "to", "left").select("node", F.col("component").alias("was"), F.least("to", F.coalesce("further", "to")).alias("component")), "labels")
        labels = nxt.select("node", "component")
        if nxt.where("component < was").isEmpty():
            return labels


def expand(members: DataFrame, pairs: DataFrame, limit: int | None = EXPAND) -> DataFrame:
    """(chunk_id_a, chunk_id_b): the pairs of classes as pairs of chunks.

    ``limit`` None expands every class, however many pairs that makes.

    Classes of at most ``limit`` copies are expanded, also among themselves. A larger class
    stands in other pairs by its least chunk_id only, and gives one pair of that with each other
    member; all further pairs follow from those.
    """
    limit = (1 << 62) if limit is None else limit
    size = members.groupBy("doc").agg(F.count("*").alias("c"), F.min("chunk_id").alias("head"))
    linked = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).union(size.where("c > 1").select("doc")).distinct()
    # Only members of classes with a partner or a copy go on: a small part of the table.
    held = materialize(members.join(size, "doc").join(linked, "doc", "left_semi"), "members")
    spokes = held.where((F.col("c") <= limit) | (F.col("chunk_id") == F.col("head"))).select("doc", "chunk_id")
    x, y = spokes.select(F.col("doc").alias("a"), F.col("chunk_id").alias("p")), spokes.select(F.col("doc").alias("b"), F.col("chunk_id").alias("q"))
    across = pairs.join(x, "a").join(y, "b").select("p", "q")
    small = held.where((F.col("c") > 1) & (F.col("c") <= limit))
    inside = small.select("doc", F.col("chunk_id").alias("p")).join(small.select("doc", F.col("chunk_id").alias("q")), "doc").where("p < q").select("p", "q")
    stars = held.where((F.col("c") > limit) & (F.col("chunk_id") != F.col("head"))).select(F.col("head").alias("p"), F.col("chunk_id").alias("q"))
    out = across.unionByName(inside).unionByName(stars)
    return out.select(F.least("p", "q").alias("chunk_id_a"), F.greatest("p", "q").alias("chunk_id_b")).distinct()


def p2_found(spark, sf_dir: str) -> DataFrame:
    members, pairs = near_pairs(read(spark, sf_dir, "chunk_embeddings"))
    return expand(members, materialize(pairs, "pairs"))


def p2_groups(spark, sf_dir: str) -> DataFrame:
    """(chunk_id, group_id, links): every chunk with the least chunk_id of its group, and how many other
    texts are near its own."""
    members, pairs = near_pairs(read(spark, sf_dir, "chunk_embeddings"))
    pairs = materialize(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    group = components(pairs, nodes).withColumnRenamed("node", "doc")
    degree = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).groupBy("doc").agg(F.count("*").alias("links"))
    rows = members.join(group.join(degree, "doc"), "doc", "left").select("chunk_id", F.coalesce("component", "doc").alias("c"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = materialize(rows, "groups")
    least = rows.groupBy("c").agg(F.min("chunk_id").alias("group_id"))
    return rows.join(least, "c").select("chunk_id", "group_id", "links")


_TEXTS = """
        with recursive d as (select chunk_id, any_value(chunk_text) t from chunk_embeddings where chunk_id is not null and chunk_text is not null group by chunk_id),
        x as (select chunk_id, list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from d),
        m as (select chunk_id, array_to_string(w, ' ') k, w from x where len(w) >= 3), c as (select k, min(chunk_id) r, any_value(w) w from m group by 1),
        s as (select distinct r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select r, w, unnest(range(1, len(w) - 1)) i from c)),
        n as (select r, count(*) n from s group by 1),
        p as (select a.r x, b.r y, count(*) c from s a join s b on a.g = b.g and a.r <> b.r group by 1, 2),
        e as (select x, y from p join n a on a.r = x join n b on b.r = y where c >= 0.5 * (a.n + b.n - c)),
        reach(a, b) as (select r, r from c union select reach.a, e.y from reach join e on e.x = reach.b),
        g as (select a r, min(b) group_id from reach group by 1), l as (select x r, count(*) links from e group by 1)"""
ORACLE = {
    "p2_groups": _TEXTS + """
        select m.chunk_id, g.group_id, coalesce(l.links, 0) links from m join c using (k) join g using (r) left join l using (r)""",
    "p2_found": """
        with d as (select chunk_id, any_value(chunk_text) t from chunk_embeddings where chunk_id is not null and chunk_text is not null group by chunk_id),
        w as (select chunk_id, list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from d),
        s as (select distinct chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select chunk_id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)),
        n as (select chunk_id, count(*) n from s group by 1),
        p as (select a.chunk_id x, b.chunk_id y, count(*) c from s a join s b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2)
        select x chunk_id_a, y chunk_id_b from p join n a on a.chunk_id = x join n b on b.chunk_id = y where c >= 0.5 * (a.n + b.n - c)"""
}

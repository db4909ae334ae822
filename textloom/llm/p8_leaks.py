"""Problem 8: evaluation texts leaking into training text.

Method: latent semantic retrieval. Item passages and documents are cut into overlapping windows
of words; the windows are TF-IDF vectors over the items' vocabulary, with document frequencies
over the whole corpus; a distributed randomised SVD of the item windows gives the latent space;
document windows close to an item's window by cosine are candidates; a candidate is then checked
word by word: longest common run, longest common subsequence, and the item's answer.

The items are a stated query set, held in blocks of ``BLOCK`` items; the corpus is only ever
scanned, never joined with itself, so every stage is a map over the documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.common import map_batches, read, words

#: Shortest run that counts; windows twice as long, by steps of it: any run lies whole in one.
RUN = 13
WIDTH, STEP = 2 * RUN, RUN
RANK, OVERSAMPLE, POWER = 64, 16, 3
#: Least latent cosine of a candidate: two windows that share the run have about 0.5 and more.
COSINE = 0.3
#: Items held at once.
BLOCK = 2000
#: A paraphrase has this share of the item's words in order; with the answer, the lower one.
LCS_SHARE, LCS_SHARE_WITH_ANSWER = 0.6, 0.45
# --- fixed values: soft hyphen and zero-width characters ----------------------------------------------
INVISIBLE = dict.fromkeys([0x00AD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
LEAK = "doc_id long, item_id long, longest_run int, lcs_share double, answer boolean, kind string"


def normal_words(text: str | None) -> list[str]:
    """Words after compatibility form (NFKC), without soft hyphens and zero-width characters."""
    if not text:
        return []
    return words(text if text.isascii() else unicodedata.normalize("NFKC", text).translate(INVISIBLE))


def windows(n: int) -> list[int]:
    """Where the windows of a text of ``n`` words begin; the last may be shorter."""
    return list(range(0, max(1, n - STEP), STEP))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = where.get(y, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def randomised_svd(spark: SparkSession, rows: list[tuple[list[int], list[float]]], dim: int, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (dim x rank) of the sparse ``rows``.

    Subspace iteration: each partition of the rows returns A_p' (A_p Q), a matrix of dim x
    (rank + oversample) whatever the number of rows; only these sums reach the driver.
    """
    width = min(dim, rank + OVERSAMPLE)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))
    df = spark.createDataFrame(rows, "idx array<int>, val array<double>").repartition(max(1, min(8, len(rows) // 256 + 1)))

    def partial(q: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros_like(q)
            for batch in batches:
                for idx, val in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    i, v = np.asarray(idx, dtype=np.int64), np.asarray(val)
                    acc[i] += np.outer(v, v @ q[i])
            yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], ["m"])

        return run

    for step in range(POWER + 1):
        parts = df.mapInArrow(partial(q), "m binary").collect()
        y = sum(np.frombuffer(r["m"], dtype=np.float64).reshape(q.shape) for r in parts)
        if step == POWER:
            w, v = np.linalg.eigh(q.T @ y)
            return q @ v[:, np.argsort(w)[::-1][:rank]]
        q, _ = np.linalg.qr(y)
    raise AssertionError


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """(documents with each word, documents): counted over the whole corpus, for the items' words.

    What reaches the driver is bounded by the items' vocabulary.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            seen.update(vocabulary.keys() & set(normal_words(text)))
        keys = ["", *seen]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([batch.num_rows, *(seen[k] for k in keys[1:])], pa.int64())], ["w", "n"])

    counts = {r["w"]: r["n"] for r in map_batches(docs.select("text"), run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(len(vocabulary))
    for w, i in vocabulary.items():
        df[i] = counts.get(w, 0)
    return df, counts.get("", 0)


class Finder:
    """The items of one block in latent space, and the check of a document against them."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], vocabulary: dict[str, int], idf: np.ndarray, basis: np.ndarray):
        self.items = items
        self.vocabulary = vocabulary
        self.weight = idf * idf
        self.project = (idf[:, None] * basis).astype(np.float32)
        self.ids = [np.array([vocabulary[w] for w in ws], dtype=np.int64) for _, ws, _ in items]
        rows, owner = [], []
        least = np.inf
        for k, ids in enumerate(self.ids):
            for s in windows(len(ids)):
                rows.append(self.project[ids[s : s + WIDTH]].sum(axis=0))
                owner.append(k)
            run = np.convolve(self.weight[ids], np.ones(min(RUN, len(ids))), "valid")
            least = min(least, run.min())
        m = np.array(rows, dtype=np.float32).reshape(len(rows), basis.shape[1])
        self.matrix = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        self.owner = np.array(owner)
        #: No window that holds 13 words of an item weighs less (weights are never negative).
        self.least = least * (1 - 1e-9)
        self.grams: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, ids in enumerate(self.ids):
            own = ids.tolist()
            for j in range(len(own) - RUN + 1):
                self.grams[tuple(own[j : j + RUN])].append((k, j))

    def candidates(self, ids: np.ndarray) -> dict[int, tuple[int, int]]:
        """item -> (first word, last word + 1) of the windows close to it."""
        n = len(ids)
        known = ids >= 0
        weight = np.where(known, self.weight[ids], 0.0)
        total = np.concatenate([[0.0], np.cumsum(weight)])
        starts = np.array(windows(n))
        ends = np.minimum(starts + WIDTH, n)
        heavy = np.flatnonzero(total[ends] - total[starts] >= self.least)
        out: dict[int, tuple[int, int]] = {}
        if not len(heavy):
            return out
        lat = np.array([self.project[w[w >= 0]].sum(axis=0) for w in (ids[starts[i] : ends[i]] for i in heavy)], dtype=np.float32)
        lat /= np.maximum(np.linalg.norm(lat, axis=1, keepdims=True), 1e-9)
        for r, c in zip(*np.nonzero(lat @ self.matrix.T >= COSINE), strict=True):
            k, s, e = int(self.owner[c]), int(starts[heavy[r]]), int(ends[heavy[r]])
            a, b = out.get(k, (s, e))
            out[k] = (min(a, s), max(b, e))
        return out

    def leaks(self, text: str | None) -> list[tuple[int, int, float, bool, str]]:
        """(item_id, longest run, share of the item in order, answer there, kind) of a document."""
        ws = normal_words(text)
        if not ws:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
        near = self.candidates(ids)
        if not near:
            return []
        runs: dict[int, int] = {}
        own = ids.tolist()
        before: dict[tuple[int, int], int] = {}
        for i in range(len(own) - RUN + 1):
            now = {}
            if own[i] >= 0:
                for k, j in self.grams.get(tuple(own[i : i + RUN]), ()):
                    if k in near:
                        now[(k, j)] = n = before.get((k, j - 1), RUN - 1) + 1
                        runs[k] = max(runs.get(k, 0), n)
            before = now
        out = []
        joined = None
        for k, (a, b) in near.items():
            item_id, item_words, answer = self.items[k]
            run = runs.get(k, 0)
            share = lcs(self.ids[k].tolist(), own[a:b]) / max(1, len(item_words))
            if run < RUN and share < LCS_SHARE_WITH_ANSWER:
                continue
            if joined is None:
                joined = f" {' '.join(ws)} "
            has = bool(answer) and f" {' '.join(answer)} " in joined
            if run >= RUN:
                out.append((item_id, run, share, has, "verbatim"))
            elif share >= LCS_SHARE or has:
                out.append((item_id, run, share, has, "paraphrase"))
        return out


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest_run, lcs_share, answer, kind) for each document and leaked item.

    ``verbatim``: a run of 13 or more words in common; longest_run is exact. ``paraphrase``: no
    such run, but most of the item's words in their order (or fewer, and its answer). NULL ids
    and texts give no rows, nor do items of under 13 words or an empty table; repeated rows count
    once. Whole texts are read, and extra columns are dropped.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    held = items.select("item_id", "passage", "answer").where("item_id is not null and passage is not null").distinct()
    out = None
    # The query set is read block by block; a block is bounded by BLOCK items.
    block: list[tuple[int, list[str], list[str]]] = []

    def search(block: list) -> DataFrame:
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws, _ in block for w in ws}))}
        df, n = document_frequencies(docs, vocabulary)
        idf = np.log((n + 1.0) / (df + 0.5)).clip(min=0.0)
        rows = []
        for _, ws, _ in block:
            for s in windows(len(ws)):
                c = Counter(vocabulary[w] for w in ws[s : s + WIDTH])
                idx = sorted(c)
                rows.append((idx, [float(c[i] * idf[i]) for i in idx]))
        finder = spark.sparkContext.broadcast(Finder(block, vocabulary, idf, randomised_svd(spark, rows, len(vocabulary))))  # bounded by BLOCK items

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            f = finder.value
            found = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in f.leaks(t)]
            if not found:
                return None
            types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [x.split()[0] for x in LEAK.split(", ")])

        return map_batches(docs, run, LEAK)

    for row in held.toLocalIterator():
        ws = normal_words(row["passage"])
        if len(ws) >= RUN:
            block.append((row["item_id"], ws, normal_words(row["answer"])))
        if len(block) == BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        return spark.createDataFrame([], LEAK)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(F.struct("longest_run", "lcs_share", "answer", "kind")).alias("m")]).select("doc_id", "item_id", "m.*")


def p8_leaks(spark, sf_dir: str) -> DataFrame:
    return leaked_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_found(spark, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("kind = 'verbatim'").select("doc_id", "item_id")


# SQL has no compatibility form; the letters and digits of full width are what these tables hold of it.
_WIDE = "".join(chr(0xFEE0 + i) for i in range(33, 127)).replace("'", "''")
_NARROW = "".join(chr(i) for i in range(33, 127)).replace("'", "''")
_HIDDEN = r"[\x{00AD}\x{180E}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
_WORDS_SQL = lambda c: "list_filter(regexp_split_to_array(lower(translate(nfc_normalize(regexp_replace(" + c + ", '" + _HIDDEN + "', '', 'g')), '" + _WIDE + "', '" + _NARROW + r"')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
ORACLE = {
    "p8_found": f"""
        with i as (select item_id, {_WORDS_SQL("passage")} w from eval_items where item_id is not null), d as (select doc_id, {_WORDS_SQL("text")} w from documents where doc_id is not null),
        a as (select distinct item_id, array_to_string(w[p : p + 12], ' ') r from (select item_id, w, unnest(range(1, len(w) - 11)) p from i where len(w) >= 13)),
        b as (select distinct doc_id, array_to_string(w[p : p + 12], ' ') r from (select doc_id, w, unnest(range(1, len(w) - 11)) p from d where len(w) >= 13))
        select distinct doc_id, item_id from a join b using (r)"""
}

"""Calls of models and services from the executors, in batches; the models are the caller's functions.

Nothing here opens a connection of its own. A batch that fails is tried again and then marked row by
row, so one bad answer does not end a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, RETRIES = 1024, 2


def _ask(fn: Callable[[list], list], given: list, retries: int) -> list[tuple[object, str | None]]:
    """(answer, error) for each; a batch that fails for good is split down to the rows that do."""
    for _ in range(retries + 1):
        try:
            out = list(fn(given))
            if len(out) != len(given):
                raise ValueError(f"{len(out)} answers to {len(given)} questions")
            return [(x, None) for x in out]
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    if len(given) == 1:
        return [(None, error)]
    half = len(given) // 2
    return _ask(fn, given[:half], 0) + _ask(fn, given[half:], 0)


def called(df: DataFrame, fn: Callable[[list], list], column: str, result: str, kind: str, batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """``df`` with ``result`` (of the type ``kind``), what ``fn`` answers to the values of ``column``, a
    batch at a time, and ``error``. NULL values are not asked and have neither."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{result}` {kind}, error string"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            answers: dict = {}
            asked = [i for i, v in pdf[column].items() if v is not None]
            for at in range(0, len(asked), batch):
                rows = asked[at : at + batch]
                answers.update(zip(rows, _ask(fn, [pdf[column][i] for i in rows], retries), strict=True))
            out = pdf.copy()
            out[result] = pd.Series([answers.get(i, (None, None))[0] for i in pdf.index], index=pdf.index, dtype=object)
            out["error"] = pd.Series([answers.get(i, (None, None))[1] for i in pdf.index], index=pdf.index, dtype=object)
            yield out

    return df.mapInPandas(run, schema)


def infer(df: DataFrame, generate: Callable[[list[str]], list[str]], prompt: str = "prompt", **kw) -> DataFrame:
    """``df`` with ``predict``, the texts generated for its prompts."""
    return called(df, generate, prompt, "predict", "string", **kw)


def score(df: DataFrame, reward: Callable[[list[str]], list[float]], messages: str = "messages", **kw) -> DataFrame:
    """``df`` with ``score``, what a reward model or server gives for each row's messages."""
    return called(df, reward, messages, "score", "double", **kw)


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]], dim: int, text: str = "chunk_text", **kw) -> DataFrame:
    """``df`` with ``embedding``; a vector of another length than ``dim`` is an error of its row."""
    out = called(df, lambda xs: [list(map(float, v)) for v in model(xs)], text, "embedding", "array<double>", **kw)
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") != dim)
    return out.withColumn("error", F.when(wrong, F.concat(F.lit("length "), F.size("embedding").cast("string"))).otherwise(F.col("error"))).withColumn("embedding", F.when(~wrong, F.col("embedding")))


def rerank(hits: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], query: str, text: str, k: int, key: str, **kw) -> DataFrame:
    """The ``k`` texts of each query that a reranker scores highest, with ``score`` and ``rank``; ties go
    to the lesser key. What fails is left out."""
    from pyspark.sql import Window

    pairs = hits.withColumn("_pair", F.struct(F.col(query).alias("q"), F.col(text).alias("t")))
    scored = called(pairs, lambda rows: model([(r["q"], r["t"]) for r in rows]), "_pair", "score", "double", **kw).where("error is null").drop("_pair", "error")
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve(chunks: DataFrame, queries: DataFrame, model: Callable[[list[str]], list[list[float]]], dim: int, k: int = 5, reranker=None, widen: int = 4) -> DataFrame:
    """(query, chunk_id, distance, rank): the nearest chunks of texts (query, text), of which ``widen``
    times as many are reranked where there is a reranker of (query text, chunk text)."""
    from textloom.operators.vector import nearest_in_blocks, usable

    asked = embed(queries.select("query", "text"), model, dim, "text").where("embedding is not null")
    held = chunks.where(usable("embedding", dim)).select("chunk_id", F.col("embedding").alias("v"))
    hits = nearest_in_blocks(held, asked.select("query", F.col("embedding").alias("q")), "chunk_id", k * widen if reranker else k, dim)
    if reranker is None:
        return hits
    texts = hits.drop("rank").join(chunks.select("chunk_id", "chunk_text"), "chunk_id").join(queries.select("query", "text"), "query")
    by_text = rerank(texts, lambda pairs: reranker(pairs), "text", "chunk_text", k, "chunk_id")
    return by_text.select("query", "chunk_id", "distance", "rank")


def streamed(parts: Iterable, usage: dict | None = None) -> Iterator[str]:
    """The text of a stream of parts (text, usage), piece by piece; the last usage goes into ``usage``."""
    for text, used in parts:
        if used and usage is not None:
            usage.clear()
            usage.update(used)
        if text:
            yield text


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(source, content): each PDF's pages, joined by line ends; "" where it cannot be read.

    ``extract`` gives the pages of a file's bytes; by default PyMuPDF does, where it is installed.
    """
    if extract is None:
        import importlib.util

        if importlib.util.find_spec("fitz") is None:
            raise ImportError("PyMuPDF is not installed; give extract")

        def extract(data: bytes) -> list[str]:
            import fitz

            with fitz.open(stream=data, filetype="pdf") as doc:
                return [page.get_text() for page in doc]

    def safe(data) -> str:
        try:
            return "\n".join(extract(bytes(data)))
        except Exception:
            return ""

    @F.pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return data.map(safe)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("source"), text("content").alias("content"))


def download(df: DataFrame, fetch: Callable[[str], bytes], url: str = "url", **kw) -> DataFrame:
    """``df`` with ``content``, the bytes that ``fetch`` (a client with its own timeout) gives for the
    urls that are public (see ``text.public_url``); others are errors."""
    from textloom.functions.text import public_url

    fine = df.withColumn("_url", F.when(public_url(F.col(url)), F.col(url)))
    out = called(fine, lambda urls: [fetch(u) for u in urls], "_url", "content", "binary", batch=1, **kw)
    return out.withColumn("error", F.when(F.col("_url").isNull() & F.col(url).isNotNull(), "url refused").otherwise(F.col("error"))).drop("_url")


def read_hub(spark: SparkSession, name: str, split: str = "train", subset: str | None = None, load: Callable | None = None) -> DataFrame:
    """A dataset of a hub, by a loader that gives rows as a pandas table or a list of dicts; by default the
    ``datasets`` library, where it is installed."""
    if load is None:
        try:
            from datasets import load_dataset
        except ImportError as e:
            raise ImportError("the datasets library is not installed; give load") from e

        def load(n, s, p):
            return load_dataset(n, s, split=p).to_pandas()

    got = load(name, subset, split)
    return spark.createDataFrame(got if isinstance(got, pd.DataFrame) else pd.DataFrame(got))

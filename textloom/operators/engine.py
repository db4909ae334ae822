"""A data engine over registered datasets: one index, resampled and selected by place."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.mixing import shuffle_key
from textloom.operators.sequence import with_ordinal
from textloom.plugins import LOADERS

INDEX = "dataset string, row long"


@dataclass(frozen=True)
class Entry:
    """A dataset of the engine: where it is and how it is read, converted, sized and weighted."""

    name: str
    path: str
    source: str = "local"
    split: str = "train"
    converter: str | None = None
    size: int | None = None
    weight: float = 1.0
    streaming: bool = False


def entries(text: str) -> dict[str, Entry]:
    """The datasets of a registry, JSON or YAML of {name: {path, ...}}; a bare path is the dataset
    ``default``. All must agree on streaming."""
    try:
        given = json.loads(text)
    except ValueError:
        given = _yaml(text)
    if not isinstance(given, dict) or not all(isinstance(v, dict) and "path" in v for v in given.values()):
        given = {"default": {"path": text.strip()}}
    out = {k: Entry(k, **{a: b for a, b in v.items() if a in Entry.__dataclass_fields__}) for k, v in given.items()}
    if len({e.streaming for e in out.values()}) > 1:
        raise ValueError("all datasets must be streamed, or none")
    return out


def _yaml(text: str) -> dict | None:
    """Mappings of two levels with plain values, which is all that a registry needs."""
    out: dict = {}
    name = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        key, colon, value = bare.strip().partition(":")
        if not colon or value and not value.startswith(" "):
            return None
        value = value.strip()
        if not bare.startswith(" "):
            if value:
                return None
            name = key
            out[name] = {}
        elif name is None:
            return None
        else:
            try:
                out[name][key] = json.loads(value)
            except ValueError:
                out[name][key] = {"True": True, "False": False}.get(value, value.strip("'\""))
    return out or None


@LOADERS.register("local")
def load_local(spark: SparkSession, entry: Entry) -> DataFrame:
    """A file or folder by its extension; of a folder's types the first one counts."""
    from textloom.sources.files import read_dataset

    return read_dataset(spark, entry.path, strict=False)


def load(spark: SparkSession, entry: Entry, keep: str = "_row") -> DataFrame:
    """The rows of a dataset, read by its source, converted and named in ``_dataset_name``."""
    from textloom.operators.align import CONVERTERS

    rows = LOADERS.get(entry.source)(spark, entry)
    if entry.converter:
        if entry.converter not in CONVERTERS:
            raise ValueError(f"no converter {entry.converter}")
        rows = CONVERTERS[entry.converter](rows)
    return rows.withColumn("_dataset_name", F.lit(entry.name))


def index(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """INDEX: every row of every dataset by its place in the order of ``key``."""
    parts = [with_ordinal(df.select(key), [key], name="row").select(F.lit(name).alias("dataset"), "row") for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drawn(rows: DataFrame, n: int, total: int, seed: int, spark: SparkSession | None = None) -> DataFrame:
    """``n`` draws with replacement from the ``total`` rows of ``rows`` (row, ...), with ``draw``.

    A draw's row is a seeded hash of its number, so any engine can repeat it; the draws are made in
    parallel and joined to the rows.
    """
    spark = spark or rows.sparkSession
    if total <= 0 or n <= 0:
        return rows.limit(0).withColumn("draw", F.lit(0).cast("long"))
    picks = spark.range(n).select(F.col("id").alias("draw"), (F.conv(F.substring(shuffle_key(seed, F.col("id")), 1, 13), 16, 10).cast("long") % total).alias("row"))
    return rows.join(picks, "row")


def resized(rows: DataFrame, total: int, size: int | None, weight: float, seed: int) -> DataFrame:
    """A dataset's index after its size and its weight: drawn to ``size`` rows where it has one, then
    to the whole part of their number times the weight."""
    held, n = rows.withColumn("draw", F.col("row")), total
    if size is not None:
        held, n = drawn(rows, size, total, seed), size
    if weight == 1.0:
        return held
    again = held.drop("row").withColumnRenamed("draw", "row") if size is None else held.select(*[c for c in held.columns if c not in ("row", "draw")], F.col("row").alias("_row"), F.col("draw").alias("row"))
    out = drawn(again, int(n * weight), n, seed + 1)
    return out.drop("row").withColumnRenamed("_row", "row") if "_row" in out.columns else out


def select(index_: DataFrame, which: int | slice | list[int], order: list[str]) -> DataFrame:
    """Rows of an index by their place in ``order``: one place (from the end where negative), a slice
    with its step, or a list of places in its order; a place outside is refused.

    A list keeps repeated places. The result has ``place``.
    """
    rows = with_ordinal(index_, order, name="place")
    if isinstance(which, slice):
        step = which.step or 1
        if step < 0:
            raise ValueError("a slice goes forward")
        n = index_.count() if any(x is not None and x < 0 for x in (which.start, which.stop)) else None
        start, stop = (x if x is None or x >= 0 else max(0, n + x) for x in (which.start, which.stop))
        held = rows.where(F.col("place") >= (start or 0))
        held = held.where(F.col("place") < stop) if stop is not None else held
        return held.where((F.col("place") - (start or 0)) % step == 0)
    n = index_.count()
    places = [which] if isinstance(which, int) else list(which)
    if any(not -n <= p < n for p in places):
        raise IndexError(f"places {places} of {n} rows")
    table = index_.sparkSession.createDataFrame([(i, p % n) for i, p in enumerate(places)], "nth long, place long")
    return rows.join(F.broadcast(table), "place").orderBy("nth").drop("nth")  # as many as were asked for


def size_of(index_: DataFrame, streaming: bool = False) -> int:
    """The number of rows; -1 for a stream."""
    return -1 if streaming else index_.count()


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, workers: int = 1, drop_last: bool = True) -> DataFrame:
    """``df`` with ``worker`` and ``step``: a permutation for each epoch, dealt in turn; the rest that
    not all workers get is dropped."""
    rows = with_ordinal(df.withColumn("_h", shuffle_key(seed + epoch, F.col(key))), ["_h", key])
    rows = rows.withColumns({"worker": (F.col("_ord") % workers).cast("int"), "step": F.floor(F.col("_ord") / workers)})
    if drop_last and workers > 1:
        total = df.agg(F.floor(F.count("*") / workers).alias("_steps"))
        rows = rows.crossJoin(F.broadcast(total)).where(F.col("step") < F.col("_steps")).drop("_steps")  # one row
    return rows.drop("_h", "_ord")


def shuffle_buffered(df: DataFrame, key: str, order: str, buffer: int, seed: int) -> DataFrame:
    """``df`` with ``place``: a stream's order, shuffled within blocks of ``buffer`` rows."""
    rows = with_ordinal(df, [order]).withColumn("_block", F.floor(F.col("_ord") / buffer)).withColumn("_h", shuffle_key(seed, F.col(key)))
    return with_ordinal(rows.drop("_ord"), ["_block", "_h", key], name="place").drop("_block", "_h")


def stream_split(shuffled: DataFrame, take: int) -> tuple[DataFrame, DataFrame]:
    """(validation, train) of a shuffled stream: the first ``take`` places and the rest."""
    return shuffled.where(F.col("place") < take), shuffled.where(F.col("place") >= take)


def split_module(splits: dict[str, DataFrame]) -> dict[str, object]:
    """train_dataset and eval_dataset of named splits: ``validation`` alone, or by name where there are
    ``validation_<name>``."""
    out: dict[str, object] = {}
    if "train" in splits:
        out["train_dataset"] = splits["train"]
    if "validation" in splits:
        out["eval_dataset"] = splits["validation"]
    else:
        named = {k[len("validation_") :]: v for k, v in splits.items() if k.startswith("validation_")}
        if named:
            out["eval_dataset"] = named
    return out


def merged(datasets: dict[str, DataFrame], separate: bool = False) -> DataFrame | dict[str, DataFrame] | None:
    """The datasets in one, or by name where each is to be evaluated on its own; None for none."""
    if not datasets:
        return None
    if separate:
        return dict(datasets)
    out = None
    for df in datasets.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def few_shot(tests: DataFrame, train: DataFrame, key: str, by: str, n: int, seed: int) -> DataFrame:
    """(key, shot, train columns): up to ``n`` training rows for each test row of the same ``by``.

    The training rows of a group are put into one seeded circle; a test row takes the ``n`` after a
    place that its own hash chooses. So no pair of a test and a training row is made beyond those
    that are taken, and all support sets of a group differ by their start.
    """
    rows = with_ordinal(train.withColumn("_h", shuffle_key(seed, F.concat_ws(":", *[F.col(c).cast("string") for c in train.columns]))), ["_h"], by, "_rn").drop("_h")
    sizes = train.groupBy(by).agg(F.count("*").alias("_n"))
    start = F.conv(F.substring(shuffle_key(seed, F.col(key)), 1, 13), 16, 10).cast("long")
    asked = tests.select(key, by).join(sizes, by)
    asked = asked.withColumn("shot", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_n").cast("int")) - 1)))
    asked = asked.withColumn("_rn", (start + F.col("shot")) % F.col("_n"))
    return asked.join(rows, [by, "_rn"]).select(key, "shot", *[c for c in train.columns if c != key])

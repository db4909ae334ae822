"""Readers and writers of files; nothing here reaches the network."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = "id string, title string, abstract string, categories string"
FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "txt": "text", "orc": "orc", "arrow": "arrow"}


def read_jsonl(spark: SparkSession, path: str, schema: str = PAPER) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): one object a line; a line that does not parse is kept apart, and missing
    text fields are empty."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    bad = raw.where("_corrupt_record is not null").select("_corrupt_record")
    good = raw.where("_corrupt_record is null").drop("_corrupt_record")
    texts = [c for c, t in good.dtypes if t == "string"]
    return good.fillna("", texts), bad


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, content): each file of a folder tree as one row."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the distinct lines that are not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def _files(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(hadoop).isDirectory():
        return [path]
    return [n for s in fs.listStatus(hadoop) if not (n := s.getPath().getName()).startswith(("_", "."))]


def read_dataset(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A file or folder, by its extension. ``strict``: a folder must hold one type, else ValueError."""
    kinds = sorted({PurePosixPath(n).suffix.lstrip(".").lower() for n in _files(spark, path)})
    if not kinds or kinds[0] not in FORMATS or strict and len(kinds) > 1:
        raise ValueError(f"{path} holds {kinds or 'nothing'}; one of {sorted(FORMATS)} is read")
    if kinds[0] == "arrow":
        return read_arrow(spark, path)
    reader = spark.read
    if kinds[0] == "csv":
        reader = reader.option("header", "true")
    if kinds[0] == "json":
        reader = reader.option("multiLine", "true")
    return reader.format(FORMATS[kinds[0]]).load(path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files (IPC, as files or streams), each read by one task; the first file's schema holds for all."""
    import pyarrow as pa

    def batches(data: bytes):
        source = pa.BufferReader(data)
        try:
            reader = pa.ipc.open_file(source)
            yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
        except pa.ArrowInvalid:
            yield from pa.ipc.open_stream(source)

    def schema_of(data: bytes) -> pa.Schema:
        try:
            return pa.ipc.open_file(pa.BufferReader(data)).schema
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(pa.BufferReader(data)).schema

    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("content")
    schema = from_arrow_schema(schema_of(bytes(files.first()["content"])))

    def run(rows):
        for batch in rows:
            for data in batch.column(0):
                yield from batches(data.as_py())

    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


@dataclass(frozen=True)
class Dataset:
    """A registered dataset: where it is, its format, and which columns and tags stand for which."""

    name: str
    load_from: str
    location: str
    formatting: str = "alpaca"
    ranking: bool = False
    num_samples: int | None = None
    columns: dict[str, str | None] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    subset: str | None = None
    split: str = "train"
    folder: str | None = None


# --- fixed values: keys of a location, the first that is there counts --------------------------------------
LOCATIONS = ("hf_hub_url", "script_url", "cloud_file_name", "file_name")
DEFAULTS = {"prompt": "instruction", "query": "input", "response": "output", "history": None, "messages": "conversations", "system": None, "tools": None, "images": None, "videos": None, "audios": None, "chosen": None, "rejected": None, "kto_tag": None}
TAGS = {"role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt", "observation_tag": "observation", "function_tag": "function_call", "system_tag": "system"}


def registry(text: str) -> dict[str, Dataset]:
    """The datasets of a registry in JSON. A ``columns`` block replaces all default columns."""
    out = {}
    for name, a in json.loads(text).items():
        kind = next((k for k in LOCATIONS if k in a), None)
        if kind is None:
            raise ValueError(f"{name} has no location")
        given = a.get("columns")
        columns = {k: (given.get(k) if given else v) for k, v in {**DEFAULTS, **dict.fromkeys(given or {})}.items()}
        out[name] = Dataset(name, kind, a[kind], a.get("formatting", "alpaca"), bool(a.get("ranking", False)), a.get("num_samples"), columns, {**TAGS, **(a.get("tags") or {})}, a.get("subset"), a.get("split", "train"), a.get("folder"))
    return out


def lookup(datasets: dict[str, Dataset], names: list[str]) -> list[Dataset]:
    missing = [n for n in names if n not in datasets]
    if missing:
        raise ValueError(f"undefined: {', '.join(missing)}")
    return [datasets[n] for n in names]


def rename(df: DataFrame, dataset: Dataset) -> DataFrame:
    """Canonical columns of a dataset; those that it lacks are NULL. Adds ``_dataset_name``."""
    pick = [(F.col(src) if src and src in df.columns else F.lit(None).cast("string")).alias(name) for name, src in dataset.columns.items()]
    return df.select(*pick, F.lit(dataset.name).alias("_dataset_name"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Appends one object a row; NULL fields are left out."""
    df.write.mode("append").json(path)


def json_array(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows as lines of one JSON array, in order; the file is their concatenation."""
    from textloom.operators.sequence import with_ordinal

    rows = with_ordinal(df, order)
    last = df.agg((F.count("*") - 1).alias("_last"))
    own = F.to_json(F.struct(*df.columns))
    return rows.crossJoin(F.broadcast(last)).select("_ord", F.concat(F.when(F.col("_ord") == 0, "[\n").otherwise(""), F.lit("  "), own, F.when(F.col("_ord") == F.col("_last"), "\n]").otherwise(",")).alias("value"))  # one row


def for_stage(datasets: dict[str, Dataset], stage: str) -> list[str]:
    """The names to offer at a stage: ranking datasets for rm and dpo, the others elsewhere."""
    return [n for n, d in datasets.items() if d.ranking == (stage in ("rm", "dpo"))]


def check_stage(dataset: Dataset, stage: str) -> None:
    """Ranking datasets serve stage rm only, and no others do."""
    if (stage == "rm") != dataset.ranking:
        raise ValueError(f"{dataset.name} is {'a' if dataset.ranking else 'no'} ranking dataset, which stage {stage} does not take")


def head(df: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first ``most`` rows by ``order``; all for None. Each task keeps no more than those."""
    return df if most is None else df.orderBy(*order).limit(most)


def tail_text(spark: SparkSession, path: str, characters: int = 20_000) -> str:
    """The last characters of a log; only the end of its last file is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return ""
    size = fs.getFileStatus(hadoop).getLen()
    stream = fs.open(hadoop)
    try:
        begin = max(0, size - 4 * characters)  # a character has up to four bytes
        stream.seek(begin)
        data = bytes(b & 0xFF for b in stream.readNBytes(int(size - begin)))
    finally:
        stream.close()
    return data.decode("utf-8", "ignore")[-characters:]

"""Writers of results and logs, and readers of what they leave."""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text_per_key(df: DataFrame, key: str, text: str, folder: str) -> None:
    """``<key>.txt`` for each row, in UTF-8, written by the executors; a NULL text is empty.

    ``folder`` is one that all executors share. A key becomes a file's name, with / as _.
    """
    root = folder.rstrip("/")

    def write(rows: Iterator) -> None:
        import os

        os.makedirs(root, exist_ok=True)
        for r in rows:
            name = str(r[key]).replace("/", "_")
            with open(f"{root}/.{name}.part", "w", encoding="utf-8") as f:
                f.write(r[text] or "")
            os.replace(f"{root}/.{name}.part", f"{root}/{name}.txt")  # whole or not at all, also when repeated

    df.where(F.col(key).isNotNull()).select(key, text).foreachPartition(write)


def append_ids(df: DataFrame, key: str, path: str) -> None:
    """Appends ids to a checkpoint, one a line (see ``files.read_ids``)."""
    df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("value")).write.mode("append").text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a chunk: chunk_id (from 0 in each source), source, chunk_text."""
    chunks.select(F.col("chunk_id").cast("int"), "source", "chunk_text").write.mode("overwrite").json(path)


def save_tokenized(splits: dict[str, DataFrame], path: str, streaming: bool = False) -> None:
    """Tokenized splits as Parquet, one folder each; streams are refused."""
    if streaming:
        raise ValueError("a stream cannot be saved")
    for name, df in splits.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_tokenized(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The splits that were saved, or None where the folder is missing or empty."""
    hadoop, fs = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()] if fs.exists(hadoop) else []
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in sorted(names) if not n.startswith(("_", "."))} or None


def predictions(df: DataFrame, prompt: str = "prompt", predict: str = "predict", label: str = "label") -> DataFrame:
    """(prompt, predict, label): the rows of a prediction file."""
    return df.select(F.col(prompt).alias("prompt"), F.col(predict).alias("predict"), F.col(label).alias("label"))


def zipped(parts: dict[str, DataFrame], order: dict[str, str]) -> DataFrame:
    """The columns of several tables side by side, by their rows' places in their own orders; as many
    rows as the shortest has."""
    from textloom.operators.sequence import with_ordinal

    out = None
    for name, df in parts.items():
        own = with_ordinal(df, [order[name]], name="_nth").drop(order[name])
        out = own if out is None else out.join(own, "_nth")
    return out.drop("_nth")


def reward_rows(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(chosen, rejected) of a reward file, two decimals each."""
    return df.select(F.round(chosen, 2).alias("chosen"), F.round(rejected, 2).alias("rejected"))


def average_scores(scores: DataFrame, metrics: list[str]) -> str:
    """The mean of each metric as one JSON object, by name."""
    row = scores.agg(*[F.avg(m).alias(m) for m in metrics]).first()
    return json.dumps({m: row[m] for m in sorted(metrics)}, indent=4)


def evaluation_results(df: DataFrame, subject: str, row: str, predicted: str) -> DataFrame:
    """(subject, results): for each subject a JSON object from its rows to what was predicted.

    One row a subject; a subject is a test of bounded size.
    """
    return df.groupBy(subject).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(row).cast("string"), F.col(predicted)))))).alias("results"))


def evaluation_log(accuracy: DataFrame, name: str = "category", score: str = "accuracy") -> DataFrame:
    """Lines like ``     Average: 12.34``."""
    return accuracy.select(F.format_string("%15s: %.2f", F.col(name), F.col(score)).alias("value"))


def log_row(df: DataFrame) -> DataFrame:
    """Rows of a training log as JSON; fields that are NULL are left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))


def progress(step: Column, total: Column, elapsed: Column, tokens: Column) -> dict[str, Column]:
    """percentage, throughput, elapsed_time and remaining_time of a training step; 100 percent and no
    time where there is no total."""
    from textloom.functions.text import timing

    each = F.when(step > 0, elapsed / step).otherwise(0.0)
    left = F.greatest(total - step, F.lit(0)) * each
    return {
        "percentage": F.when(total > 0, F.round(step / total * 100, 2)).otherwise(100.0),
        "throughput": F.coalesce(F.round(F.try_divide(tokens.cast("double"), elapsed), 2), F.lit(0.0)),
        "elapsed_time": timing(elapsed),
        "remaining_time": timing(left),
    }


# --- logs of calls ----------------------------------------------------------------------------------------

Sink = Callable[[dict], None]


def jsonl_sink(path: str) -> Sink:
    """Appends one object a line to a file of the driver, as the services that log calls do."""

    def add(row: dict) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row, ensure_ascii=False) + "\n")

    return add


def logs_node(name: str, sink: Sink, clock: Callable[[], float] = time.perf_counter):
    """Decorator: node_name, status and latency (ms, five decimals) of each call that succeeds."""

    def wrap(fn):
        @functools.wraps(fn)
        def call(*args, **kw):
            began = clock()
            out = fn(*args, **kw)
            sink({"node_name": name, "status": "success", "latency": round((clock() - began) * 1000, 5)})
            return out

        return call

    return wrap


def logs_model(model: str, sink: Sink, clock: Callable[[], float] = time.perf_counter):
    """Decorator of a function from a prompt to (text, usage): prompt, tokens, rate and latency (s) of
    each call that succeeds. Latencies are positive."""

    def wrap(fn):
        @functools.wraps(fn)
        def call(prompt, *args, **kw):
            began = clock()
            text, usage = fn(prompt, *args, **kw)
            took = clock() - began
            usage = usage or {}
            made = usage.get("completion_tokens")
            sink({"input_prompt": prompt, "model_name": model, "status": "success", "prompt_tokens": usage.get("prompt_tokens"), "generated_tokens": made, "token_generation": round(made / took, 5) if made is not None and took > 0 else None, "total_tokens": usage.get("total_tokens"), "model_latency": round(took, 5), "output": text})
            return text, usage

        return call

    return wrap


CALLS = "input_prompt string, model_name string, status string, prompt_tokens int, generated_tokens int, token_generation double, total_tokens int, model_latency double, output string"


def call_rates(calls: DataFrame) -> DataFrame:
    """Calls, mean latency and tokens a second by model. Logs that store a latency with a negative sign
    count by its size."""
    took = F.abs("model_latency")
    return calls.where("status = 'success'").groupBy("model_name").agg(F.count("*").alias("calls"), F.avg(took).alias("mean_latency"), F.try_divide(F.sum(F.when(F.col("generated_tokens").isNotNull(), F.col("generated_tokens"))), F.sum(F.when(F.col("generated_tokens").isNotNull(), took))).alias("tokens_per_second"))


# --- checkpoints ------------------------------------------------------------------------------------------


def checkpoints(spark: SparkSession, folder: str, marker: str = "COMPLETE") -> list[tuple[int, str, bool]]:
    """(step, path, complete) of the folders ``checkpoint-<step>``, by step."""
    hadoop, fs = _path(spark, folder)
    if not fs.exists(hadoop):
        return []
    out = []
    for s in fs.listStatus(hadoop):
        name = s.getPath().getName()
        step = name.removeprefix("checkpoint-")
        if s.isDirectory() and name.startswith("checkpoint-") and step.isdigit():
            done, _ = _path(spark, f"{folder.rstrip('/')}/{name}/{marker}")
            out.append((int(step), f"{folder.rstrip('/')}/{name}", bool(fs.exists(done))))
    return sorted(out)


def latest_checkpoint(spark: SparkSession, folder: str, marker: str = "COMPLETE") -> str | None:
    """The complete checkpoint of the greatest step."""
    return next((p for _, p, done in reversed(checkpoints(spark, folder, marker)) if done), None)


def rotate_checkpoints(spark: SparkSession, folder: str, keep: int, marker: str = "COMPLETE") -> list[str]:
    """Deletes incomplete checkpoints older than the newest complete one, and the oldest complete ones
    beyond ``keep``; the paths that went."""
    held = checkpoints(spark, folder, marker)
    done = [(n, p) for n, p, c in held if c]
    newest = done[-1][0] if done else -1
    gone = [p for n, p, c in held if not c and n < newest] + [p for _, p in (done[:-keep] if keep > 0 else [])]
    for p in gone:
        hadoop, fs = _path(spark, p)
        fs.delete(hadoop, True)
    return gone


# --- other readers ----------------------------------------------------------------------------------------

#: What a path in the cloud may begin with; only JSON is read from there.
CLOUD = ("s3://", "s3a://", "gs://", "gcs://")


def read_cloud_json(spark: SparkSession, path: str, prefixes: tuple[str, ...] = CLOUD) -> DataFrame:
    """The .json and .jsonl files of a bucket's folder, or one of them; other files are left out.

    .jsonl has an object a line (blank lines are ignored), .json one value over many lines.
    """
    if not path.startswith(prefixes):
        raise ValueError(f"{path}: one of {prefixes} is read")
    hadoop, fs = _path(spark, path)
    found = [str(s.getPath()) for s in fs.listStatus(hadoop)] if fs.getFileStatus(hadoop).isDirectory() else [path]
    kinds = {k: [p for p in found if PurePosixPath(p).suffix == f".{k}"] for k in ("json", "jsonl")}
    parts = [spark.read.option("multiLine", str(k == "json").lower()).json(ps) for k, ps in kinds.items() if ps]
    if not parts:
        raise ValueError(f"{path} has no JSON")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_config(path: str) -> dict:
    """A configuration of nested mappings in YAML or JSON; {} where it is missing or cannot be read."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            out = yaml.safe_load(text)
        except ImportError:
            out = _nested(text)
        return out if isinstance(out, dict) else {}
    except Exception:
        return {}


def _nested(text: str) -> dict:
    """Nested mappings by indentation, where no reader of YAML is installed."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(line)
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            try:
                stack[-1][1][key] = json.loads(value.strip())
            except ValueError:
                stack[-1][1][key] = value.strip().strip("'\"")
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def subjects(mapping: str, task: str) -> tuple[list[tuple[str, str, str]], str]:
    """((subject, name, category) of a benchmark's mapping in JSON, and the split that a task such as
    ``mmlu_test`` names)."""
    given = json.loads(mapping)
    return [(k, v.get("name", k), v.get("category", "")) for k, v in given.items()], task.rsplit("_", 1)[-1]

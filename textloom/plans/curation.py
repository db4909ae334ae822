"""From raw paper records to accepted papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.store import first_per_key


def papers(raw: DataFrame) -> DataFrame:
    """One row per id with cleaned texts and the year; NULL ids are left out."""
    one = first_per_key(raw.where("id is not null").select("id", "title", "abstract", "categories"), "id", ["title", "abstract", "categories"])
    return one.select("id", X.clean(F.col("title")).alias("title"), X.clean(F.col("abstract")).alias("abstract"), "categories", X.year_of(F.col("id")).alias("year"))


def decisions(outputs: DataFrame) -> DataFrame:
    """One accepted or rejected decision per id of classifier outputs.

    An id delivered twice counts once; where deliveries differ it is accepted if one of them is.
    """
    rows = outputs.where("id is not null").select("id", X.accepted(F.col("confidence")).alias("accept"), F.array_join(X.labels(), ",").alias("labels"))
    return rows.groupBy("id").agg(F.max(F.struct(F.coalesce("accept", F.lit(False)).alias("accept"), "labels")).alias("m")).select("id", "m.accept", "m.labels")


def curate(raw: DataFrame, outputs: DataFrame, year: int = X.YEAR) -> DataFrame:
    """Papers with an abstract, of the year or later, in a related category and accepted."""
    held = papers(raw).where((F.coalesce(F.length("abstract"), F.lit(0)) > 0) & (F.col("year") >= year))
    related = F.arrays_overlap(X.keywords(F.col("title"), F.col("categories")), F.array(*map(F.lit, X.AI_CATEGORIES)))
    return held.where(F.coalesce(related, F.lit(False))).join(decisions(outputs).where("accept"), "id").select("id", "title", "categories", "year", "labels")


def quota(accepted: DataFrame, key: str, most: int = X.QUOTA, prior: int = 0) -> DataFrame:
    """The first rows by key until, with ``prior`` earlier ones, the quota is full; each task keeps
    no more than the quota."""
    return accepted.orderBy(F.col(key).asc_nulls_first()).limit(max(0, most - prior))


def entities(df: DataFrame, column: str = "entities", least: float = X.CONFIDENCE) -> DataFrame:
    """``df`` with the texts of the entities of at least this confidence; NULL lists have none."""
    kept = F.filter(F.coalesce(F.col(column), F.array().cast("array<struct<text:string,confidence:double>>")), lambda e: e["confidence"] >= least)
    return df.withColumn(column, F.transform(kept, lambda e: e["text"]))


def classify(df: DataFrame, model, schema: str, text: str = "abstract") -> DataFrame:
    """``df`` with the fields of ``schema`` that ``model`` gives for a text as JSON.

    ``model`` is a function from a list of prompts to a list of JSON texts, called once a batch in the
    executors. Where it fails or gives no JSON object, flags and maps are empty and ``error_message``
    says why.
    """
    import json

    import pandas as pd

    names = [f.split()[0] for f in X.split_fields(schema)]
    out = ", ".join([f"{f} {t}" for f, t in df.dtypes] + [schema, "error_message string"])

    def run(batches):
        for pdf in batches:
            prompts = [X.prompt_of(t) for t in pdf[text]]
            try:
                answers = list(model(prompts))
            except Exception as e:  # a failed call is a row's error, not the job's
                answers = [e] * len(prompts)
            rows = []
            for a in answers:
                try:
                    got = json.loads(a) if not isinstance(a, Exception) else None
                    rows.append({n: got.get(n) for n in names} | {"error_message": None} if isinstance(got, dict) else {"error_message": str(a) if isinstance(a, Exception) else "no JSON object"})
                except ValueError as e:
                    rows.append({"error_message": str(e)})
            got = pd.DataFrame(rows, columns=[*names, "error_message"], index=pdf.index, dtype=object)
            yield pd.concat([pdf, got], axis=1)

    return df.mapInPandas(run, out)


def accumulated(prior: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The accepted rows of earlier runs and of this one; a key that was accepted before stays as it was."""
    return prior.unionByName(new.join(prior.select(key), key, "left_anti").select(*prior.columns), allowMissingColumns=True)

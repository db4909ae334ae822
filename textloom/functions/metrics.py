"""Text metrics and series."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _grams(x: list, n: int) -> Counter:
    return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))


def bleu4(predict: list, label: list) -> float:
    """BLEU-4 of two sequences, times 100. An order without matches counts as half of the order
    before it that has none (1/2, 1/4 ...) over its grams, so no order makes it 0 but the first."""
    if not predict or not label:
        return 0.0
    logs, halves = 0.0, 1
    for n in range(1, 5):
        p, r = _grams(predict, n), _grams(label, n)
        total = max(1, sum(p.values()))
        hit = sum(min(c, r[g]) for g, c in p.items())
        if hit == 0:
            if n == 1:
                return 0.0
            halves *= 2
            logs += math.log(1 / (halves * total)) / 4
        else:
            logs += math.log(hit / total) / 4
    brevity = 1.0 if len(predict) > len(label) else math.exp(1 - len(label) / len(predict))
    return 100 * brevity * math.exp(logs)


def rouge_n(predict: list, label: list, n: int) -> float:
    """F of distinct n-grams, times 100."""
    p, r = set(_grams(predict, n)), set(_grams(label, n))
    both = len(p & r)
    return 100 * 2 * both / (len(p) + len(r)) if both else 0.0


def rouge_l(predict: list, label: list) -> float:
    """F of the longest common subsequence, times 100."""
    if not predict or not label:
        return 0.0
    row = [0] * (len(label) + 1)
    for x in predict:
        diagonal = 0
        for j, y in enumerate(label, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 100 * 2 * row[-1] / (len(predict) + len(label))


_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("bleu_4", "rouge_1", "rouge_2", "rouge_l")])


_SEGMENT = re.compile(r"[㐀-鿿豈-﫿぀-ヿ가-힯]|[^\s㐀-鿿豈-﫿぀-ヿ가-힯]+")


def segments(text: str) -> list[str]:
    """Blank-separated words; of scripts without blanks, every character is one."""
    return _SEGMENT.findall(text)


@F.pandas_udf(_SCORES)
def text_scores(predict: pd.Series, label: pd.Series) -> pd.DataFrame:
    """Characters for BLEU, segments for ROUGE; an empty side gives 0."""
    out = []
    for p, r in zip(predict.fillna(""), label.fillna(""), strict=True):
        a, b = segments(p), segments(r)
        out.append((round(bleu4(list(p), list(r)), 4), round(rouge_n(a, b, 1), 4), round(rouge_n(a, b, 2), 4), round(rouge_l(a, b), 4)))
    return pd.DataFrame(out, columns=["bleu_4", "rouge_1", "rouge_2", "rouge_l"])


def smoothed(series: Column) -> Column:
    """Exponential mean of an array in its order; the weight grows with its length."""
    n = F.size(series).cast("double")
    w = F.lit(1.8) * (F.lit(1.0) / (F.lit(1.0) + F.exp(-n * 0.05)) - F.lit(0.5))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        v = F.when(s["last"].isNull(), x.cast("double")).otherwise(s["last"] * w + x * (F.lit(1.0) - w))
        return F.struct(v.alias("last"), F.concat(s["out"], F.array(v)).alias("out"))

    return F.aggregate(series, start, step, lambda s: s["out"])


def choice_prompt(question: Column, choices: dict[str, Column], cue: str = "Answer:") -> Column:
    """The question, the choices that are there on lines of their own, and the cue."""
    return F.concat_ws("\n", question, *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}. "), c)) for k, c in choices.items()], F.lit(cue))


def token_accuracy(pred: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of predictions that equal the next label, over the labels that count."""
    n = F.size(labels) - 1
    pairs = F.filter(F.arrays_zip(F.slice(pred, F.lit(1), n).alias("p"), F.slice(labels, F.lit(2), n).alias("y")), lambda z: z["y"] != ignore)
    return F.try_divide(F.size(F.filter(pairs, lambda z: z["p"] == z["y"])).cast("double"), F.size(pairs))


LETTERS = "ABCD"


def chosen_letter(logits: Column, places: dict[str, int]) -> Column:
    """The letter whose token has the greatest logit, of the vocabulary's ``places`` of the letters; the
    first of equal ones."""
    best = F.greatest(*[F.get(logits, F.lit(i)) for i in places.values()])
    out = F.lit(None).cast("string")
    for letter in reversed(places):
        out = F.when(F.get(logits, F.lit(places[letter])) == best, F.lit(letter)).otherwise(out)
    return out


def accuracy_table(df, category: str, correct: Column, order: list[str] | None = None):
    """(category, n, accuracy in percent) by category and ``Average`` over all rows; categories without
    rows are left out, and ``order`` says which come first."""
    rows = df.select(F.col(category).alias("category"), correct.cast("double").alias("c")).where("category is not null")
    out = rows.rollup("category").agg(F.count("*").alias("n"), (100.0 * F.avg("c")).alias("accuracy")).withColumn("category", F.coalesce("category", F.lit("Average"))).where("n > 0")
    if order is None:
        return out
    place = F.array_position(F.array(*map(F.lit, [*order, "Average"])), F.col("category"))
    return out.orderBy(F.when(place == 0, len(order) + 2).otherwise(place), "category")


def rates(rows: Column, batches: Column, seconds: Column) -> tuple[Column, Column]:
    """Rows and batches a second; 0 where no time went by."""
    per = lambda x: F.when(seconds > 0, x / seconds).otherwise(0.0)
    return per(rows), per(batches)


def percentile(df, by: list[str], value: Column, share: float, name: str):
    """The exact interpolated percentile of each group: equal values are counted first, so what a group
    gathers is its distinct values' running counts, cut into ranges, and not its rows."""
    from pyspark.sql import Window

    counts = df.groupBy(*by, value.alias("_v")).agg(F.count("*").alias("_c")).where("_v is not null")
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    # Buckets of values by their leading bits, so that only one bucket of a group is ever sorted.
    bucket = F.floor(F.col("_v"))
    by_bucket = counts.groupBy(*by, bucket.alias("_b")).agg(F.sum("_c").alias("_bc"))
    before = by_bucket.withColumn("_before", F.coalesce(F.sum("_bc").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = (F.col("_n") - 1) * F.lit(share)
    low, high = F.floor(at), F.ceil(at)
    wanted = before.join(total, by).where((F.col("_before") <= high) & (F.col("_before") + F.col("_bc") > low))
    inside = counts.withColumn("_b", bucket).join(wanted.select(*by, "_b", "_before", "_n"), [*by, "_b"])
    run = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_to", F.col("_before") + F.sum("_c").over(run)).withColumn("_from", F.col("_to") - F.col("_c"))
    pick = lambda place: F.max(F.when((F.col("_from") <= place) & (F.col("_to") > place), F.col("_v")))
    ends = inside.groupBy(*by).agg(pick(low).alias("_lo"), pick(high).alias("_hi"), F.max(at - low).alias("_f"))
    return ends.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name))


def named(df, key: str, mapping: dict[str, dict[str, str]], fields: tuple[str, ...] = ("name", "category")):
    """``df`` with the fields that a mapping (of bounded size, one entry a subject) has for a key; NULL for
    an unknown one."""
    out = df
    for f in fields:
        pairs = [F.lit(x) for k, v in mapping.items() for x in (k, v.get(f))]
        out = out.withColumn(f, F.try_element_at(F.create_map(*pairs), F.col(key)) if pairs else F.lit(None).cast("string"))
    return out

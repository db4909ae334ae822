"""Preference, reward and token losses as column expressions over log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow; -log sigmoid(z) is softplus(-z)."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def nlsig(z: Column) -> Column:
    return softplus(-z)


def dpo(pc: Column, pr: Column, rc: Column, rr: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    d = F.lit(beta) * ((pc - pr) - (rc - rr))
    return F.lit(1.0 - smoothing) * nlsig(d) + F.lit(smoothing) * nlsig(-d)


def orpo(pc: Column, pr: Column, beta: float = 0.1) -> Column:
    """Means of log-probabilities, below 0."""
    odds = (pc - pr) - (F.log1p(-F.exp(pc)) - F.log1p(-F.exp(pr)))
    return -pc + F.lit(beta) * nlsig(odds)


def simpo(pc: Column, pr: Column, beta: float = 0.1, gamma: float = 0.5) -> Column:
    return nlsig(F.lit(beta) * ((pc - pr) - F.lit(gamma / beta)))


def bco(reward_c: Column, reward_r: Column, delta: Column) -> Column:
    return nlsig(reward_c - delta) + nlsig(-(reward_r - delta))


def reward_pair(chosen: Column, rejected: Column) -> Column:
    return nlsig(chosen - rejected)


def sequence_logp(logps: Column, labels: Column, ignore: int = -100) -> tuple[Column, Column]:
    """(sum, number) of the log-probabilities whose labels count."""
    used = F.zip_with(logps, labels, lambda p, y: F.when(y != ignore, p))
    kept = F.filter(used, lambda x: x.isNotNull())
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept)


def perplexity(nll: Column) -> Column:
    """exp of the mean; NaN without tokens."""
    return F.when(F.size(nll) == 0, F.lit(float("nan"))).otherwise(F.exp(F.aggregate(nll, F.lit(0.0), lambda s, x: s + x) / F.size(nll)))


def dft(ce: Column) -> Column:
    return ce * F.exp(-ce)


def eaft(ce: Column, top_logits: Column, alpha: float = 1.0, k: int = 20) -> Column:
    """The loss weighted by the entropy of the k greatest logits over 3."""
    top = F.slice(F.sort_array(top_logits, False), 1, k)
    most = F.array_max(top)
    e = F.transform(top, lambda x: F.exp(x - most))
    z = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    entropy = F.log(z) - F.aggregate(F.zip_with(top, e, lambda x, w: (x - most) * w), F.lit(0.0), lambda s, x: s + x) / z
    return ce * F.pow(entropy / 3, F.lit(alpha))


def learning_rate(cutoff: int, batch: int, ratio: Column, small: bool = False) -> Column:
    """3e-4 at 4 million valid tokens a step, by the square root; a sixth for ``small``."""
    lr = F.lit(3e-4) * F.sqrt(F.lit(float(cutoff * batch)) * ratio / 4e6)
    return lr / 6 if small else lr


# --- combined losses and what is logged of them -----------------------------------------------------------

LENGTH_NORMALISED = ("ipo", "orpo", "simpo")


def mean_logp(total: Column, length: Column, epsilon: float = 0.0) -> Column:
    """The log-probability a token; ``epsilon`` keeps an empty answer at 0."""
    return total / (length + epsilon) if epsilon else F.try_divide(total, length)


def preference(kind: str, pc: Column, pr: Column, rc: Column | None = None, rr: Column | None = None, beta: float = 0.1, gamma: float = 0.5, smoothing: float = 0.0, bco_weight: float = 0.0, delta: Column | None = None) -> tuple[Column, Column, Column]:
    """(loss, chosen reward, rejected reward). Without reference log-probabilities the kind is orpo
    or simpo and a reward is beta times the policy's; with them it is sigmoid, into which the bco loss
    may be mixed by its weight."""
    if rc is None or rr is None:
        if kind not in ("orpo", "simpo"):
            raise ValueError(f"{kind} needs a reference")
        loss = orpo(pc, pr, beta) if kind == "orpo" else simpo(pc, pr, beta, gamma)
        return loss, pc * beta, pr * beta
    loss, chosen, rejected = dpo(pc, pr, rc, rr, beta, smoothing), (pc - rc) * beta, (pr - rr) * beta
    if bco_weight > 1e-6:
        loss = (loss + bco(chosen, rejected, F.lit(0.0) if delta is None else delta) * bco_weight) / (1.0 + bco_weight)
    return loss, chosen, rejected


def with_sft(loss: Column, chosen_mean: Column, weight: float) -> Column:
    """A preference loss with the weighted loss of learning the chosen answer."""
    return loss - F.lit(weight) * chosen_mean if weight > 1e-6 else loss


def preference_metrics(chosen: Column, rejected: Column, pc: Column, pr: Column) -> dict[str, Column]:
    """Aggregates over rows: means of rewards, accuracy, margins and log-probabilities."""
    return {"rewards_chosen": F.avg(chosen), "rewards_rejected": F.avg(rejected), "rewards_accuracies": F.avg((chosen > rejected).cast("double")), "rewards_margins": F.avg(chosen - rejected), "logps_chosen": F.avg(pc), "logps_rejected": F.avg(pr)}


def kto_metrics(tag: Column, reward: Column, logp: Column, kl: Column) -> dict[str, Column]:
    """Aggregates over rows: sums and numbers of each side and the kl."""
    side = lambda x, want: F.when(tag == want, x)
    out = {}
    for name, want in (("chosen", True), ("rejected", False)):
        out |= {f"rewards_{name}_sum": F.sum(side(reward, want)), f"logps_{name}_sum": F.sum(side(logp, want)), f"count_{name}": F.count(side(reward, want)).cast("double")}
    return out | {"kl": F.avg(kl)}


def kto_log(metrics: DataFrame) -> DataFrame:
    """One row of the averages of kto metrics kept by several workers: sums over numbers by side, the
    margin where both sides are there, and the sum of the kl."""
    total = metrics.agg(*[F.sum(c).alias(c) for c in metrics.columns])
    mean = {f"{k}_{s}": F.try_divide(F.col(f"{k}_{s}_sum"), F.col(f"count_{s}")) for s in ("chosen", "rejected") for k in ("rewards", "logps")}
    return total.select(*[c.alias(n) for n, c in mean.items()], (mean["rewards_chosen"] - mean["rewards_rejected"]).alias("rewards_margins"), "kl")


def dpo_log(metrics: DataFrame, worker: str) -> DataFrame:
    """One row: each metric's mean over the workers' means; metrics are numbers or NULL."""
    names = [c for c in metrics.columns if c != worker]
    return metrics.groupBy(worker).agg(*[F.avg(c).alias(c) for c in names]).agg(*[F.avg(c).alias(c) for c in names])


def running_average(df: DataFrame, value: str, weight: str, interval: Column, order: str) -> DataFrame:
    """``df`` with ``interval``, and the sum, count and weighted average up to each row in it; a new
    interval begins at 0. An interval has few rows by its nature."""
    w = Window.partitionBy("interval").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("interval", interval)
    total, count = F.sum(F.col(value) * F.col(weight)).over(w), F.sum(weight).over(w)
    return rows.withColumns({"sum": total, "count": count}).withColumn("average", F.try_divide(F.col("sum"), F.col("count")))


def split_logps(logps: Column, labels: Column, kinds: Column, ld_alpha: float | None = None, ignore: int = -100) -> dict[str, Column]:
    """chosen, rejected and their _length and _mean, of a concatenated pair: the sums over the tokens
    of kind 1 and 2 whose label counts. With ``ld_alpha`` what an answer is longer than the other
    counts by that share only. ``logps`` belong to the labels at the same places."""
    rows = F.zip_with(F.arrays_zip(logps.alias("p"), labels.alias("y")), kinds, lambda z, k: F.struct(z["p"].alias("p"), z["y"].alias("y"), k.alias("k")))
    out = {}
    of = lambda kind: F.transform(F.filter(rows, lambda r: (r["k"] == kind) & (r["y"] != ignore)), lambda r: r["p"])
    held = {"chosen": of(1), "rejected": of(2)}
    shorter = F.least(*[F.size(h) for h in held.values()])
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    for n, h in held.items():
        if ld_alpha is None:
            total = add(h)
        else:
            total = add(F.slice(h, F.lit(1), shorter)) + F.lit(ld_alpha) * add(F.slice(h, shorter + 1, F.size(h)))
        out |= {n: total, f"{n}_length": F.size(h), f"{n}_mean": total / (F.size(h) + 1e-6)}
    return out


def log_softmax(logits: Column) -> Column:
    most = F.array_max(logits)
    z = F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - most)))
    return F.transform(logits, lambda x: x - most - z)


def kl_divergence(policy: Column, reference: Column) -> Column:
    """The divergence of the policy from the reference at one place, of their logits."""
    return F.aggregate(F.zip_with(log_softmax(reference), log_softmax(policy), lambda q, p: F.exp(q) * (q - p)), F.lit(0.0), lambda s, x: s + x)


def asft(ce: Column, policy: Column, reference: Column, alpha: float = 0.1) -> Column:
    """The dft loss of a token and alpha times the divergence from the reference."""
    return dft(ce) + F.lit(alpha) * kl_divergence(policy, reference)


def step_loss(loss: Column, valid: Column, step_valid: Column, workers: int = 1) -> Column:
    """A micro batch's mean loss, weighted by its part of the step's valid tokens."""
    return loss * valid * workers / (step_valid + 1e-6)


def tokens_per_second(tokens: Column, epochs: Column, runtime: Column, workers: int = 1) -> Column:
    """Tokens of the data times the epochs, a second and worker; 0 without a runtime."""
    return F.coalesce(F.try_divide(tokens * epochs, runtime * workers), F.lit(0.0))


# --- fixed values: peak operations a second by device ---------------------------------------------------------
PEAK_FLOPS = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "V100": 125e12, "4090": 98e12}

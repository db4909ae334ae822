"""Token budgets, loss masks and packing over arrays of token ids."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plugins import BATCHING

IGNORE = -100


def token_ids(text: Column) -> Column:
    """Ids of blank-separated words, of 31 bits; the tokenizer where none is given."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda x: x != ""), lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("int"))


def seqlens(source: Column, target: Column, cutoff: int | Column) -> tuple[Column, Column]:
    """(source, target) lengths that fit the cutoff: a short side is kept whole, else in proportion."""
    room = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    most = F.when(target * 2 < room, room).when(source * 2 < room, room - source).otherwise(F.floor(room * (target / (source + target))))
    new_target = F.least(most, target)
    return F.greatest(F.least(F.greatest(room - new_target, F.lit(0)), source), F.lit(0)).cast("int"), new_target.cast("int")


def sft(prompt: Column, response: Column, cutoff: int, train_on_prompt: bool = False) -> tuple[Column, Column, Column]:
    """(input_ids, attention_mask, labels) of one turn; the prompt's labels are ignored."""
    s, t = seqlens(F.size(prompt), F.size(response), cutoff)
    p, r = F.slice(prompt, F.lit(1), s), F.slice(response, F.lit(1), t)
    ids = F.concat(p, r)
    masked = p if train_on_prompt else F.array_repeat(F.lit(IGNORE), s)
    return ids, F.array_repeat(F.lit(1), F.size(ids)), F.concat(masked, r)


def pairwise(prompt: Column, chosen: Column, rejected: Column, cutoff: int) -> dict[str, Column]:
    """chosen_ and rejected_ input_ids and labels; the longer response sets the budget of both."""
    s, t = seqlens(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), cutoff)
    p, mask = F.slice(prompt, F.lit(1), s), F.array_repeat(F.lit(IGNORE), s)
    out = {}
    for name, x in (("chosen", chosen), ("rejected", rejected)):
        cut = F.slice(x, F.lit(1), t)
        out[f"{name}_input_ids"], out[f"{name}_labels"] = F.concat(p, cut), F.concat(mask, cut)
    return out


def shifted_in_batch(value: str, ord_: str = "_ord", batch_rows: int = 1000) -> Column:
    """The value of the row before in its batch; the batch's last value for its first row."""
    own = Window.partitionBy(F.floor(F.col(ord_) / batch_rows)).orderBy(ord_)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.when(F.row_number().over(own) == 1, F.last(value).over(whole)).otherwise(F.lag(value).over(own))


def pretrain_blocks(df: DataFrame, tokens: Column, block: int, batch_rows: int = 1000, ord_: str = "_ord") -> DataFrame:
    """(batch, block, input_ids): each batch's tokens in row order, cut into full blocks; what is
    left of a batch is dropped, as the batch is the unit. A batch has at most ``batch_rows`` rows.

    Rows are cut where blocks end and only the cuts are moved, never single tokens.
    """
    w = Window.partitionBy("batch").orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(F.floor(F.col(ord_) / batch_rows).alias("batch"), ord_, tokens.alias("t")).withColumn("n", F.size("t"))
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("n > 0")
    first, last = F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n") - 1) / block)
    cut = rows.select("batch", "before", "t", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("before"), F.lit(0)).cast("int")
    stop = ((F.col("block") + 1) * block - F.col("before")).cast("int")
    cut = cut.select("batch", "block", "before", F.slice("t", start + 1, stop - start).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("before", "t"))), lambda x: x["t"])
    return cut.groupBy("batch", "block").agg(F.flatten(parts).alias("input_ids")).where(F.size("input_ids") == block)


def greedy_knapsack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of each pack: the longest that still fits comes next; of equal lengths the later row."""
    rows: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        rows[n].append(i)
    sizes = sorted(rows)
    if sizes and sizes[-1] > capacity:
        raise ValueError("an item exceeds the capacity")
    packs = []
    while sizes:
        pack, room = [], capacity
        while at := bisect_right(sizes, room):
            n = sizes[at - 1]
            pack.append(rows[n].pop())
            room -= n
            if not rows[n]:
                del sizes[at - 1]
        packs.append(pack)
    return packs


def pack_sft(df: DataFrame, key: str, ids: Column, labels: Column, cutoff: int, batch_rows: int = 1000, ord_: str = "_ord") -> DataFrame:
    """(batch, pack, segment, key, start, length): greedy packs within batches of rows.

    Rows longer than the cutoff are dropped. The capacity is the cutoff; segments count from 1.
    """
    rows = df.select(F.floor(F.col(ord_) / batch_rows).alias("batch"), F.col(ord_).alias("o"), F.col(key).cast("string").alias("k"), F.size(ids).alias("n")).where((F.col("n") <= cutoff) & (F.col("n") > 0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o").reset_index(drop=True)
        out = []
        for p, pack in enumerate(greedy_knapsack(pdf["n"].tolist(), cutoff)):
            at = 0
            for s, i in enumerate(pack, 1):
                out.append((pdf["batch"][0], p, s, pdf["k"][i], at, pdf["n"][i]))
                at += pdf["n"][i]
        return pd.DataFrame(out, columns=["batch", "pack", "segment", "key", "start", "length"])

    return rows.groupBy("batch").applyInPandas(run, "batch long, pack int, segment int, key string, start int, length int")


#: Stands for "no media" in the packing parameters, so that the list is never empty.
NO_MEDIA = 1 << 32
PACKED = "batch long, pack int, keys array<string>, input_ids array<int>, attention_mask array<int>, position_ids array<int>, labels array<int>, packing_params struct<sequence_boundaries:array<int>,image_subseq_ids:array<bigint>,video_subseq_ids:array<bigint>,audio_subseq_ids:array<bigint>,right_padding_length:int>"


def packed_sft(df: DataFrame, key: str, ids: Column, labels: Column, cutoff: int, pad_id: int = 0, neat: bool = True, media: dict[str, str] | None = None, batch_rows: int = 1000, ord_: str = "_ord") -> DataFrame:
    """PACKED: the packs of ``pack_sft`` with their ids, masks, positions and labels, padded to
    cutoff + 1.

    ``neat``: the mask numbers the segments from 1 and is 0 on padding, else it is 1 everywhere.
    ``media``: columns with the numbers of images, videos and audios of a row. Positions begin again
    in each segment; padding is a range of its own in the boundaries. Longer rows are dropped.
    """
    kinds = ("image", "video", "audio")
    counts = [(F.coalesce(F.col(media[k]), F.lit(0)) if media and k in media else F.lit(0)).cast("int").alias(k) for k in kinds]
    rows = df.select(F.floor(F.col(ord_) / batch_rows).alias("batch"), F.col(ord_).alias("o"), F.col(key).cast("string").alias("k"), ids.alias("ids"), labels.alias("labels"), *counts).where(F.size("ids") <= cutoff)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o").reset_index(drop=True)
        out = []
        for p, pack in enumerate(greedy_knapsack([len(x) for x in pdf["ids"]], cutoff)):
            sizes = [len(pdf["ids"][i]) for i in pack]
            rest = cutoff + 1 - sum(sizes)
            fill = lambda parts, value, rest=rest: np.concatenate([*parts, np.full(rest, value)]).astype(np.int32)
            mask = fill([np.full(n, s if neat else 1) for s, n in enumerate(sizes, 1)], 0 if neat else 1)
            ends = np.cumsum([0, *sizes, rest]).tolist()
            subs = [[s for s, i in enumerate(pack) for _ in range(pdf[k][i])] or [NO_MEDIA] for k in kinds]
            params = {"sequence_boundaries": ends, "image_subseq_ids": subs[0], "video_subseq_ids": subs[1], "audio_subseq_ids": subs[2], "right_padding_length": rest}
            out.append((pdf["batch"][0], p, [pdf["k"][i] for i in pack], fill([pdf["ids"][i] for i in pack], pad_id), mask, fill([np.arange(n) for n in sizes], 0), fill([pdf["labels"][i] for i in pack], IGNORE), params))
        return pd.DataFrame(out, columns=["batch", "pack", "keys", "input_ids", "attention_mask", "position_ids", "labels", "packing_params"])

    return rows.groupBy("batch").applyInPandas(run, PACKED)


# --- encoding -----------------------------------------------------------------------------------------------


def multi_turn(pairs: Column, cutoff: int, train_on_prompt: bool = False, mask_history: bool = False, eos: int | None = None) -> tuple[Column, Column]:
    """(input_ids, labels) of a dialogue: array<struct<prompt: array<int>, response: array<int>>>.

    Pairs are taken while the cutoff has room, each cut to what is left; with ``mask_history`` from
    the last one back, and only the last is learned. ``eos`` (where a template ends turns with it
    only) closes the whole and is learned at the start of each later prompt.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0 if eos is None else 1).alias("total"), F.lit(0).alias("turn"), none.alias("ids"), none.alias("labels"))
    masked = lambda n: F.array_repeat(F.lit(IGNORE), n)

    def step(s: Column, p: Column) -> Column:
        a, b = seqlens(F.size(p["prompt"]), F.size(p["response"]), F.lit(cutoff) - s["total"])
        source, target = F.slice(p["prompt"], F.lit(1), a), F.slice(p["response"], F.lit(1), b)
        if train_on_prompt:
            before = source
        elif eos is not None:
            before = F.when(s["turn"] > 0, F.slice(F.concat(F.array(F.lit(eos)), masked(F.greatest(a - 1, F.lit(0)))), F.lit(1), F.greatest(a, F.lit(1)))).otherwise(masked(a))
        else:
            before = masked(a)
        after = F.when(s["turn"] > 0, masked(b)).otherwise(target) if mask_history else target
        join = (lambda new, old: F.concat(new, old)) if mask_history else (lambda new, old: F.concat(old, new))
        nxt = F.struct((s["total"] + a + b).alias("total"), (s["turn"] + 1).alias("turn"), join(F.concat(source, target), s["ids"]).alias("ids"), join(F.concat(before, after), s["labels"]).alias("labels"))
        return F.when(s["total"] >= cutoff, s).otherwise(nxt)

    done = F.aggregate(F.reverse(pairs) if mask_history else pairs, start, step)
    tail = F.array(F.lit(eos)) if eos is not None else none
    return F.concat(done["ids"], tail), F.concat(done["labels"], tail)


def pretrain(tokens: Column, cutoff: int, eos: int, bos: int | None = None) -> Column:
    """A text's ids with its end (and, where the tokenizer has one, its beginning), cut to the cutoff."""
    whole = F.concat(tokens, F.array(F.lit(eos)))
    return F.slice(F.concat(F.array(F.lit(bos)), whole) if bos is not None else whole, F.lit(1), F.lit(cutoff))


def unsupervised(prompt: Column, response: Column, cutoff: int) -> tuple[Column, Column]:
    """(input_ids, labels): the prompt and the response, cut on their own."""
    s, t = seqlens(F.size(prompt), F.size(response), cutoff)
    return F.slice(prompt, F.lit(1), s), F.slice(response, F.lit(1), t)


#: What a stage needs: valid examples (see ``align.valid``) and the columns that it makes.
STAGES = ("pt", "sft", "rm", "kto", "generate")


def encode(df: DataFrame, stage: str, cutoff: int, template=None, tokenizer=token_ids, keep: list[str] = (), packing: bool = False, eos: int = 0, batch_rows: int = 1000, **options) -> DataFrame:
    """Aligned examples (see ``align``) as the columns of a stage; invalid examples are dropped.

    pt: input_ids of the first prompt message. sft: input_ids, attention_mask, labels, or PACKED
    with ``packing``. rm: chosen_ and rejected_ of the three. kto: those of sft, kl_ and kto_tags
    (the mismatched answers come from the row before in its batch; needs ``_ord``). generate: the
    prompt as input_ids and the response as labels. ``options`` go to ``multi_turn``, but for ``think``,
    which goes to the template. A template without an end token gets ``eos`` at the end of answers.
    """
    from textloom.operators.align import valid
    from textloom.operators.templates import TEMPLATES, one_turn, turn_pairs

    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}; one of {STAGES}")
    if stage == "pt":
        ids = pretrain(tokenizer(F.col("_prompt")[0]["content"]), cutoff, eos)
        return df.where(F.size("_prompt") > 0).select(*keep, ids.alias("input_ids")).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    template = template or TEMPLATES["default"]
    ones = lambda c: F.array_repeat(F.lit(1), F.size(c))

    end = F.array(F.lit(eos)) if template.efficient_eos else None
    think = options.pop("think", True)

    def turn(response: Column) -> tuple[Column, Column]:
        prompt, answer = one_turn(template, F.concat("_prompt", F.array(response)), F.col("_system"), think=think)
        ids = tokenizer(answer)
        return tokenizer(prompt), ids if end is None else F.concat(ids, end)

    if stage == "sft":
        pairs = F.transform(turn_pairs(template, F.concat("_prompt", "_response"), F.col("_system"), think=think, discard_history=options.get("mask_history", False)), lambda p: F.struct(tokenizer(p["prompt"]).alias("prompt"), tokenizer(p["response"]).alias("response")))
        ids, labels = multi_turn(F.col("_pairs"), cutoff, eos=eos if template.efficient_eos else None, **options)
        rows = df.where(valid("sft")).withColumn("_pairs", pairs)
        if packing:
            rows = rows.select(*dict.fromkeys([*keep, "_ord"]), ids.alias("_ids"), labels.alias("_labels"))
            return packed_sft(rows, keep[0], F.col("_ids"), F.col("_labels"), cutoff, batch_rows=batch_rows)
        return rows.select(*keep, ids.alias("input_ids"), labels.alias("labels")).withColumn("attention_mask", ones("input_ids"))
    if stage == "generate":
        from textloom.operators.align import message

        p, r = turn(F.coalesce(F.when(F.size("_response") == 1, F.get("_response", F.lit(0))), message("assistant", F.lit(""))))
        rows = df.where(valid("generate")).select(*keep, p.alias("_p"), r.alias("_r"))
        ids, labels = unsupervised(F.col("_p"), F.col("_r"), cutoff)
        return rows.select(*keep, ids.alias("input_ids"), labels.alias("labels")).withColumn("attention_mask", ones("input_ids"))
    if stage == "rm":
        (p, c), (_, r) = turn(F.col("_response")[0]), turn(F.col("_response")[1])
        rows = df.where(valid("rm")).select(*keep, p.alias("_p"), c.alias("_c"), r.alias("_r"))
        out = rows.select(*keep, *[x.alias(n) for n, x in pairwise(F.col("_p"), F.col("_c"), F.col("_r"), cutoff).items()])
        return out.withColumns({f"{n}_attention_mask": ones(f"{n}_input_ids") for n in ("chosen", "rejected")})
    # The offset runs over all rows of a batch, invalid ones too.
    rows = df.withColumn("_kl", shifted_in_batch("_response", batch_rows=batch_rows)).where(valid("kto"))
    first = lambda x: F.when(F.coalesce(x[0]["content"], F.lit("")) != "", x[0]).otherwise(F.coalesce(F.get(x, F.lit(1)), x[0]))
    (p, own), (kp, other) = turn(first(F.col("_response"))), turn(first(F.col("_kl")))
    rows = rows.select(*keep, (F.coalesce(F.col("_response")[0]["content"], F.lit("")) != "").alias("kto_tags"), p.alias("_p"), own.alias("_o"), kp.alias("_kp"), other.alias("_k"))
    ids, mask, labels = sft(F.col("_p"), F.col("_o"), cutoff)
    kl_ids, kl_mask, kl_labels = sft(F.col("_kp"), F.col("_k"), cutoff)
    return rows.select(*keep, ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"), kl_ids.alias("kl_input_ids"), kl_mask.alias("kl_attention_mask"), kl_labels.alias("kl_labels"), "kto_tags")


def preference_counts(df: DataFrame) -> DataFrame:
    """(desirable, undesirable, one_sided): how many rows have each kto tag."""
    both = df.agg(F.count_if("kto_tags").alias("desirable"), F.count_if(~F.col("kto_tags")).alias("undesirable"))
    return both.withColumn("one_sided", (F.col("desirable") == 0) | (F.col("undesirable") == 0))


# --- batching -------------------------------------------------------------------------------------------


def pad(array: Column, n: Column | int, value: int) -> Column:
    """Cut or filled at the end to ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(array, F.array_repeat(F.lit(value), F.greatest(n - F.size(array), F.lit(0)))), F.lit(1), n)


def causal_blocks(segments: Column) -> Column:
    """Row i, column j: whether position i sees j (same segment, not 0, j not after i)."""
    return F.transform(segments, lambda a, i: F.transform(segments, lambda b, j: (a == b) & (a != 0) & (j <= i)))


def segment_lengths(segments: Column) -> Column:
    """The length of each segment (numbered from 1) of a packed mask."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(segments), F.lit(1))), lambda s: F.size(F.filter(segments, lambda x: x == s)))


def unpadded(segments: Column) -> Column:
    """Positions that are not padding."""
    return F.filter(F.transform(segments, lambda x, i: F.when(x != 0, i)), lambda x: x.isNotNull())


def valid_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def dynamic_batches(df: DataFrame, shard: str, order: str, length: str, budget: int, padded: bool = True) -> DataFrame:
    """(shard, order, length, batch): rows in order, as many to a batch as keep the longest times
    their number (or, without padding, their sum) within the budget. One pass over sorted rows with
    a state of three numbers; a row over the budget is a batch of its own."""
    cols = [shard, order, length]
    src = df.select(*cols).repartition(shard).sortWithinPartitions(shard, order)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, no, top, n, total = None, 0, 0, 0, 0
        for pdf in pdfs:
            out = []
            for s, x in zip(pdf[shard], pdf[length], strict=True):
                if s != held:
                    held, no, top, n, total = s, 0, 0, 0, 0
                size = max(top, x) * (n + 1) if padded else total + x
                if n and size > budget:
                    no, top, n, total = no + 1, 0, 0, 0
                top, n, total = max(top, x), n + 1, total + x
                out.append(no)
            yield pdf.assign(batch=out)

    kinds = dict(src.dtypes)
    return src.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", batch int")


def kto(df: DataFrame, prompt: str, response: str, kl_response: str, cutoff: int) -> DataFrame:
    """``df`` with input_ids, labels, kl_input_ids, kl_labels and kto_tags.

    ``response`` and ``kl_response`` are arrays of two token arrays (desirable, undesirable), of
    which one is empty; the tag says whether the first is not. The mismatched pair takes the first
    of its two that is not empty and is cut on its own.
    """
    tag = F.size(F.col(response)[0]) > 0
    own = F.when(tag, F.col(response)[0]).otherwise(F.col(response)[1])
    other = F.when(F.size(F.col(kl_response)[0]) > 0, F.col(kl_response)[0]).otherwise(F.col(kl_response)[1])
    ids, _, labels = sft(F.col(prompt), own, cutoff)
    kl_ids, _, kl_labels = sft(F.col(prompt), other, cutoff)
    return df.select("*", ids.alias("input_ids"), labels.alias("labels"), kl_ids.alias("kl_input_ids"), kl_labels.alias("kl_labels"), tag.alias("kto_tags"))


# --- collation --------------------------------------------------------------------------------------------


def collate(df: DataFrame, size: int, pads: dict[str, int], ord_: str = "_ord", multiple: int = 1) -> DataFrame:
    """``df`` with ``batch`` (``size`` rows by ``_ord``) and the columns of ``pads`` filled to the
    longest of their batch, rounded up to a ``multiple``. A batch has few rows by its nature."""
    w = Window.partitionBy("batch")
    rows = df.withColumn("batch", F.floor(F.col(ord_) / size))
    longest = {c: (F.ceil(F.max(F.size(c)).over(w) / multiple) * multiple).cast("int") for c in pads}
    rows = rows.withColumns({f"_n_{c}": n for c, n in longest.items()})
    return rows.withColumns({c: pad(F.col(c), F.col(f"_n_{c}"), v) for c, v in pads.items()}).drop(*[f"_n_{c}" for c in pads])


def collate_pairs(df: DataFrame, size: int, pad_id: int = 0, keep: list[str] = (), ord_: str = "_ord") -> DataFrame:
    """(batch, row, side, keep, input_ids, attention_mask, labels): twice as many rows a batch, all
    chosen ones first, padded to the longest of both."""
    names = ("input_ids", "attention_mask", "labels")
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("side"), *[F.col(f"{n}_{c}").alias(c) for c in names]) for i, n in enumerate(("chosen", "rejected"))])
    n = F.count("*").over(Window.partitionBy(F.floor(F.col(ord_) / size)))
    rows = df.withColumn("_n", n).select(ord_, "_n", *keep, F.explode(sides).alias("s")).select(ord_, "_n", *keep, "s.*")
    rows = collate(rows, size, {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE}, ord_)
    return rows.select("batch", (F.col("i") * F.col("_n") + F.col(ord_) % size).alias("row"), "side", *keep, *names)


def collate_kto(df: DataFrame, size: int, pad_id: int = 0, ord_: str = "_ord") -> DataFrame:
    """Batches of kto examples; the mismatched ones are padded on their own."""
    pads = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE}
    return collate(df, size, {**pads, **{f"kl_{c}": v for c, v in pads.items()}}, ord_)


def additive(mask: Column, least: float = float(np.finfo(np.float32).min)) -> Column:
    """A mask of booleans (see ``causal_blocks``) as what is added to scores: 0 or the least float."""
    return F.transform(mask, lambda row: F.transform(row, lambda x: F.when(x, 0.0).otherwise(least)))


def padding_free(df: DataFrame, size: int, cutoff: int, ord_: str = "_ord") -> DataFrame:
    """(batch, input_ids, labels, loss_weights, position_ids): the samples of a batch in one sequence,
    each cut to the cutoff. Positions begin again with each sample, and the first label and weight of
    all but the first are left out; empty samples vanish. The last, short batch is dropped."""
    cut = lambda c: F.slice(c, F.lit(1), F.lit(cutoff))
    rows = df.select(F.floor(F.col(ord_) / size).alias("batch"), F.col(ord_).alias("o"), cut("input_ids").alias("ids"), cut("labels").alias("labels"), cut("loss_weights").alias("weights"))
    held = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("o", "ids", "labels", "weights"))).alias("s")).where(F.size("s") == size)
    full = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("i"), x["ids"].alias("ids"), x["labels"].alias("labels"), x["weights"].alias("weights"))), lambda x: F.size(x["ids"]) > 0)
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    headless = lambda x, name, first: F.when(x["i"] > 0, F.concat(F.array(F.lit(first)), rest(x[name]))).otherwise(x[name])
    held = held.withColumn("s", full).where(F.size("s") > 0)
    return held.select(
        "batch",
        F.flatten(F.transform("s", lambda x: x["ids"])).alias("input_ids"),
        F.flatten(F.transform("s", lambda x: headless(x, "labels", IGNORE))).alias("labels"),
        F.flatten(F.transform("s", lambda x: headless(x, "weights", 0.0))).alias("loss_weights"),
        F.flatten(F.transform("s", lambda x: F.sequence(F.lit(0), F.size(x["ids"]) - 1))).alias("position_ids"),
    )


def micro_batches(df: DataFrame, micro: int, num: int, ord_: str = "_ord") -> DataFrame:
    """``df`` with ``batch`` and ``micro``, the place of its micro batch: full batches of
    ``micro * num`` rows only."""
    rows = df.withColumn("batch", F.floor(F.col(ord_) / (micro * num)))
    full = rows.groupBy("batch").agg(F.count("*").alias("_n")).where(F.col("_n") == micro * num).select("batch")
    return rows.join(full, "batch", "left_semi").withColumn("micro", F.floor(F.col(ord_) % (micro * num) / micro).cast("int"))


def batches_of(rows: int, micro: int, num: int) -> int:
    """How many batches so many rows are estimated to make."""
    return -(-rows // (micro * num))


def micro_batches_of(total: int, workers: int, micro: int) -> int:
    """Micro batches of a global batch for each worker; a rest is refused."""
    if total % (workers * micro):
        raise ValueError(f"a global batch of {total} is not divisible by {workers} workers times {micro}")
    return total // (workers * micro)


class TokenBuffer:
    """Rows in order with their number of tokens; its state can be kept and restored."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.tokens = capacity, [], 0

    def put(self, row: list[int]) -> bool:
        """Whether the row still fits; an empty buffer takes any."""
        if self.rows and self.tokens + len(row) > self.capacity:
            return False
        self.rows.append(row)
        self.tokens += len(row)
        return True

    def get(self, n: int) -> list[list[int]]:
        out, self.rows = self.rows[:n], self.rows[n:]
        self.tokens = sum(map(len, self.rows))
        return out

    def state(self) -> dict:
        return {"capacity": self.capacity, "rows": [list(r) for r in self.rows]}

    @classmethod
    def restored(cls, state: dict) -> TokenBuffer:
        out = cls(state["capacity"])
        out.rows = [list(r) for r in state["rows"]]
        out.tokens = sum(map(len, out.rows))
        return out


# --- arrays of ids ------------------------------------------------------------------------------------------


def positions(segments: Column) -> Column:
    """Positions that begin again with each segment; 0 on padding. Segments are runs, from 1."""
    return F.transform(segments, lambda s, i: F.when(s == 0, 0).otherwise(i - (F.array_position(segments, s) - 1)).cast("int"))


def last_valid(labels: Column) -> Column:
    """The index from 0 of the last label that counts; -1 for none."""
    return F.coalesce(F.array_max(F.transform(labels, lambda x, i: F.when(x != IGNORE, i))), F.lit(-1))


def first_valid(labels: Column) -> Column:
    """The index from 0 of the first label that counts; -1 for none."""
    return F.coalesce(F.array_min(F.transform(labels, lambda x, i: F.when(x != IGNORE, i))), F.lit(-1))


def pair_survives(labels: Column, kinds: Column) -> Column:
    """Whether a concatenated pair has both chosen (1) and rejected (2) tokens that count."""
    of = lambda k: F.exists(F.arrays_zip(labels.alias("y"), kinds.alias("k")), lambda z: (z["k"] == k) & (z["y"] != IGNORE))
    return of(1) & of(2)


def unmasked(labels: Column, pad_id: int) -> Column:
    """Ignored labels as padding, so that the rest can be decoded."""
    return F.transform(labels, lambda x: F.when(x == IGNORE, pad_id).otherwise(x))


def pads_last(ids: Column, pad_id: int) -> Column:
    """Leading padding moved to the end; a row of nothing else stays as it is."""
    first = F.array_min(F.transform(ids, lambda x, i: F.when(x != pad_id, i)))
    n = F.coalesce(first, F.lit(0))
    return F.concat(F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))), F.slice(ids, F.lit(1), n))


def trimmed(query: Column, response: Column, pad_id: int, eos: int) -> tuple[Column, Column]:
    """(query without leading padding, response without what follows its last token). Where the end
    token pads too, its first one after the answer stays; an empty answer keeps one token."""
    start = F.coalesce(F.array_min(F.transform(query, lambda x, i: F.when(x != pad_id, i))), F.size(query))
    last = F.coalesce(F.array_max(F.transform(response, lambda x, i: F.when(x != pad_id, i))), F.lit(-1)) + 1
    keep = F.when(last == 0, 1).otherwise(last + (1 if pad_id == eos else 0))
    return F.slice(query, start + 1, F.greatest(F.size(query) - start, F.lit(0))), F.slice(response, F.lit(1), keep)


def nested(flat: Column, lengths: Column) -> Column:
    """A flat array as arrays of the given lengths."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.aggregate(lengths, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(F.slice(flat.cast("array<int>"), s["at"] + 1, n))).alias("out")))["out"]


def token_types(ids: Column, image_id: int) -> Column:
    """1 where a token stands for an image, else 0."""
    return F.transform(ids, lambda x: (x == image_id).cast("int"))


def prefix_types(images: Column, length: Column, per_image: int) -> Column:
    """0 on the prefix that images take, 1 after it."""
    n = F.least(images * per_image, length)
    return F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), length - n))


def argmax(scores: Column) -> Column:
    """The place from 0 of the greatest score; the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def example(df: DataFrame, order: list[str], decode) -> str:
    """The first row as text: its ids and its labels that count, both decoded by ``decode`` (a function of
    a list of ids); "" for no rows."""
    row = df.orderBy(*order).limit(1).select("input_ids", "labels").first()
    if row is None:
        return ""
    kept = [x for x in row["labels"] if x != IGNORE]
    return f"input_ids: {row['input_ids']}\ninputs: {decode(row['input_ids'])}\nlabel_ids: {row['labels']}\nlabels: {decode(kept)}"


# --- strategies of batching -----------------------------------------------------------------------------------
# Each has the hooks ``rows`` (how many a batch takes at once), ``count`` (how many batches so many rows make) and
# ``make`` (the batches of a table).

BATCHING.register("normal", "rows")(lambda micro, num: micro * num)
BATCHING.register("normal", "count")(batches_of)
BATCHING.register("normal", "make")(micro_batches)
BATCHING.register("padding_free", "rows")(lambda micro, num: micro * num)
BATCHING.register("padding_free", "count")(lambda rows, micro, num: rows // (micro * num))
BATCHING.register("padding_free", "make")(padding_free)
BATCHING.register("dynamic_batching", "rows")(lambda micro, num: 1)
BATCHING.register("dynamic_batching", "count")(batches_of)
BATCHING.register("dynamic_batching", "make")(dynamic_batches)
BATCHING.register("dynamic_padding_free", "rows")(lambda micro, num: 1)
BATCHING.register("dynamic_padding_free", "count")(batches_of)
BATCHING.register("dynamic_padding_free", "make")(lambda *args, **kw: dynamic_batches(*args, padded=False, **kw))

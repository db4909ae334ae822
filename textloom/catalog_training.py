"""Queries of encoding, packing, collation, losses and their logs, the data engine and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.catalog import _CHAT, _PAIRS, _chat, _pairs, query
from textloom.catalog_formats import _DIALOGUES, _SOUND, _WORDS7, dialogues, hexed
from textloom.common import read
from textloom.functions import losses as L
from textloom.functions import metrics as M
from textloom.functions import text as X
from textloom.operators import align as A
from textloom.operators import encode as E
from textloom.operators import engine as G
from textloom.operators import store as S
from textloom.operators import mixing as MX
from textloom.operators.sequence import with_ordinal
from textloom.operators.vector import nearest_in_blocks, usable
from textloom.plans import curation as P
from textloom.sources import records as RC

_K = lambda c: _WORDS7.format(f"coalesce({c}, '')")
_JOIN = lambda x: f"md5(array_to_string({x}, ' '))"
_DASH = lambda x: f"list_transform({x}, lambda x: '-')"
_TOKENS = f"""{_PAIRS}, k as (select id, {_K("prompt")} as p, {_K("reply")} as r from pairs)"""


def _tokens(spark, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", E.token_ids(F.col("prompt")).alias("p"), E.token_ids(F.col("reply")).alias("r"))


def _digest(c) -> F.Column:
    return F.md5(hexed(c if not isinstance(c, str) else F.col(c)))


# The lengths that fit a cutoff of 32, as in ``infer_seqlen``.
_CUT = lambda s, t: f"""cast(least({t}, case when {t} * 2 < 32 then 32 when {s} * 2 < 32 then 32 - {s} else cast(floor(32 * ({t} / ({s} + {t}))) as bigint) end) as bigint)"""


# --- encoding -----------------------------------------------------------------------------------------------


@query(f"""with {_TOKENS}, l as (select *, {_CUT("len(p)", "len(r)")} as t from k where len(p) > 0 and len(r) > 0), c as (select id, p[: greatest(least(32 - t, len(p)), 0)] as p, r[: t] as r from l)
    select id, {_JOIN("list_concat(p, r)")} as ids, {_JOIN(f"list_concat({_DASH('p')}, r)")} as labels from c""")
def sft_ids(spark, sf_dir):
    rows = _tokens(spark, sf_dir).where((F.size("p") > 0) & (F.size("r") > 0))
    ids, _, labels = E.sft(F.col("p"), F.col("r"), 32)
    return rows.select("id", _digest(ids).alias("ids"), _digest(labels).alias("labels"))


_TURNS = f"""with {_DIALOGUES}, {_SOUND}, p as (select session_id, block, len(m) as n, list_transform(range(1, len(m) + 1), lambda i: {_K("m[i].content")}) as t from g where good)"""


def _turns(spark, sf_dir: str) -> DataFrame:
    """(session_id, block, pairs) of the sound dialogues."""
    _, msgs = A.split_system(A.turns(F.col("m"), "role", "content"))
    rows = dialogues(spark, sf_dir).select("session_id", "block", msgs.alias("m")).where(A.is_sound(F.col("m")))
    at = lambda i: E.token_ids(F.get("m", i)["content"])
    return rows.select("session_id", "block", F.transform(F.sequence(F.lit(0), F.size("m") - 2, F.lit(2)), lambda i: F.struct(at(i).alias("prompt"), at(i + 1).alias("response"))).alias("pairs"))


@query(_TURNS + f""" select session_id, block, {_JOIN("flatten(t)")} as ids, {_JOIN(f"flatten(list_transform(range(1, len(t) + 1), lambda i: case when i % 2 = 0 then t[i] else {_DASH('t[i]')} end))")} as labels,
    {_JOIN(f"flatten(list_transform(range(1, len(t) + 1), lambda i: case when i = len(t) then t[i] else {_DASH('t[i]')} end))")} as last_labels from p""")
def sft_multi_turn(spark, sf_dir):
    """Every turn learned, and with masked history the last one only; nothing is cut at this length."""
    rows = _turns(spark, sf_dir)
    ids, labels = E.multi_turn(F.col("pairs"), 1_000_000)
    _, last = E.multi_turn(F.col("pairs"), 1_000_000, mask_history=True)
    return rows.select("session_id", "block", _digest(ids).alias("ids"), _digest(labels).alias("labels"), _digest(last).alias("last_labels"))


@query(_TURNS + f""" select session_id, block, {_JOIN("list_concat(flatten(t), ['0000007'])")} as ids,
    {_JOIN(f"list_concat(flatten(list_transform(range(1, len(t) + 1), lambda i: case when i % 2 = 0 then t[i] when i > 1 and len(t[i]) > 0 then list_concat(['0000007'], {_DASH('t[i][2:]')}) else {_DASH('t[i]')} end)), ['0000007'])")} as labels from p where list_bool_and(list_transform(t, lambda x: len(x) > 0))""")
def sft_efficient_eos(spark, sf_dir):
    rows = _turns(spark, sf_dir).where(F.forall("pairs", lambda p: (F.size(p["prompt"]) > 0) & (F.size(p["response"]) > 0)))
    ids, labels = E.multi_turn(F.col("pairs"), 1_000_000, eos=7)
    return rows.select("session_id", "block", _digest(ids).alias("ids"), _digest(labels).alias("labels"))


@query(f"""with {_TOKENS}, oo as (select *, cast(floor((row_number() over (order by id) - 1) / 1000) as bigint) as batch, len(p) + len(r) as n from k)
    select batch, count(*) as rows, cast(sum(n) as bigint) as tokens, cast(sum(len(r)) as bigint) as learned, cast(0 as bigint) as faults from oo where n <= 256 group by batch""")
def packed_sft(spark, sf_dir):
    """What goes into the packs of each batch, and how many packs break a rule: the length, boundaries
    that end elsewhere, a mask that does not number the rows, positions that do not begin again."""
    rows = with_ordinal(_tokens(spark, sf_dir), ["id"])
    ids, labels = F.concat("p", "r"), F.concat(F.array_repeat(F.lit(E.IGNORE), F.size("p")), "r")
    packs = E.packed_sft(rows, "id", ids, labels, 256)
    bounds = F.col("packing_params.sequence_boundaries")
    starts = F.size(F.filter(F.slice("position_ids", F.lit(1), F.lit(257) - F.col("packing_params.right_padding_length")), lambda x: x == 0))
    fault = (F.size("input_ids") != 257) | (F.element_at(bounds, -1) != 257) | (F.array_max("attention_mask") != F.size("keys")) | (starts != F.size("keys")) | (F.size(bounds) != F.size("keys") + 2) | (F.element_at("packing_params.image_subseq_ids", 1) != E.NO_MEDIA)
    used = F.lit(257) - F.col("packing_params.right_padding_length")
    return packs.groupBy("batch").agg(F.sum(F.size("keys")).alias("rows"), F.sum(used.cast("long")).alias("tokens"), F.sum(E.valid_tokens(F.col("labels")).cast("long")).alias("learned"), F.sum(fault.cast("long")).alias("faults"))


@query("""with o as (select doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''), lambda x: substr(md5(x), 1, 7)) as w from documents),
    e as (select doc_id, list_concat(['0000001'], w, ['0000002'])[: 128] as t from o) select doc_id, cast(len(t) as integer) as tokens, md5(array_to_string(t, ' ')) as ids from e""")
def pretrain_encode(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", E.pretrain(E.token_ids(F.col("text")), 128, 2, 1).alias("t"))
    return rows.select("doc_id", F.size("t").alias("tokens"), _digest("t").alias("ids"))


@query(f"""with {_TOKENS}, l as (select *, {_CUT("len(p)", "len(r)")} as t from k) select id, {_JOIN("p[: greatest(least(32 - t, len(p)), 0)]")} as ids, {_JOIN("r[: t]")} as labels from l where len(p) + len(r) > 0""")
def unsupervised_encode(spark, sf_dir):
    rows = _tokens(spark, sf_dir).where(F.size("p") + F.size("r") > 0)
    ids, labels = E.unsupervised(F.col("p"), F.col("r"), 32)
    return rows.select("id", _digest(ids).alias("ids"), _digest(labels).alias("labels"))


_PAIRED = f"""{_TOKENS}, q as (select id, p, r as c, p as j, greatest(len(r), len(p)) as most from k where len(p) > 0), l as (select *, {_CUT("len(p)", "most")} as t from q),
    e as (select id, p[: greatest(least(32 - t, len(p)), 0)] as p, c[: t] as c, j[: t] as j from l)"""


@query(f"""with {_PAIRED} select id, {_JOIN("list_concat(p, c)")} as chosen_ids, {_JOIN(f"list_concat({_DASH('p')}, c)")} as chosen_labels, {_JOIN("list_concat(p, j)")} as rejected_ids, {_JOIN(f"list_concat({_DASH('p')}, j)")} as rejected_labels from e""")
def pairwise_encode(spark, sf_dir):
    """The reply as chosen answer and the prompt said again as rejected one."""
    rows = _tokens(spark, sf_dir).where(F.size("p") > 0)
    got = E.pairwise(F.col("p"), F.col("r"), F.col("p"), 32)
    return rows.select("id", *[_digest(got[f"{s}_{a}"]).alias(f"{s}_{b}") for s in ("chosen", "rejected") for a, b in (("input_ids", "ids"), ("labels", "labels"))])


@query(f"""with {_PAIRED}, oo as (select *, row_number() over (order by id) - 1 as o from e), b as (select *, o // 4 as batch, count(*) over (partition by o // 4) as n, max(greatest(len(p) + len(c), len(p) + len(j))) over (partition by o // 4) as longest from oo)
    select batch, o % 4 as row, 'chosen' as side, id, cast(longest as integer) as length, cast(len(p) + len(c) as integer) as used, cast(len(c) as integer) as learned from b
    union all select batch, n + o % 4, 'rejected', id, cast(longest as integer), cast(len(p) + len(j) as integer), cast(len(j) as integer) from b""")
def pairwise_collate(spark, sf_dir):
    rows = _tokens(spark, sf_dir).where(F.size("p") > 0)
    got = E.pairwise(F.col("p"), F.col("r"), F.col("p"), 32)
    rows = rows.select("id", *[c.alias(n) for n, c in got.items()])
    rows = rows.withColumns({f"{s}_attention_mask": F.array_repeat(F.lit(1), F.size(f"{s}_input_ids")) for s in ("chosen", "rejected")})
    out = E.collate_pairs(with_ordinal(rows, ["id"]), 4, keep=["id"])
    ones = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    return out.select("batch", "row", "side", "id", F.size("input_ids").alias("length"), ones.alias("used"), E.valid_tokens(F.col("labels")).alias("learned"))


_KTO = f"""{_PAIRS}, n as (select id, coalesce(prompt, '') as p, coalesce(reply, '') as r, id % 3 = 0 as tag, cast(floor((row_number() over (order by id) - 1) / 1000) as bigint) as b from pairs where coalesce(reply, '') <> ''),
    s as (select *, case when row_number() over (partition by b order by id) = 1 then last(r) over (partition by b order by id rows between unbounded preceding and unbounded following) else lag(r) over (partition by b order by id) end as kl from n)"""


def _kto(spark, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).where("coalesce(reply, '') <> ''").select("id", F.col("prompt").alias("instruction"), F.col("reply").alias("output"), (F.col("id") % 3 == 0).alias("kto_tag"))
    return with_ordinal(A.align_alpaca(rows, ["id"]), ["id"])


_HUMAN = lambda x: f"'Human: ' || {x} || '</s>' || chr(10) || 'Assistant:'"


@query(f"""with {_KTO}, t as (select id, tag, {_WORDS7.format(_HUMAN("p"))} as p, {_WORDS7.format("r || '</s>' || chr(10)")} as o, {_WORDS7.format("kl || '</s>' || chr(10)")} as k from s)
    select id, tag as kto_tags, {_JOIN("list_concat(p, o)")} as ids, {_JOIN(f"list_concat({_DASH('p')}, o)")} as labels, {_JOIN("list_concat(p, k)")} as kl_ids, {_JOIN(f"list_concat({_DASH('p')}, k)")} as kl_labels from t""")
def kto_encode(spark, sf_dir):
    out = E.encode(_kto(spark, sf_dir), "kto", 1_000_000, keep=["id"])
    return out.select("id", "kto_tags", _digest("input_ids").alias("ids"), _digest("labels").alias("labels"), _digest("kl_input_ids").alias("kl_ids"), _digest("kl_labels").alias("kl_labels"))


@query(f"with {_KTO} select count(*) filter (where tag) as desirable, count(*) filter (where not tag) as undesirable, count(*) filter (where tag) = 0 or count(*) filter (where not tag) = 0 as one_sided from s")
def preference_counts(spark, sf_dir):
    return E.preference_counts(E.encode(_kto(spark, sf_dir), "kto", 64, keep=["id"]))


@query(f"""with {_KTO}, t as (select id, len({_WORDS7.format(_HUMAN("p"))}) + len({_WORDS7.format("r || '</s>'")}) as n, len({_WORDS7.format(_HUMAN("p"))}) + len({_WORDS7.format("kl || '</s>'")}) as m, (row_number() over (order by id) - 1) // 8 as batch from s)
    select batch, count(*) as rows, cast(max(n) as integer) as length, cast(max(m) as integer) as kl_length, cast(sum(n) as bigint) as used, cast(sum(m) as bigint) as kl_used from t group by batch""")
def kto_collate(spark, sf_dir):
    rows = with_ordinal(E.encode(_kto(spark, sf_dir), "kto", 1_000_000, keep=["id"]), ["id"])
    out = E.collate_kto(rows, 8)
    ones = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))
    return out.groupBy("batch").agg(F.count("*").alias("rows"), F.max(F.size("input_ids")).alias("length"), F.max(F.size("kl_labels")).alias("kl_length"), ones("attention_mask").alias("used"), ones("kl_attention_mask").alias("kl_used"))


@query(f"""with {_TOKENS}, oo as (select *, row_number() over (order by id) - 1 as o from k), b as (select *, o // 8 as batch, max(len(p)) over (partition by o // 8) as longest from oo)
    select id, batch, md5(array_to_string(list_concat(p, list_transform(range(0, cast(ceil(longest / 8.0) * 8 as bigint) - len(p)), lambda x: '0000000')), ' ')) as ids from b""")
def sft_collate(spark, sf_dir):
    rows = E.collate(with_ordinal(_tokens(spark, sf_dir).select("id", "p"), ["id"]), 8, {"p": 0}, multiple=8)
    return rows.select("id", "batch", _digest("p").alias("ids"))


@query(f"""with {_TOKENS}, v as (select *, row_number() over (order by id) - 1 as o from k where len(r) > 0), b as (select *, o // 8 as batch, o % 8 as i, count(*) over (partition by o // 8) as n, r[: 16] as c from v)
    select batch, cast(sum(len(c)) as integer) as tokens, md5(string_agg(array_to_string(c, ' '), ' ' order by o)) as ids, md5(string_agg(array_to_string(case when i = 0 then c else list_concat(['-'], c[2:]) end, ' '), ' ' order by o)) as labels, cast(sum(len(c) * (len(c) - 1) // 2) as bigint) as positions from b where n = 8 group by batch""")
def padding_free(spark, sf_dir):
    rows = with_ordinal(_tokens(spark, sf_dir).where(F.size("r") > 0).select("id", F.col("r").alias("input_ids"), F.col("r").alias("labels"), F.transform("r", lambda x: F.lit(1.0)).alias("loss_weights")), ["id"])
    out = E.padding_free(rows, 8, 16)
    return out.select("batch", F.size("input_ids").alias("tokens"), _digest("input_ids").alias("ids"), _digest("labels").alias("labels"), F.aggregate("position_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("positions"))


@query(f"""with {_PAIRS}, oo as (select id, row_number() over (order by id) - 1 as o from pairs), b as (select id, o // 12 as batch, cast(o % 12 // 4 as integer) as micro, count(*) over (partition by o // 12) as n from oo) select id, batch, micro from b where n = 12""")
def micro_batches(spark, sf_dir):
    return E.micro_batches(with_ordinal(_pairs(spark, sf_dir).select("id"), ["id"]), 4, 3).select("id", "batch", "micro")


_SEGMENTS = """s as (select o_orderkey, list_concat(list_transform(range(0, o_orderkey % 3 + 1), lambda x: 1), list_transform(range(0, o_custkey % 4), lambda x: 2), list_transform(range(0, o_orderkey % 2), lambda x: 0)) as g from orders)"""


def _segments(spark, sf_dir: str) -> DataFrame:
    times = lambda v, n: F.array_repeat(F.lit(v), n.cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(times(1, F.col("o_orderkey") % 3 + 1), times(2, F.col("o_custkey") % 4), times(0, F.col("o_orderkey") % 2)).alias("g"))


@query(f"""with {_SEGMENTS} select o_orderkey, array_to_string(list_transform(range(1, len(g) + 1), lambda i: array_to_string(list_transform(range(1, len(g) + 1), lambda j: case when g[i] = g[j] and g[i] <> 0 and j <= i then '1' else '0' end), '')), '/') as mask,
    array_to_string(list_transform(list_filter(range(0, len(g)), lambda i: g[i + 1] <> 0), lambda i: i::varchar), ',') as kept,
    array_to_string(list_transform(range(1, len(g) + 1), lambda i: (case when g[i] = 0 then 0 else i - list_position(g, g[i]) end)::varchar), ',') as positions from s""")
def causal_masks(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    bits = F.array_join(F.transform(E.causal_blocks(F.col("g")), lambda r: F.array_join(F.transform(r, lambda x: F.when(x, "1").otherwise("0")), "")), "/")
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("o_orderkey", bits.alias("mask"), text(E.unpadded(F.col("g"))).alias("kept"), text(E.positions(F.col("g"))).alias("positions"))


@query(f"""with {_SEGMENTS}, r as (select o_orderkey, list_reverse(g) as q, list_transform(g, lambda x: case when x = 1 then -100 else x end) as y from s)
    select o_orderkey, array_to_string(list_concat(list_filter(q, lambda x: x <> 0), list_filter(q, lambda x: x = 0)), ',') as rotated, array_to_string(list_transform(y, lambda x: case when x = -100 then 9 else x end), ',') as decoded,
      cast(coalesce(list_max(list_filter(range(0, len(y)), lambda i: y[i + 1] <> -100)), -1) as integer) as last_valid, cast(coalesce(list_min(list_filter(range(0, len(y)), lambda i: y[i + 1] <> -100)), -1) as integer) as first_valid from r""")
def label_arrays(spark, sf_dir):
    rows = _segments(spark, sf_dir).select("o_orderkey", F.reverse("g").alias("q"), F.transform("g", lambda x: F.when(x == 1, E.IGNORE).otherwise(x)).alias("y"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("o_orderkey", text(E.pads_last(F.col("q"), 0)).alias("rotated"), text(E.unmasked(F.col("y"), 9)).alias("decoded"), E.last_valid(F.col("y")).cast("int").alias("last_valid"), E.first_valid(F.col("y")).cast("int").alias("first_valid"))


@query(f"""with {_SEGMENTS}, t as (select o_orderkey, list_reverse(g) as q, g as r from s), n as (select *, coalesce(list_max(list_filter(range(1, len(r) + 1), lambda i: r[i] <> 0)), 0) as e from t)
    select o_orderkey, cast(len(list_filter(q, lambda x: x <> 0)) as integer) as query_length, cast(case when e = 0 then 1 else e end as integer) as response_length, cast(least(case when e = 0 then 1 else e + 1 end, len(r)) as integer) as with_end from n""")
def trimmed_generations(spark, sf_dir):
    rows = _segments(spark, sf_dir).select("o_orderkey", F.reverse("g").alias("q"), F.col("g").alias("r"))
    q, r = E.trimmed(F.col("q"), F.col("r"), 0, 5)
    _, e = E.trimmed(F.col("q"), F.col("r"), 0, 0)
    return rows.select("o_orderkey", F.size(q).alias("query_length"), F.size(r).alias("response_length"), F.size(e).alias("with_end"))


# --- scores and losses ------------------------------------------------------------------------------------------
# A vector's 64 numbers stand for the log-probabilities of 64 tokens, -|x|; every eighth label is ignored, and
# the first half belongs to the chosen, the second to the rejected answer. The reference is the reversed vector.

_SUM = lambda a, lo, hi: f"list_sum(list_transform(range({lo}, {hi}), lambda i: case when (i - 1) % 8 <> 0 then {a}[i] else 0.0::double end))"
_LOGPS = f"""v as (select vec_id, label, list_transform(embedding, lambda x: -abs(x::double)) as p, list_transform(list_reverse(embedding), lambda x: -abs(x::double)) as r from embeddings),
    l as (select vec_id, label, {_SUM("p", 1, 33)} as pc, {_SUM("p", 33, 65)} as pr, {_SUM("r", 1, 33)} as rc, {_SUM("r", 33, 65)} as rr from v)"""


def _logps(spark, sf_dir: str) -> DataFrame:
    """(vec_id, label, pc, pr, rc, rr, n): sums over each answer's tokens that count, of policy and
    reference; n is the length of each answer."""
    neg = lambda a: F.transform(a, lambda x: -F.abs(x.cast("double")))
    labels, kinds = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 8 == 0, E.IGNORE).otherwise(i)), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i < 32, 1).otherwise(2))
    p, r = L.split_logps(neg(F.col("embedding")), labels, kinds), L.split_logps(neg(F.reverse("embedding")), labels, kinds)
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", p["chosen"].alias("pc"), p["rejected"].alias("pr"), r["chosen"].alias("rc"), r["rejected"].alias("rr"), p["chosen_length"].alias("n"))


def _cols(*names: str) -> list[F.Column]:
    return [F.col(n) for n in names]


@query(f"""with {_LOGPS} select vec_id, round(ln(1 + exp(-0.1::double * ((pc - pr) - (rc - rr)))), 6) as loss, round(0.1::double * (pc - rc), 6) as chosen_reward, round(0.1::double * (pr - rr), 6) as rejected_reward from l""")
def dpo_loss(spark, sf_dir):
    loss, c, r = L.preference("sigmoid", *_cols("pc", "pr", "rc", "rr"))
    return _logps(spark, sf_dir).select("vec_id", F.round(loss, 6).alias("loss"), F.round(c, 6).alias("chosen_reward"), F.round(r, 6).alias("rejected_reward"))


@query(f"""with {_LOGPS}, b as (select *, ln(1 + exp(-0.1::double * ((pc - pr) - (rc - rr)))) as d, ln(1 + exp(-(0.1::double * (pc - rc)))) + ln(1 + exp(0.1::double * (pr - rr))) as c from l) select vec_id, round((d + 0.5::double * c) / 1.5 - 0.2::double * pc / 28, 6) as loss from b""")
def combined_loss(spark, sf_dir):
    loss, _, _ = L.preference("sigmoid", *_cols("pc", "pr", "rc", "rr"), bco_weight=0.5)
    return _logps(spark, sf_dir).select("vec_id", F.round(L.with_sft(loss, L.mean_logp(F.col("pc"), F.col("n")), 0.2), 6).alias("loss"))


@query(f"""with {_LOGPS}, m as (select vec_id, pc / 28 as a, pr / 28 as b from l) select vec_id, round(-a + 0.1::double * ln(1 + exp(-((a - b) - (ln(1 - exp(a)) - ln(1 - exp(b)))))), 6) as loss, round(0.1::double * a, 6) as chosen_reward from m""")
def orpo_loss(spark, sf_dir):
    a, b = (L.mean_logp(x, F.col("n")) for x in _cols("pc", "pr"))
    loss, c, _ = L.preference("orpo", a, b)
    return _logps(spark, sf_dir).select("vec_id", F.round(loss, 6).alias("loss"), F.round(c, 6).alias("chosen_reward"))


@query(f"""with {_LOGPS} select vec_id, round(ln(1 + exp(-(0.1::double * ((pc / 28 - pr / 28) - 5.0)))), 6) as loss from l""")
def simpo_loss(spark, sf_dir):
    loss, _, _ = L.preference("simpo", L.mean_logp(F.col("pc"), F.col("n")), L.mean_logp(F.col("pr"), F.col("n")))
    return _logps(spark, sf_dir).select("vec_id", F.round(loss, 6).alias("loss"))


@query(f"""with {_LOGPS} select round(avg(case when pc > pr then 1.0::double else 0 end), 9) as accuracy, round(avg(ln(1 + exp(-(pc - pr)))), 6) as loss from l""")
def reward_accuracy(spark, sf_dir):
    return _logps(spark, sf_dir).agg(F.round(F.avg((F.col("pc") > F.col("pr")).cast("int")), 9).alias("accuracy"), F.round(F.avg(L.reward_pair(*_cols("pc", "pr"))), 6).alias("loss"))


@query(f"""with {_LOGPS}, v2 as (select vec_id, p from v) select vec_id, round({_SUM("p", 1, 33)}, 6) as chosen, round({_SUM("p", 33, 65)}, 6) as rejected, round({_SUM("p", 1, 33)} / (28 + 1e-6::double), 6) as chosen_mean from v2""")
def split_logps(spark, sf_dir):
    rows = _logps(spark, sf_dir)
    return rows.select("vec_id", F.round("pc", 6).alias("chosen"), F.round("pr", 6).alias("rejected"), F.round(L.mean_logp(F.col("pc"), F.col("n"), 1e-6), 6).alias("chosen_mean"))


@query(f"""with {_LOGPS}, w as (select *, 0.1::double * (pc - rc) as c, 0.1::double * (pr - rr) as j from l), g as (select label, avg(c) as a1, avg(j) as a2, avg(case when c > j then 1.0::double else 0 end) as a3, avg(c - j) as a4, avg(pc) as a5, avg(pr) as a6 from w group by label)
    select round(avg(a1), 6) as rewards_chosen, round(avg(a2), 6) as rewards_rejected, round(avg(a3), 6) as rewards_accuracies, round(avg(a4), 6) as rewards_margins, round(avg(a5), 6) as logps_chosen, round(avg(a6), 6) as logps_rejected from g""")
def dpo_log(spark, sf_dir):
    """Metrics of each label's rows as one worker's, then over the workers."""
    _, c, r = L.preference("sigmoid", *_cols("pc", "pr", "rc", "rr"))
    metrics = _logps(spark, sf_dir).groupBy("label").agg(*[x.alias(n) for n, x in L.preference_metrics(c, r, *_cols("pc", "pr")).items()])
    out = L.dpo_log(metrics, "label")
    return out.select(*[F.round(n, 6).alias(n) for n in out.columns])


@query(f"""with {_LOGPS}, w as (select label, vec_id % 3 = 0 as tag, 0.1::double * (pc - rc) as reward, pc, 0.5::double * abs(pr - rr) as kl from l), g as (select label, sum(reward) filter (tag) rc, sum(pc) filter (tag) lc, count(*) filter (tag) nc, sum(reward) filter (not tag) rr, sum(pc) filter (not tag) lr, count(*) filter (not tag) nr, avg(kl) kl from w group by label)
    select round(sum(rc) / sum(nc), 6) as rewards_chosen, round(sum(lc) / sum(nc), 6) as logps_chosen, round(sum(rr) / sum(nr), 6) as rewards_rejected, round(sum(lr) / sum(nr), 6) as logps_rejected, round(sum(rc) / sum(nc) - sum(rr) / sum(nr), 6) as rewards_margins, round(sum(kl), 6) as kl from g""")
def kto_log(spark, sf_dir):
    rows = _logps(spark, sf_dir).select("label", (F.col("vec_id") % 3 == 0).alias("tag"), ((F.col("pc") - F.col("rc")) * 0.1).alias("reward"), "pc", (F.abs(F.col("pr") - F.col("rr")) * 0.5).alias("kl"))
    metrics = rows.groupBy("label").agg(*[x.alias(n) for n, x in L.kto_metrics(F.col("tag"), F.col("reward"), F.col("pc"), F.col("kl")).items()]).drop("label")
    out = L.kto_log(metrics)
    return out.select(*[F.round(n, 6).alias(n) for n in out.columns])


_SOFT = lambda a: f"list_transform({a}, lambda x: x - list_max({a}) - ln(list_sum(list_transform({a}, lambda y: exp(y - list_max({a}))))))"


@query(f"""with v as (select vec_id, embedding::double[] as a, list_reverse(embedding)::double[] as b from embeddings), m as (select *, list_max(a) as ma, list_max(b) as mb from v),
    z as (select *, ma + ln(list_sum(list_transform(a, lambda x: exp(x - ma)))) as za, mb + ln(list_sum(list_transform(b, lambda x: exp(x - mb)))) as zb from m),
    k as (select vec_id, za - a[vec_id % 64 + 1] as ce, list_sum(list_transform(range(1, 65), lambda i: exp(b[i] - zb) * ((b[i] - zb) - (a[i] - za)))) as kl, list_sort(a, 'DESC')[: 20] as top from z),
    e as (select *, list_sum(list_transform(top, lambda x: exp(x - top[1]))) as zt from k)
    select vec_id, round(ce * exp(-ce), 6) as dft, round(ce * exp(-ce) + 0.1::double * kl, 6) as asft, round(ce * (ln(zt) - list_sum(list_transform(top, lambda x: (x - top[1]) * exp(x - top[1]))) / zt) / 3, 6) as eaft from e""")
def token_losses(spark, sf_dir):
    """A vector as the logits of 64 tokens, of which the one at vec_id modulo 64 is right."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"), F.reverse(a).alias("b"))
    rows = rows.withColumn("ce", -F.get(L.log_softmax(F.col("a")), (F.col("vec_id") % 64).cast("int")))
    return rows.select("vec_id", F.round(L.dft(F.col("ce")), 6).alias("dft"), F.round(L.asft(F.col("ce"), F.col("a"), F.col("b")), 6).alias("asft"), F.round(L.eaft(F.col("ce"), F.col("a")), 6).alias("eaft"))


@query("""with o as (select o_orderkey, o_orderkey // 100 as interval, cast(round(o_totalprice * 100) as bigint) as v, o_custkey % 7 + 1 as w from orders)
    select o_orderkey, interval, cast(floor(cast(sum(v * w) over b as double) / cast(sum(w) over b as double)) as bigint) as average from o window b as (partition by interval order by o_orderkey rows unbounded preceding)""")
def running_average(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"), (F.col("o_custkey") % 7 + 1).alias("w"))
    return L.running_average(rows, "v", "w", F.floor(F.col("o_orderkey") / 100), "o_orderkey").select("o_orderkey", "interval", F.floor("average").alias("average"))


@query("""with m as (select o_orderkey // 8 as step, o_orderkey, o_totalprice / 1e5 as loss, o_custkey % 50 as valid from orders) select step, round(sum(loss * valid * 2 / (total + 1e-6)), 6) as loss from (select *, sum(valid) over (partition by step) as total from m) group by step""")
def step_loss(spark, sf_dir):
    """Orders as micro batches, eight keys a step."""
    rows = read(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("step"), (F.col("o_totalprice") / 1e5).alias("loss"), (F.col("o_custkey") % 50).alias("valid"))
    total = rows.groupBy("step").agg(F.sum("valid").alias("total"))
    return rows.join(total, "step").groupBy("step").agg(F.round(F.sum(L.step_loss(F.col("loss"), F.col("valid"), F.col("total"), 2)), 6).alias("loss"))


@query(f"""with {_TOKENS} select cast(sum(len(p) + len(r)) as bigint) as tokens, round(sum(len(p) + len(r)) * 3.0 / (120 * 8), 6) as per_second from k""")
def tokens_per_second(spark, sf_dir):
    total = _tokens(spark, sf_dir).agg(F.sum((F.size("p") + F.size("r")).cast("long")).alias("tokens"))
    return total.select("tokens", F.round(L.tokens_per_second(F.col("tokens"), F.lit(3.0), F.lit(120.0), 8), 6).alias("per_second"))


_LETTER = """case when embedding[11] >= greatest(embedding[22], embedding[33], embedding[44]) then 'A' when embedding[22] >= greatest(embedding[33], embedding[44]) then 'B' when embedding[33] >= embedding[44] then 'C' else 'D' end"""


@query(f"""select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as token, {_LETTER} as letter from embeddings""")
def argmax_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return rows.select("vec_id", E.argmax(F.col("embedding")).alias("token"), M.chosen_letter(F.col("embedding"), {"A": 10, "B": 21, "C": 32, "D": 43}).alias("letter"))


@query(f"""with c as (select cast(label as varchar) as category, {_LETTER} = substr('ABCD', cast(vec_id % 4 as integer) + 1, 1) as correct from embeddings) select coalesce(category, 'Average') as category, count(*) as n, round(100.0::double * avg(case when correct then 1.0::double else 0 end), 6) as accuracy from c group by grouping sets ((category), ())""")
def choice_accuracy(spark, sf_dir):
    """A vector as the logits of a question whose answer is the letter at vec_id modulo 4."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"), M.chosen_letter(F.col("embedding"), {"A": 10, "B": 21, "C": 32, "D": 43}).alias("letter"), F.substring(F.lit("ABCD"), (F.col("vec_id") % 4 + 1).cast("int"), F.lit(1)).alias("answer"))
    return M.accuracy_table(rows, "label", F.col("letter") == F.col("answer")).withColumn("accuracy", F.round("accuracy", 6))


# --- the engine -------------------------------------------------------------------------------------------------

_INDEX = """i as (select lang as dataset, row_number() over (partition by lang order by doc_id) - 1 as row, doc_id from documents where lang in ('de', 'fr'))"""


def _index(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return G.index({k: docs.where(F.col("lang") == k) for k in ("de", "fr")}, "doc_id")


@query(f"with {_INDEX} select dataset, row from i")
def engine_index(spark, sf_dir):
    return _index(spark, sf_dir).select("dataset", "row")


@query(f"with {_INDEX}, p as (select dataset, row, row_number() over (order by dataset, row) - 1 as place from i) select place, dataset, row from p where place >= 5 and (place - 5) % 3 = 0")
def engine_slice(spark, sf_dir):
    return G.select(_index(spark, sf_dir), slice(5, None, 3), ["dataset", "row"]).select("place", "dataset", "row")


_PICK = lambda seed, total: f"cast(('0x' || substr(md5('{seed}:' || d), 1, 13)) as bigint) % {total}"


@query(f"""with n as (select count(*) as t from documents), a as (select d as draw, {_PICK(3, "t")} as row from n, range(0, 500) r(d)), o as (select doc_id, row_number() over (order by doc_id) - 1 as row from documents) select draw, doc_id from a join o using (row)""")
def engine_draws(spark, sf_dir):
    """500 draws with replacement from all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    rows = with_ordinal(docs, ["doc_id"], name="row")
    return G.drawn(rows, 500, docs.count(), 3).select("draw", "doc_id")


@query("""with o as (select doc_id, row_number() over (order by md5('9:' || doc_id), doc_id) - 1 as o, count(*) over () as t from documents) select doc_id, cast(o % 4 as integer) as worker, o // 4 as step from o where o // 4 < t // 4""")
def engine_epoch(spark, sf_dir):
    return G.epoch_order(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 2, 4)


@query("""with o as (select doc_id, (row_number() over (order by doc_id) - 1) // 64 as b from documents), s as (select doc_id, row_number() over (order by b, md5('5:' || doc_id), doc_id) - 1 as place from o) select doc_id, place, case when place < 100 then 'validation' else 'train' end as split from s""")
def engine_stream_split(spark, sf_dir):
    rows = G.shuffle_buffered(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", "doc_id", 64, 5)
    held, rest = G.stream_split(rows, 100)
    return held.withColumn("split", F.lit("validation")).unionByName(rest.withColumn("split", F.lit("train")))


@query("""with t as (select doc_id as shot_doc, source, row_number() over (partition by source order by md5('1:' || doc_id || ':' || source)) - 1 as rn, count(*) over (partition by source) as n from documents where doc_id % 2 = 1),
    a as (select d.doc_id, d.source, t.n, cast(('0x' || substr(md5('1:' || d.doc_id), 1, 13)) as bigint) as h, unnest(range(0, least(3, t.n))) as shot from documents d join (select distinct source, n from t) t using (source) where d.doc_id % 2 = 0)
    select a.doc_id, cast(a.shot as integer) as shot, t.shot_doc from a join t on a.source = t.source and t.rn = (a.h + a.shot) % a.n""")
def engine_few_shot(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    train = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("shot_doc"), "source")
    return G.few_shot(docs.where("doc_id % 2 = 0").select("doc_id", "source"), train, "doc_id", "source", 3, 1).select("doc_id", "shot", "shot_doc")


# --- searches, filters, logs ------------------------------------------------------------------------------------

_USABLE = """len(e) = 64 and list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))"""


def _vectors(df: DataFrame, key: str) -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).select(key, F.col("embedding").cast("array<double>").alias("v")).where(usable("v", 64))
    return rows.groupBy(key).agg(F.min("v").alias("v"))


@query(f"""with v as (select id, any_value(embedding)::double[] e from chat_history where id is not null and embedding is not null group by 1), u as (select * from v where {_USABLE}),
    d as (select q.id as query, u.id, round(1 - list_cosine_similarity(q.e, u.e), 6) as distance from u q, u where q.id % 20 = 0), r as (select *, row_number() over (partition by query order by distance, id) as rank from d)
    select query, id, distance, cast(rank as integer) as rank from r where rank <= 5""")
def history_search(spark, sf_dir):
    """The five nearest messages of every message whose id is divisible by 20."""
    rows = _vectors(read(spark, sf_dir, "chat_history"), "id")
    return nearest_in_blocks(rows, rows.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q")), "id", 5, 64)


@query(f"""with v as (select chunk_id, any_value(embedding)::double[] e from chunk_embeddings where chunk_id is not null group by 1), u as (select * from v where {_USABLE}),
    q as (select * from u where try_cast(split_part(chunk_id, ':', len(string_split(chunk_id, ':'))) as bigint) % 20 = 0),
    d as (select q.chunk_id as query, u.chunk_id, round(1 - list_cosine_similarity(q.e, u.e), 6) as distance from q, u), r as (select *, row_number() over (partition by query order by distance, chunk_id) as rank from d)
    select query, chunk_id, distance, cast(rank as integer) as rank from r where rank <= 10""")
def chunk_search(spark, sf_dir):
    """The ten nearest chunks of every chunk whose number is divisible by 20."""
    rows = _vectors(read(spark, sf_dir, "chunk_embeddings"), "chunk_id")
    number = F.substring_index("chunk_id", ":", -1).try_cast("long")
    return nearest_in_blocks(rows, rows.where(number % 20 == 0).select(F.col("chunk_id").alias("query"), F.col("v").alias("q")), "chunk_id", 10, 64)


@query("""with q as (select label as query, min(vec_id) as id from embeddings group by 1), v as (select query, embedding from q join embeddings on vec_id = id),
    d as (select query, e.vec_id, round(list_cosine_distance(e.embedding::double[], v.embedding::double[]), 6) as distance from embeddings e, v)
    select query, vec_id, distance, cast(rank as integer) as rank from (select *, row_number() over (partition by query order by distance, vec_id) as rank from d) where rank <= 5""")
def retrieval_multi_query(spark, sf_dir):
    vecs = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(usable("v", 64))
    heads = vecs.groupBy("label").agg(F.min_by("v", "vec_id").alias("q")).select(F.col("label").alias("query"), "q")
    return nearest_in_blocks(vecs.select("vec_id", "v"), heads, "vec_id", 5, 64)


@query(f"""with {_CHAT}, s as (select min(session_id) as s from chat) select id, role, content from chat, s where session_id = s""")
def session_filter(spark, sf_dir):
    chat = _chat(spark, sf_dir)
    first = chat.agg(F.min("session_id")).first()[0]  # one value
    return S.history(chat, session=first).select("id", "role", "content")


@query("""select id, array_to_string(list_filter([case when coalesce(confidence['rag'], 0) >= 0.65 then 'rag' end, case when coalesce(confidence['kg'], 0) >= 0.65 then 'kg' end], lambda x: x is not null), ',') as entities from (select distinct id, confidence from classifier_output)""")
def entity_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "classifier_output").select("id", F.to_json("confidence").alias("c"), "confidence").dropDuplicates(["id", "c"])
    one = lambda k: F.struct(F.lit(k).alias("text"), X.confidence_of(F.col("confidence"), k).alias("confidence"))
    return P.entities(rows.select("id", F.array(one("rag"), one("kg")).alias("entities"))).select("id", F.array_join("entities", ",").alias("entities"))


@query(f"""with {_DIALOGUES}, {_SOUND} select session_id, block, good as sft, false as rm, good as generate from g""")
def valid_examples(spark, sf_dir):
    rows = A.align_sharegpt(dialogues(spark, sf_dir), ["session_id", "block"], "m", "role", "content")
    return rows.select("session_id", "block", *[A.valid(s).alias(s) for s in ("sft", "rm", "generate")])


@query("""select o_orderkey, o_orderkey % 4 in (0) as allowed from orders""")
def url_guard(spark, sf_dir):
    host = F.element_at(F.array(*map(F.lit, ["https://example.org/", "http://10.0.0.", "file:///etc/", "http://localhost/"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.public_url(F.concat(host, F.col("o_orderkey").cast("string"))).alias("allowed"))


@query("""select event_id, round(event_id / 16384.0::double * 100, 2) as percentage, case when value > 0 then round(user_id / value, 2) else 0 end as throughput, cast(cast(floor(abs(value)) as bigint) // 3600 as varchar) || ':' || lpad(cast(cast(floor(abs(value)) as bigint) // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(abs(value)) as bigint) % 60 as varchar), 2, '0') as elapsed from events""")
def trainer_rows(spark, sf_dir):
    """Events as steps of a run of 16,384, their value as seconds and the user as tokens."""
    rows = read(spark, sf_dir, "events")
    got = RC.progress(F.col("event_id"), F.lit(16384), F.abs("value"), F.col("user_id"))
    return rows.select("event_id", F.round(got["percentage"], 2).alias("percentage"), F.when(F.col("value") > 0, got["throughput"]).otherwise(0.0).alias("throughput"), got["elapsed_time"].alias("elapsed"))


@query("""select event_type as model_name, count(*) as calls, round(avg(abs(value)), 6) as mean_latency, round(sum(case when user_id % 5 > 0 then user_id end) / sum(case when user_id % 5 > 0 then abs(value) end), 6) as tokens_per_second from events group by 1""")
def call_rates(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("model_name"), F.lit("success").alias("status"), F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("generated_tokens"), (-F.col("value")).alias("model_latency"))
    return RC.call_rates(rows).select("model_name", "calls", F.round("mean_latency", 6).alias("mean_latency"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("select event_type, count(*) as calls, round(avg(abs(value)), 6) as mean_latency, round(quantile_cont(abs(value), 0.95), 6) as p95 from events group by 1")
def node_latency(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    calls = rows.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg(F.abs("value")), 6).alias("mean_latency"))
    return calls.join(M.percentile(rows, ["event_type"], F.abs("value"), 0.95, "p95"), "event_type").withColumn("p95", F.round("p95", 6))


@query("select doc_id, source, o as place from (select doc_id, source, row_number() over (order by doc_id) - 1 as o from documents) where o >= 4 and o < 6")
def preview_page(spark, sf_dir):
    """Six rows at most leave any task."""
    page = read(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(6)
    return page.withColumn("place", F.row_number().over(Window.orderBy("doc_id")) - 1).where("place >= 4").withColumn("place", F.col("place").cast("long"))  # six rows


# --- sequential operators by their properties ----------------------------------------------------------------------


@query(f"""with {_TOKENS}, oo as (select id, len({_WORDS7.format("concat_ws(' ', prompt, reply)")}) as n, cast(floor((row_number() over (order by id) - 1) / 1000) as bigint) as batch from pairs) select batch, count(*) as items, cast(sum(n) as bigint) as tokens, cast(0 as bigint) as faults from oo where n between 1 and 256 group by batch""")
def knapsack_pack(spark, sf_dir):
    """Each batch's items and tokens, and its faults: packs over the capacity, and two packs that could
    have been one."""
    rows = with_ordinal(_pairs(spark, sf_dir), ["id"]).select("id", "_ord", E.token_ids(F.concat_ws(" ", "prompt", "reply")).alias("t"))
    packs = E.pack_sft(rows, "id", F.col("t"), F.col("t"), 256)
    by = packs.groupBy("batch", "pack").agg(F.count("*").alias("items"), F.sum("length").alias("tokens"))
    least = F.sort_array(F.collect_list("tokens"))  # the packs of one batch of 1,000 rows
    out = by.groupBy("batch").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum((F.col("tokens") > 256).cast("long")).alias("over"), least.alias("l"))
    return out.select("batch", "items", "tokens", (F.col("over") + F.when((F.size("l") > 1) & (F.get("l", F.lit(0)) + F.get("l", F.lit(1)) <= 256), 1).otherwise(0)).alias("faults"))


@query(f"""with {_TOKENS}, s as (select id % 64 as shard, len(r) as n from k) select shard, count(*) as rows, cast(sum(n) as bigint) as tokens, cast(0 as bigint) as faults from s group by shard""")
def dynamic_batching(spark, sf_dir):
    """Each shard's rows and tokens, and its faults: batches over the budget, and batches whose next row
    would still have fitted."""
    rows = _tokens(spark, sf_dir).select(F.pmod(F.col("id"), F.lit(64)).alias("shard"), "id", F.size("r").alias("length"))
    got = E.dynamic_batches(rows, "shard", "id", "length", 512)
    by = got.groupBy("shard", "batch").agg(F.count("*").alias("n"), F.max("length").alias("top"), F.sum("length").alias("tokens"), F.min_by("length", "id").alias("first"))
    nxt = F.lead("first").over(Window.partitionBy("shard").orderBy("batch"))  # one row a batch
    by = by.withColumn("next", nxt)
    fault = ((F.col("n") > 1) & (F.col("n") * F.col("top") > 512)) | (F.col("next").isNotNull() & (F.greatest("top", "next") * (F.col("n") + 1) <= 512))
    return by.groupBy("shard").agg(F.sum("n").alias("rows"), F.sum("tokens").alias("tokens"), F.sum(fault.cast("long")).alias("faults"))


@query("""with d as (select event_type, cast(ts as date) as day, avg(value) as x from events group by 1, 2), o as (select *, row_number() over (partition by event_type order by day) - 1 as i, count(*) over (partition by event_type) as n from d), w as (select *, 1.8::double * (1 / (1 + exp(-0.05::double * n)) - 0.5) as w from o)
    select a.event_type, cast(a.i as integer) as step, round(sum(case when b.i = 0 then pow(a.w, a.i) * b.x else (1 - a.w) * pow(a.w, a.i - b.i) * b.x end), 6) as value from w a join w b on a.event_type = b.event_type and b.i <= a.i group by 1, 2""")
def ema_smooth(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"))
    series = daily.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("day", "x"))).alias("s"))  # one entry a day
    return series.select("event_type", F.posexplode(M.smoothed(F.transform("s", lambda p: p["x"]))).alias("step", "value")).withColumn("value", F.round("value", 6))


@query("""with n as (select doc_id, coalesce(lower(lang), 'unknown') as source, row_number() over (partition by coalesce(lower(lang), 'unknown') order by doc_id) - 1 as rn from documents),
    u as (select *, (cast(('0x' || substr(md5('42:' || source || ':' || rn), 1, 13)) as bigint)::double + 1) / (pow(16::double, 13) + 1) as u from n)
    select row_number() over (order by -ln(u) / case when source = 'en' then 2.0 else 1.0 end, doc_id) - 1 as place, doc_id, source from u""")
def mix_drawn(spark, sf_dir):
    rows = MX.numbered(read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.lower("lang"), F.lit("unknown")).alias("source")), "source", ["doc_id"])
    drawn = MX.interleave_drawn(rows, {"en": 2.0, "de": 1.0, "fr": 1.0, "es": 1.0}, "source", 42)
    return with_ordinal(drawn, ["pos", "doc_id"], name="place").select("place", "doc_id", "source")

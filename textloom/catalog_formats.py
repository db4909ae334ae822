"""Queries of tool formats, converters, requests, rendering and sizes, with hand-written SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.catalog import _CHAT, _PAIRS, _chat, _pairs, query
from textloom.common import read
from textloom.functions import compute as CO
from textloom.functions import text as X
from textloom.operators import align as A
from textloom.operators import encode as E
from textloom.operators import render as R
from textloom.operators import tools as TL
from textloom.operators.sequence import with_ordinal

# --- tool calls ---------------------------------------------------------------------------------------------


def _sql_text(form: str) -> str:
    """A form with {N} (name), {A} (arguments in JSON), {U} and {T} (their values) as SQL."""
    out = "'" + form.replace("'", "''") + "'"
    for slot, sql in (("{N}", "event_type"), ("{A}", "a"), ("{U}", "user_id"), ("{T}", "event_type")):
        out = out.replace(slot, f"' || {sql} || '")
    return out


#: Each format's text of one call, written by hand.
WRITTEN = {
    "default": "Action: {N}\nAction Input: {A}",
    "gemma4": '<|tool_call>call:{N}{kind:<|"|>{T}<|"|>,user_id:{U}}<tool_call|>',
    "glm4": "{N}\n{A}",
    "llama3": '{"name": "{N}", "parameters": {A}}',
    "lfm2": '<|tool_call_start|>[{N}(user_id={U}, kind="{T}")]<|tool_call_end|>',
    "minimax1": '<tool_calls>\n{"name": "{N}", "arguments": {A}}\n</tool_calls>',
    "minimax2": '<invoke name="{N}">\n<parameter name="user_id">{U}</parameter>\n<parameter name="kind">{T}</parameter>\n</invoke>',
    "mistral": '[{"name": "{N}", "arguments": {A}}]',
    "qwen": '<tool_call>\n{"name": "{N}", "arguments": {A}}\n</tool_call>',
    "qwen3_5": "<tool_call>\n<function={N}>\n<parameter=user_id>\n{U}\n</parameter>\n<parameter=kind>\n{T}\n</parameter>\n</function>\n</tool_call>",
    "glm4_moe": "\n<tool_call>{N}\n<arg_key>user_id</arg_key>\n<arg_value>{U}</arg_value>\n<arg_key>kind</arg_key>\n<arg_value>{T}</arg_value>",
    "seed_oss": "\n<seed:tool_call>\n<function={N}>\n<parameter=user_id>{U}</parameter>\n<parameter=kind>{T}</parameter>\n</function>\n</seed:tool_call>",
    "ling": '<tool_call>\n{"name": "{N}", "arguments": {A}}\n</tool_call>',
}


def _calls(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    args = F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"), F.lit(', "kind": '), A.json_text(F.col("event_type")), F.lit("}"))
    return rows.withColumn("content", F.concat(F.lit('[{"name": '), A.json_text(F.col("event_type")), F.lit(', "arguments": '), args, F.lit("}]")))


def _tool_query(name: str):
    read_name = "null" if name == "glm4_moe" else "event_type"
    read_args = "null" if name == "glm4_moe" else "'{\"kind\": \"' || event_type || '\", \"user_id\": ' || user_id || '}'" if name == "gemma4" else "a"

    def run(spark, sf_dir):
        rows = _calls(spark, sf_dir).select("event_id", TL.writer(name)("content").alias("text"))
        whole = F.concat(F.lit("<minimax:tool_call>\n"), "text", F.lit("\n</minimax:tool_call>")) if name == "minimax2" else F.col("text")
        got = rows.withColumn("calls", TL.extractor(name)(whole))
        return got.select("event_id", "text", F.get("calls", F.lit(0))["name"].alias("name"), F.get("calls", F.lit(0))["arguments"].alias("arguments"))

    run.__name__ = f"tool_{name}"
    return query(f"""with e as (select event_id, event_type, user_id, '{{"user_id": ' || user_id || ', "kind": "' || event_type || '"}}' as a from events)
        select event_id, {_sql_text(WRITTEN[name])} as text, cast({read_name} as varchar) as name, cast({read_args} as varchar) as arguments from e""")(run)


for _name in TL.FORMATS:
    _tool_query(_name)


# --- dialogues ------------------------------------------------------------------------------------------------

TURNS = 8
_DIALOGUES = f"""{_CHAT}, t as (select session_id, lower(trim(coalesce(role, ''))) as role, content, row_number() over (partition by session_id order by created_at nulls first, id) - 1 as o from chat),
    d as (select session_id, cast(o // {TURNS} as bigint) as block, list(struct_pack(role := role, content := content) order by o) as m from t group by 1, 2)"""


def dialogues(spark, sf_dir: str) -> DataFrame:
    """(session_id, block, m): every session in blocks of up to eight messages, so that a session of any
    length makes rows of bounded size."""
    chat = _chat(spark, sf_dir).select("session_id", "created_at", "id", F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role"), "content")
    rows = with_ordinal(chat, ["created_at", "id"], "session_id").withColumn("block", F.floor(F.col("_ord") / TURNS))
    held = rows.groupBy("session_id", "block").agg(F.array_sort(F.collect_list(F.struct("_ord", "role", "content"))).alias("m"))
    return held.withColumn("m", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))


_MAPPED = """case role when 'human' then 'user' when 'user' then 'user' when 'gpt' then 'assistant' when 'assistant' then 'assistant' when 'observation' then 'observation' when 'tool' then 'observation' when 'function_call' then 'function' when 'system' then 'system' end"""
_SOUND = """s as (select session_id, block, case when m[1].role = 'system' then coalesce(m[1].content, '') else '' end as system, case when m[1].role = 'system' then m[2:] else m end as m from d),
    g as (select *, len(m) > 0 and len(m) % 2 = 0 and list_bool_and(list_transform(range(1, len(m) + 1), lambda i: case when i % 2 = 1 then coalesce(m[i].role in ('user', 'human', 'tool', 'observation'), false) else coalesce(m[i].role in ('assistant', 'gpt', 'function_call'), false) end)) as good from s)"""


@query(f"""with {_DIALOGUES}, {_SOUND} select session_id, block, cast(case when good then len(m) - 1 else 0 end as integer) as turns, case when good then m[len(m)].content end as response, system,
    case when good then md5(array_to_string(list_transform(m[1 : len(m) - 1], lambda x: coalesce(x.content, '')), '|')) end as digest from g""")
def align_sharegpt(spark, sf_dir):
    rows = A.align_sharegpt(dialogues(spark, sf_dir), ["session_id", "block"], "m", "role", "content")
    digest = F.md5(F.array_join(F.transform("_prompt", lambda x: F.coalesce(x["content"], F.lit(""))), "|"))
    return rows.select("session_id", "block", F.size("_prompt").alias("turns"), F.get("_response", F.lit(0))["content"].alias("response"), F.coalesce("_system", F.lit("")).alias("system"), F.when(F.size("_prompt") > 0, digest).alias("digest"))


@query(f"""with {_PAIRS}, n as (select id, coalesce(prompt, '') as p, coalesce(reply, '') as r from pairs)
    select id, '[{{"name": "look", "arguments": ' || to_json(p) || '}}]' as call, 'one' || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || p as observation, r as response, cast(3 as integer) as turns,
      case when id % 2 = 0 then 'Be brief.' || chr(10) || 'detailed thinking off' else 'Be brief.' || chr(10) end as system from n""")
def align_openai(spark, sf_dir):
    """Each pair as a dialogue with a call and two tool answers: user, call, tools, answer."""
    rows = _pairs(spark, sf_dir).select("id", F.coalesce("prompt", F.lit("")).alias("p"), F.coalesce("reply", F.lit("")).alias("r"))
    none = F.lit(None).cast("array<struct<function:struct<name:string,arguments:string>>>")
    m = lambda role, content, calls=none: F.struct(F.lit(role).alias("role"), content.alias("content"), calls.alias("tool_calls"))
    call = F.array(F.struct(F.struct(F.lit("look").alias("name"), F.col("p").alias("arguments")).alias("function")))
    msgs = F.array(m("system", F.lit("Be brief.")), m("user", F.col("p")), m("assistant", F.lit(None).cast("string"), call), m("tool", F.lit("one")), m("tool", F.col("p")), m("assistant", F.col("r")))
    out = A.align_openai(rows.select("id", msgs.alias("messages"), F.when(F.col("id") % 2 == 1, "[{}]").alias("tools")), ["id"])
    return out.select("id", F.get("_prompt", F.lit(1))["content"].alias("call"), F.get("_prompt", F.lit(2))["content"].alias("observation"), F.get("_response", F.lit(0))["content"].alias("response"), F.size("_prompt").alias("turns"), F.col("_system").alias("system"))


@query(f"""with {_PAIRS} select id, cast(case when id % 4 = 3 then 3 else 1 end as integer) as turns, coalesce(prompt, '') || case when id % 2 = 0 then chr(10) || 'in short' else '' end as last_prompt,
      case id % 4 when 0 then coalesce(reply, '') when 1 then '' when 2 then coalesce(reply, '') else reply end as first_answer,
      case id % 4 when 0 then '' when 1 then coalesce(reply, '') when 2 then coalesce(prompt, '') end as second_answer from pairs""")
def align_alpaca_all(spark, sf_dir):
    """All branches: a tag (0 true, 1 false), a pair (2), a history and a plain output (3)."""
    rows = _pairs(spark, sf_dir).select("id", F.coalesce("prompt", F.lit("")).alias("p"), "reply")
    kind = F.col("id") % 4
    asked = F.when(kind == 3, F.array(F.array("p", F.coalesce("reply", F.lit("")))))
    rows = rows.select("id", F.col("p").alias("instruction"), F.when(F.col("id") % 2 == 0, "in short").otherwise("").alias("input"), F.col("reply").alias("output"), asked.alias("history"), F.when(kind == 0, True).when(kind == 1, False).alias("kto_tag"), F.when(kind == 2, F.coalesce("reply", F.lit(""))).alias("chosen"), F.when(kind == 2, F.col("p")).alias("rejected"))
    out = A.align_alpaca(rows, ["id"])
    return out.select("id", F.size("_prompt").alias("turns"), F.element_at("_prompt", -1)["content"].alias("last_prompt"), F.get("_response", F.lit(0))["content"].alias("first_answer"), F.get("_response", F.lit(1))["content"].alias("second_answer"))


@query(f"""with {_PAIRS} select id, coalesce(prompt, '') as user_text, case when id % 3 = 0 then '{{"name":"look","arguments":{{}}}}' end as call, coalesce(reply, '') as answer, cast(case when id % 3 = 0 then 3 else 2 end as integer) as messages, round(case when id % 3 = 0 then 2.0::double else 1.0 end, 3) as weight from pairs""")
def align_v1_sharegpt(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    m = lambda tag, x: F.struct(F.lit(tag).alias("from"), x.alias("value"))
    call = F.when(F.col("id") % 3 == 0, '[{"name": "look", "arguments": {}}]').otherwise("no call")
    msgs = F.array(m("human", F.coalesce("prompt", F.lit(""))), m("function_call", call), m("somebody", F.lit("?")), m("gpt", F.coalesce("reply", F.lit(""))))
    out = A.v1_sharegpt(rows.select("id", msgs.alias("conversations")), ["id"])
    text = lambda i: F.element_at("messages", i)["content"][0]["value"]
    called = F.filter("messages", lambda x: x["content"][0]["type"] == "tool_call")
    return out.select("id", text(1).alias("user_text"), F.get(called, F.lit(0))["content"][0]["value"].alias("call"), text(-1).alias("answer"), F.size("messages").alias("messages"), F.round(F.aggregate("messages", F.lit(0.0), lambda s, x: s + x["loss_weight"]), 3).alias("weight"))


@query(f"""with {_PAIRS} select id, coalesce(reply, '') as chosen, coalesce(prompt, '') as rejected, cast(2 as integer) as chosen_messages, cast(2 as integer) as rejected_messages from pairs""")
def align_v1_pair(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("id", F.coalesce("prompt", F.lit("")).alias("p"), F.coalesce("reply", F.lit("")).alias("r"))
    m = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    out = A.v1_pair(rows.select("id", F.array(m("user", F.col("p")), m("assistant", F.col("r")), m("tool", F.lit("no call"))).alias("chosen"), F.array(m("user", F.col("p")), m("assistant", F.col("p"))).alias("rejected")), ["id"])
    text = lambda c: F.element_at(c, -1)["content"][0]["value"]
    return out.select("id", text("chosen_messages").alias("chosen"), text("rejected_messages").alias("rejected"), F.size("chosen_messages").alias("chosen_messages"), F.size("rejected_messages").alias("rejected_messages"))


@query(f"""with {_DIALOGUES}, r as (select session_id, block, case when m[1].role = 'system' then m[1].content end as system, case when m[1].role = 'system' then m[2:] else m end as x, m from d),
    q as (select *, list_bool_and(list_transform(range(1, len(x) + 1), lambda i: case when i % 2 = 1 then coalesce(x[i].role in ('user', 'tool'), false) else coalesce(x[i].role in ('assistant', 'function'), false) end)) as placed from r)
    select session_id, block, system, case when len(x) % 2 = 0 then 'Only supports u/a/u/a/u...' when not placed then 'Invalid role' end as error,
      cast(case when len(x) % 2 = 1 and placed then len(x) else 0 end as integer) as messages, case when len(x) % 2 = 1 and placed then x[len(x)].content end as last from q""")
def chat_requests(spark, sf_dir):
    out = A.requests(dialogues(spark, sf_dir), ["session_id", "block"], "m")
    return out.select("session_id", "block", "system", "error", F.coalesce(F.when(F.col("messages").isNotNull(), F.size("messages")), F.lit(0)).alias("messages"), F.element_at("messages", -1)["content"].alias("last"))


# --- rendering ------------------------------------------------------------------------------------------------


def _typed_pairs(spark, sf_dir: str) -> DataFrame:
    """(id, messages): a system text, the prompt, an answer with reasoning and, in even rows, a call with
    its response and a last answer."""
    rows = _pairs(spark, sf_dir).select("id", F.coalesce("prompt", F.lit("")).alias("p"), F.coalesce("reply", F.lit("")).alias("r"))
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("value"))
    m = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"), F.lit(None).cast("double").alias("loss_weight"))
    short = F.array(m("system", part("text", F.lit("S"))), m("user", part("text", F.col("p"))), m("assistant", part("reasoning", F.lit("why")), part("text", F.col("r"))))
    call = part("tool_call", F.lit('{"name": "look", "arguments": {"n": 1}}'))
    long = F.array(m("system", part("text", F.lit("S"))), m("user", part("text", F.col("p"))), m("assistant", part("reasoning", F.lit("why")), part("text", F.lit("Look.")), call), m("tool", part("text", F.lit("seen"))), m("assistant", part("text", F.col("r"))))
    return rows.select("id", F.when(F.col("id") % 2 == 0, long).otherwise(short).alias("messages"))


def _rendered(rows: DataFrame, segments) -> DataFrame:
    got = rows.select("id", segments.alias("s"))
    return got.select("id", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), F.array_join(F.transform("s", lambda x: x["weight"].cast("int").cast("string")), ",").alias("weights"))


_IM = lambda role, text: f"'<|im_start|>{role}' || chr(10) || {text} || '<|im_end|>' || chr(10)"
_LOOK = """'<tool_call>' || chr(10) || '{"name": "look", "arguments": {"n": 1}}' || chr(10) || '</tool_call>'"""
_THINK = lambda tag, why: f"'<{tag}>' || chr(10) || '{why}' || chr(10) || '</{tag}>' || chr(10) || chr(10)"
_SEEN = "'<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || 'seen' || chr(10) || '</tool_response><|im_end|>' || chr(10)"


@query(f"""with {_PAIRS}, n as (select id, coalesce(prompt, '') as p, coalesce(reply, '') as r from pairs)
    select id, {_IM("system", "'S'")} || {_IM("user", "p")} || case when id % 2 = 0 then {_IM("assistant", _THINK("think", "why") + " || 'Look.' || chr(10) || " + _LOOK)} || {_SEEN} || {_IM("assistant", _THINK("think", "") + " || ltrim(r, chr(10))")}
      else {_IM("assistant", _THINK("think", "why") + " || ltrim(r, chr(10))")} end as text, case when id % 2 = 0 then '0,0,1,0,1' else '0,0,1' end as weights from n""")
def render_qwen3(spark, sf_dir):
    return _rendered(_typed_pairs(spark, sf_dir), R.renderer("qwen3")("messages", F.lit(None).cast("string")))


@query(f"""with {_PAIRS}, n as (select id, coalesce(prompt, '') as p, coalesce(reply, '') as r from pairs)
    select id, {_IM("system", "'S'")} || {_IM("user", "p")} || case when id % 2 = 0 then {_IM("assistant", _THINK("thinking", "why") + " || 'Look.' || chr(10) || " + _LOOK)} || {_SEEN} || {_IM("assistant", "r")}
      else {_IM("assistant", _THINK("thinking", "why") + " || r")} end as text, case when id % 2 = 0 then '0,0,1,0,1' else '0,0,1' end as weights from n""")
def render_qwen3_nothink(spark, sf_dir):
    return _rendered(_typed_pairs(spark, sf_dir), R.renderer("qwen3_nothink")("messages", F.lit(None).cast("string")))


@query(f"""with {_PAIRS}, n as (select id, coalesce(prompt, '') as p, coalesce(reply, '') as r from pairs)
    select id, {_IM("user", "p")} || {_IM("assistant", "r")} || '<|im_start|>assistant' || chr(10) as text, '0,1,0' as weights from n""")
def render_chatml_v1(spark, sf_dir):
    rows = _typed_pairs(spark, sf_dir)
    plain = F.filter("messages", lambda m: (m["role"] == "user") | (m["role"] == "assistant") & F.forall(m["content"], lambda c: c["type"] != "tool_call"))
    rows = rows.withColumn("messages", F.transform(plain, lambda m: m.withField("content", F.filter(m["content"], lambda c: c["type"] == "text"))))
    return _rendered(rows, R.chatml(F.col("messages"), generate=True))


@query(f"""with {_PAIRS}, n as (select id, regexp_replace(regexp_replace(coalesce(reply, ''), '^[\\s]+|[\\s]+$', '', 'g'), '<', '(', 'g') as r from pairs)
    select id, 'reasoning,' || case when r <> '' then 'text,' else '' end || 'tool_call' as kinds, 'why' as reasoning, case when r <> '' then r end as answer, '{{"name": "look"}}' as call from n""")
def parse_generated(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("id", F.regexp_replace(F.regexp_replace(F.coalesce("reply", F.lit("")), r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", ""), "<", "(").alias("r"))
    text = F.concat(F.lit("<think>\nwhy\n</think>\n\n"), "r", F.lit('\n<tool_call>\n{"name": "look"}\n</tool_call>'))
    got = rows.select("id", R.parser("qwen3")(text).alias("c"))
    one = lambda kind: F.get(F.filter("c", lambda x: x["type"] == kind), F.lit(0))["value"]
    return got.select("id", F.array_join(F.transform("c", lambda x: x["type"]), ",").alias("kinds"), one("reasoning").alias("reasoning"), one("text").alias("answer"), one("tool_call").alias("call"))


#: A user's text ({p}), an answer ({r}) and the system text S in several templates, written by hand.
FAMILIES = {
    "llama3": "<s><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n{p}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n|{r}<|eot_id|>",
    "gemma": "<s><start_of_turn>user\nS\n\n{p}<end_of_turn>\n<start_of_turn>model\n|{r}<end_of_turn>\n",
    "llama2": "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\n{p} [/INST]|{r}</s>",
    "deepseek3": "<s>S<｜User｜>{p}<｜Assistant｜>|{r}</s>",
    "glm4": "[gMASK]<sop><|system|>\nS<|user|>\n{p}<|assistant|>|\n{r}",
    "zephyr": "<|system|>\nS</s><|user|>\n{p}</s><|assistant|>\n|{r}</s>",
    "qwen3": "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n{p}<|im_end|>\n<|im_start|>assistant\n|<think>\n\n</think>\n\n{r}<|im_end|>\n",
    "glm4_7": "[gMASK]<sop><|system|>\nS<|user|>\n{p}<|assistant|>|</think>\n{r}",
    "breeze": "<s>S[INST] {p} [/INST] |{r}",
    "openchat": "<s>SGPT4 Correct User: {p}</s>GPT4 Correct Assistant:|{r}</s>",
}


def _family_sql(name: str, form: str) -> str:
    return f"select id, '{name}' as template, '" + form.replace("'", "''").replace("{p}", "' || p || '").replace("{r}", "' || r || '") + "' as text from n"


@query(f"with {_PAIRS}, n as (select id, replace(coalesce(prompt, ''), '|', '/') as p, replace(coalesce(reply, ''), '|', '/') as r from pairs) " + " union all ".join(_family_sql(k, v) for k, v in FAMILIES.items()))
def render_families(spark, sf_dir):
    from textloom.operators.templates import TEMPLATES, one_turn

    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/"))
    rows = _pairs(spark, sf_dir).select("id", F.array(A.message("user", clean("prompt")), A.message("assistant", clean("reply"))).alias("m"))
    each = [F.struct(F.lit(n).alias("template"), F.concat_ws("|", *one_turn(TEMPLATES[n], F.col("m"), F.lit("S"))).alias("text")) for n in FAMILIES]
    return rows.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.template", "x.text")


_WORDS7 = "list_transform(list_filter(regexp_split_to_array({}, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''), lambda x: substr(md5(x), 1, 7))"


def hexed(ids) -> F.Column:
    """Ids as their seven hexadecimal digits, ignored labels as a dash."""
    return F.array_join(F.transform(ids, lambda x: F.when(x == E.IGNORE, "-").otherwise(F.lower(F.lpad(F.hex(x), 7, "0")))), " ")


@query(f"""with {_PAIRS}, n as (select id, '<|im_start|>user' || chr(10) || coalesce(prompt, '') || '<|im_end|>' || chr(10) as a, '<|im_start|>assistant' || chr(10) || coalesce(reply, '') || '<|im_end|>' || chr(10) as b from pairs),
    k as (select id, {_WORDS7.format("a")} as a, {_WORDS7.format("b")} as b from n)
    select id, cast(len(a) + len(b) + len(a) + len(a) as integer) as tokens, md5(array_to_string(list_concat(list_transform(a, lambda x: '-'), b, list_transform(a, lambda x: '-'), list_transform(a, lambda x: '-')), ' ')) as labels,
      cast(len(a) + len(b) as integer) as chosen, cast(2 * len(a) as integer) as rejected from k""")
def pair_samples(spark, sf_dir):
    """Pairs in one sequence with token types: the chosen answer counts, the rejected one is a prompt."""
    rows = _pairs(spark, sf_dir).select("id", F.coalesce("prompt", F.lit("")).alias("p"), F.coalesce("reply", F.lit("")).alias("r"))
    m = lambda role, x: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), x.alias("value"))).alias("content"), F.lit(None).cast("double").alias("loss_weight"))
    rows = rows.select("id", R.chatml(F.array(m("user", F.col("p")), m("assistant", F.col("r")))).alias("c"), R.chatml(F.array(m("user", F.col("p")), m("user", F.col("p")))).alias("r"))
    got = rows.select("id", *[c.alias(n) for n, c in R.pair_input(F.col("c"), F.col("r"), E.token_ids).items()])
    of = lambda k: F.size(F.filter("token_type_ids", lambda x: x == k))
    return got.select("id", F.size("input_ids").alias("tokens"), F.md5(hexed(F.col("labels"))).alias("labels"), of(1).alias("chosen"), of(2).alias("rejected"))


# --- sizes, frames, media ----------------------------------------------------------------------------------


@query("""with p as (select p_partkey, cast(p_size * 97 as bigint) as w, cast(floor(p_retailprice) as bigint) as h from part), a as (select *, w * h > 589824 as big from p),
    b as (select p_partkey, case when big then cast(floor(w * sqrt(589824.0::double / (w * h))) as bigint) else w end as w, case when big then cast(floor(h * sqrt(589824.0::double / (w * h))) as bigint) else h end as h from a),
    c as (select p_partkey, case when w * h < 102400 then cast(floor(w * sqrt(102400.0::double / (w * h))) as bigint) else w end as width, case when w * h < 102400 then cast(floor(h * sqrt(102400.0::double / (w * h))) as bigint) else h end as height from b)
    select p_partkey, width, height from c""")
def image_sizes(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).cast("long").alias("w"), F.floor("p_retailprice").alias("h"))
    w, h = CO.image_size(F.col("w"), F.col("h"), 768 * 768, 320 * 320)
    return rows.select("p_partkey", w.alias("width"), h.alias("height"))


@query("""with v as (select p_partkey, p_size * 25 as total, least(p_size * 25, 16, greatest(1, p_size * 2)) as n from part)
    select p_partkey, cast(n as integer) as frames, cast(0 as integer) as first, cast(case when n = 1 then 0 else total - 1 end as integer) as last from v""")
def video_frames(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 25).alias("total"), F.col("p_size").cast("double").alias("seconds"))
    rows = rows.select("p_partkey", CO.video_frames(F.col("total"), F.col("seconds"), 2.0, 16).alias("f"))
    return rows.select("p_partkey", F.size("f").alias("frames"), F.element_at("f", 1).alias("first"), F.element_at("f", -1).alias("last"))


@query("""select p_partkey, cast(3 * (p_size * 16::hugeint * (6 * 1024 * 4096 + 4 * 1024 * 1024 + 2 * (2 * 1024 * 1024 * 4 // 16)) + 64::hugeint * 1024 * p_size * p_size) + 6 * p_size::hugeint * 1024 * 32000 as bigint) as flops from part""")
def model_flops(spark, sf_dir):
    shape = {"hidden": 1024, "inner": 4096, "layers": 16, "heads": 16, "kv_heads": 4, "vocab": 32000}
    c = {k: F.lit(v).cast("long") for k, v in shape.items()} | {"tied": F.lit(False)}
    return read(spark, sf_dir, "part").select("p_partkey", CO.model_flops(c, 1, F.col("p_size").cast("long")).alias("flops"))


@query(f"""with {_PAIRS} select id, coalesce(prompt, '') || '<image>' as text, id % 3 <> 0 as fits from pairs""")
def media_marks(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("id", F.concat(F.coalesce("prompt", F.lit("")), F.lit("<image>")).alias("text"))
    items = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    msgs = F.array(A.message("user", F.col("text")))
    return rows.select("id", "text", CO.media_match(msgs, {"images": items}).alias("fits"))


@query("""select o_orderkey, trim(split_part('a, b ,c' || o_orderkey, ',', 3)) as last, 'Question: ' || o_orderpriority as wrapped, strftime(o_orderdate, '%d %b %Y') as day from orders""")
def text_forms(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    parts = X.listed(F.concat(F.lit("a, b ,c"), F.col("o_orderkey").cast("string")))
    return rows.select("o_orderkey", F.get(parts, F.lit(2)).alias("last"), X.fill_slot(F.lit("Question: {{content}}"), "content", F.col("o_orderpriority")).alias("wrapped"), X.day(F.col("o_orderdate")).alias("day"))

"""Instruction and dialogue formats in one schema.

Aligned: ``_prompt`` and ``_response`` are arrays of struct(role, content), ``_system`` and
``_tools`` strings. A broken example has an empty prompt and response.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import join_prompt

MESSAGE = "struct<role:string,content:string>"
NONE = f"array<{MESSAGE}>"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _empty() -> Column:
    return F.array().cast(NONE)


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def align_alpaca(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """instruction, input, output, history, system, tools, kto_tag, chosen, rejected; all optional
    but instruction. The tag comes before a pair, a pair before a plain output."""
    col = lambda n: F.col(n) if _has(df, n) else F.lit(None)
    text = lambda n: F.coalesce(col(n).cast("string"), F.lit(""))
    history = F.coalesce(F.col("history"), F.array().cast("array<array<string>>")) if _has(df, "history") else F.array().cast("array<array<string>>")
    past = F.flatten(F.transform(history, lambda p: F.array(message("user", p[0]), message("assistant", p[1]))))
    prompt = F.concat(past.cast(NONE), F.array(message("user", join_prompt(text("instruction"), text("input")))))
    answer = message("assistant", text("output"))
    blank = message("assistant", F.lit(""))
    one = F.when(col("output").cast("string").isNotNull(), F.array(answer).cast(NONE)).otherwise(_empty())
    response = one
    if _has(df, "chosen") and _has(df, "rejected"):
        pair = F.array(message("assistant", text("chosen")), message("assistant", text("rejected")))
        response = F.when(col("chosen").isNotNull() & col("rejected").isNotNull(), pair).otherwise(response)
    if _has(df, "kto_tag"):
        tagged = F.when(F.col("kto_tag"), F.array(answer, blank)).otherwise(F.array(blank, answer))
        response = F.when(F.col("kto_tag").isNotNull(), tagged).otherwise(response)
    return df.select(*keep, prompt.alias("_prompt"), response.alias("_response"), text("system").alias("_system"), text("tools").alias("_tools"))


#: Tag of a conversation -> role.
TAGS = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "observation": "observation", "tool": "observation", "function_call": "function", "system": "system"}


def turns(conversation: Column, role: str = "from", content: str = "value") -> Column:
    tag = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return F.transform(F.coalesce(conversation, F.array()), lambda m: message(F.try_element_at(tag, m[role]), m[content]))


def is_sound(msgs: Column, ranking: bool = False) -> Column:
    """User and observation at even places, assistant and function at odd ones, and an even number
    of turns (odd for ranking)."""
    placed = F.transform(msgs, lambda m, i: F.coalesce(F.when(i % 2 == 0, m["role"].isin("user", "observation")).otherwise(m["role"].isin("assistant", "function")), F.lit(False)))
    return F.forall(placed, lambda x: x) & (F.size(msgs) % 2 == (1 if ranking else 0)) & (F.size(msgs) > 0)


def split_system(conversation: Column) -> tuple[Column, Column]:
    """(leading system text or "", the other messages)."""
    leads = (F.size(conversation) > 0) & (F.coalesce(F.get(conversation, F.lit(0))["role"], F.lit("")) == "system")
    return F.when(leads, F.get(conversation, F.lit(0))["content"]).otherwise(""), F.when(leads, F.slice(conversation, 2, F.greatest(F.size(conversation) - 1, F.lit(0)))).otherwise(conversation)


def _aligned(df: DataFrame, keep: list[str], msgs: Column, system: Column, role: str, content: str, ranking: bool) -> DataFrame:
    """Sound dialogues as prompt and response; the rest with both empty. A tag comes before a pair,
    a pair (in ranking datasets) before the last turn as response."""
    held = df.select(*keep, *[c for c in ("kto_tag", "chosen", "rejected") if _has(df, c) and c not in keep], msgs.alias("_m"), system.alias("_system"), (F.coalesce(F.col("tools"), F.lit("")) if _has(df, "tools") else F.lit("")).alias("_tools"))
    last = F.slice("_m", F.greatest(F.size("_m"), F.lit(1)), F.lit(1))
    init = F.slice("_m", F.lit(1), F.greatest(F.size("_m") - 1, F.lit(0)))
    good = is_sound(F.col("_m"), ranking)
    prompt, response = init, last
    if ranking and _has(df, "chosen") and _has(df, "rejected"):
        tag = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
        side = lambda n: message(F.try_element_at(tag, F.col(n)[role]), F.col(n)[content])
        answers = lambda n: F.coalesce(F.try_element_at(tag, F.col(n)[role]).isin("assistant", "function"), F.lit(False))
        pair = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
        # A pair of which one side is no answer has no place in either result.
        good = good & (~pair | (answers("chosen") & answers("rejected")))
        prompt = F.when(pair, F.col("_m")).otherwise(prompt)
        response = F.when(pair, F.array(side("chosen"), side("rejected"))).otherwise(response)
    if _has(df, "kto_tag"):
        blank = F.array(message("assistant", F.lit("")))
        prompt = F.when(F.col("kto_tag").isNotNull(), init).otherwise(prompt)
        response = F.when(F.col("kto_tag"), F.concat(last, blank)).when(~F.col("kto_tag"), F.concat(blank, last)).otherwise(response)
    return held.select(*keep, F.when(good, prompt).otherwise(_empty()).alias("_prompt"), F.when(good, response).otherwise(_empty()).alias("_response"), "_system", "_tools")


def align_sharegpt(df: DataFrame, keep: list[str] = (), column: str = "conversations", role: str = "from", content: str = "value", ranking: bool = False) -> DataFrame:
    """Dialogues with tags; a leading system turn is the system prompt, else the column ``system``."""
    lead, msgs = split_system(turns(F.col(column), role, content))
    system = F.coalesce(F.nullif(lead, F.lit("")), F.col("system"), F.lit("")) if _has(df, "system") else lead
    return _aligned(df, keep, msgs, system, role, content, ranking)


def json_text(x: Column) -> Column:
    """A text as a JSON string."""
    j = F.to_json(F.array(x))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def json_calls(calls: Column) -> Column:
    """array<struct<function: struct<name, arguments>>> as a JSON list of those functions."""
    one = lambda c: F.concat(F.lit('{"name": '), json_text(c["function"]["name"]), F.lit(', "arguments": '), json_text(c["function"]["arguments"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(calls, one), ", "), F.lit("]"))


def fold_tools(msgs: Column, calls: bool = False) -> Column:
    """Consecutive tool messages as one observation; those after the last other message are lost.
    ``calls``: answers with tool_calls become function messages with those calls in JSON."""
    state = "struct<out:array<struct<role:string,content:string>>,wait:array<string>>"
    glue = "\n</tool_response>\n<tool_response>\n"

    def own(m: Column) -> Column:
        plain = message(m["role"], m["content"])
        if not calls:
            return plain
        called = m["role"].isin("assistant", "gpt", "function_call", "function") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)
        return F.when(called, message("function_call", json_calls(m["tool_calls"]))).otherwise(plain)

    def step(s: Column, m: Column) -> Column:
        flushed = F.when(F.size(s["wait"]) > 0, F.concat(s["out"], F.array(message("observation", F.array_join(s["wait"], glue))))).otherwise(s["out"])
        return F.when(m["role"].isin("tool", "observation"), F.struct(s["out"].alias("out"), F.concat(s["wait"], F.array(m["content"])).alias("wait"))).otherwise(
            F.struct(F.concat(flushed, F.array(own(m))).alias("out"), F.array().cast("array<string>").alias("wait"))
        ).cast(state)

    start = F.struct(F.array().cast(NONE).alias("out"), F.array().cast("array<string>").alias("wait")).cast(state)
    return F.aggregate(F.coalesce(msgs, F.array()), start, step)["out"]


def align_openai(df: DataFrame, keep: list[str] = (), column: str = "messages", ranking: bool = False) -> DataFrame:
    """Messages of role, content and optional tool_calls, with tool messages merged, as dialogues.

    Without tools the system prompt ends in "detailed thinking off" unless it says which itself;
    with tools a line end closes it.
    """
    fields = df.schema[column].dataType.elementType.fieldNames()
    lead, msgs = split_system(turns(fold_tools(F.col(column), "tool_calls" in fields), "role", "content"))
    given = F.coalesce(F.nullif(lead, F.lit("")), F.col("system"), F.lit("")) if _has(df, "system") else F.coalesce(lead, F.lit(""))
    tools = F.coalesce(F.col("tools"), F.lit("")) if _has(df, "tools") else F.lit("")
    # --- fixed values: the switch of a long or short way of thinking ---
    off, says = "detailed thinking off", given.contains("detailed thinking on") | given.contains("detailed thinking off")
    system = F.when(tools != "", F.when(given == "", "").otherwise(F.concat(given, F.lit("\n")))).otherwise(F.when(given == "", off).when(says, given).otherwise(F.concat(given, F.lit(f"\n{off}"))))
    return _aligned(df, keep, msgs, system, "role", "content", ranking)


def v1_alpaca(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Messages of typed content with loss weights 0, 0 and 1; instruction and input are joined
    without a line end, and parts without text give no message."""
    text = lambda n: F.coalesce(F.col(n), F.lit("")) if _has(df, n) else F.lit("")
    typed = lambda role, value, weight: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), value.alias("value"))).alias("content"), F.lit(weight).alias("loss_weight"))
    user = F.concat(text("instruction"), text("input"))
    parts = [F.when(text("system") != "", typed("system", text("system"), 0.0)), F.when(user != "", typed("user", user, 0.0)), F.when(text("output") != "", typed("assistant", text("output"), 1.0))]
    return df.select(*keep, F.array_compact(F.array(*parts)).alias("messages"))


CONVERTERS: dict[str, Callable[..., DataFrame]] = {"alpaca": align_alpaca, "sharegpt": align_sharegpt, "openai": align_openai, "v1_alpaca": v1_alpaca}


def register_converter(name: str, fn: Callable[..., DataFrame]) -> None:
    if name in CONVERTERS:
        raise ValueError(f"{name} is registered")
    CONVERTERS[name] = fn


#: Valid examples by stage: of an odd number of prompt turns, with so many responses.
def valid(stage: str) -> Column:
    odd = F.size("_prompt") % 2 == 1
    return {"sft": odd & (F.size("_response") == 1), "rm": odd & (F.size("_response") >= 2), "kto": odd & (F.size("_response") >= 2), "generate": odd}[stage]


TYPED = "array<struct<role:string,content:array<struct<type:string,value:string>>,loss_weight:double>>"


def _json_items(text: Column) -> Column:
    """The elements of a JSON list as texts, or the one object that it is; NULL for other text."""
    t = F.trim(text)
    parsed = F.when(F.try_parse_json(t).isNotNull(), t)
    items = F.from_json(F.when(parsed.startswith("["), parsed).otherwise(F.concat(F.lit("["), parsed, F.lit("]"))), "array<string>")
    return F.when(parsed.isNotNull(), items)


def _typed(role: Column, kind: str, values: Column, weight: Column) -> Column:
    content = F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    return F.struct(role.alias("role"), content.alias("content"), weight.alias("loss_weight"))


def _typed_dialogue(msgs: Column, calls: str) -> Column:
    """Typed messages; those of the role ``calls`` hold calls in JSON and are dropped where it is bad."""
    weight = lambda m: F.when(m["role"].isin("assistant", "function"), 1.0).otherwise(0.0)
    role = lambda m: F.when(m["role"] == "function", "assistant").when(m["role"] == "observation", "tool").otherwise(m["role"])
    one = lambda m: F.when(m["role"] == calls, F.when(_json_items(m["content"]).isNotNull(), _typed(role(m), "tool_call", _json_items(m["content"]), weight(m)))).otherwise(_typed(role(m), "text", F.array(m["content"]), weight(m)))
    return F.array_compact(F.transform(F.coalesce(msgs, F.array().cast(NONE)), one)).cast(TYPED)


def sound_json(text: Column) -> Column:
    """The text where it is JSON; else NULL."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def v1_sharegpt(df: DataFrame, keep: list[str] = (), column: str = "conversations") -> DataFrame:
    """Typed messages of a dialogue; unknown tags and calls in bad JSON are skipped, nothing else is
    checked. Answers and calls have weight 1. Tools in bad JSON are NULL."""
    tools = sound_json(F.col("tools")) if _has(df, "tools") else F.lit(None).cast("string")
    msgs = F.filter(turns(F.col(column)), lambda m: m["role"].isNotNull())
    return df.select(*keep, _typed_dialogue(msgs, "function").alias("messages"), tools.alias("tools"))


def v1_pair(df: DataFrame, keep: list[str] = (), chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """chosen_messages and rejected_messages, typed; the role ``tool`` holds calls."""
    tools = sound_json(F.col("tools")) if _has(df, "tools") else F.lit(None).cast("string")
    side = lambda n: _typed_dialogue(F.transform(F.coalesce(F.col(n), F.array().cast(NONE)), lambda m: message(m["role"], m["content"])), "tool")
    return df.select(*keep, side(chosen).alias("chosen_messages"), side(rejected).alias("rejected_messages"), tools.alias("tools"))


def is_pair(df: DataFrame) -> bool:
    """Whether a dataset has the columns of pairs."""
    return {"chosen_messages", "rejected_messages"} <= set(df.columns)


CONVERTERS["v1_sharegpt"], CONVERTERS["v1_pair"] = v1_sharegpt, v1_pair

# --- fixed values: marks of media in a text ---------------------------------------------------------------
MEDIA = {"image_url": "<image>", "video_url": "<video>", "audio_url": "<audio>"}
REQUEST_ROLES = {"user": "user", "assistant": "assistant", "system": "system", "function": "function", "tool": "observation"}


def requests(df: DataFrame, keep: list[str] = (), column: str = "messages") -> DataFrame:
    """(system, messages, error) of chat requests: array<struct<role, content, parts:
    array<struct<type, text, url>>, tool_calls>>, of which parts and tool_calls may be missing.

    A leading system message is taken out (its first part's text, where it has parts). Parts become
    one text with a mark for each medium. ``error``: "Invalid length" (no message), "Only supports
    u/a/u/a/u..." (an even number), "Invalid role", "Invalid input type"; then messages is NULL.
    """
    fields = df.schema[column].dataType.elementType.fieldNames()
    raw = F.coalesce(F.col(column), F.array())
    has = lambda m, n: F.coalesce(F.size(m[n]), F.lit(0)) > 0
    lead = F.get(raw, F.lit(0))
    led = F.coalesce(lead["role"] == "system", F.lit(False))
    text = F.when(has(lead, "parts"), F.get(lead["parts"], F.lit(0))["text"]).otherwise(lead["content"]) if "parts" in fields else lead["content"]
    rest = F.when(led, F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0)))).otherwise(raw)
    marks = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in REQUEST_ROLES.items() for x in kv])

    def one(m: Column) -> Column:
        content = m["content"]
        if "parts" in fields:
            flat = F.array_join(F.transform(m["parts"], lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.try_element_at(marks, p["type"]))), "")
            content = F.when(has(m, "parts"), flat).otherwise(content)
        plain = message(F.try_element_at(names, m["role"]), content)
        if "tool_calls" not in fields:
            return plain
        return F.when((m["role"] == "assistant") & has(m, "tool_calls"), message("function", json_calls(m["tool_calls"]))).otherwise(plain)

    placed = F.forall(F.transform(F.col("_r"), lambda m, i: F.coalesce(F.when(i % 2 == 0, m["role"].isin("user", "tool")).otherwise(m["role"].isin("assistant", "function")), F.lit(False))), lambda x: x)
    fine = F.forall(F.col("_r"), lambda m: F.forall(F.coalesce(m["parts"], F.array().cast("array<struct<type:string,text:string,url:string>>")), lambda p: F.coalesce((p["type"] == "text") | F.try_element_at(marks, p["type"]).isNotNull(), F.lit(False)))) if "parts" in fields else F.lit(True)
    error = F.when(F.size(raw) == 0, "Invalid length").when(F.size("_r") % 2 == 0, "Only supports u/a/u/a/u...").when(~placed, "Invalid role").when(~fine, "Invalid input type")
    held = df.select(*keep, raw.alias(column), F.when(led, text).alias("system"), rest.alias("_r")).withColumn("error", error)
    return held.select(*keep, "system", F.when(F.col("error").isNull(), F.transform("_r", one)).alias("messages"), "error")

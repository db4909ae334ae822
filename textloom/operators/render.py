"""Typed messages as text with loss weights, and generated text as typed messages.

A message is struct(role, content: array<struct(type, value)>, loss_weight); the types are text,
reasoning and tool_call (a JSON object with name and arguments). Rendering gives segments,
array<struct(text, weight)>, which any tokenizer turns into ids, labels and weights.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.encode import IGNORE
from textloom.operators.tools import PROMPTS

SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("weight", T.DoubleType())]))
MESSAGE = "struct<role:string,content:array<struct<type:string,value:string>>>"
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"


def chatml(messages: Column, generate: bool = False) -> Column:
    """Segments in ChatML; a message without a weight counts where it is an answer. Only text can be
    rendered: a message with other content gives NULL for the whole."""
    plain = F.forall(messages, lambda m: F.forall(m["content"], lambda c: c["type"] == "text"))
    text = lambda m: F.concat(F.lit(_OPEN), m["role"], F.lit("\n"), F.array_join(F.transform(m["content"], lambda c: F.coalesce(c["value"], F.lit(""))), ""), F.lit(_CLOSE))
    weight = lambda m: F.coalesce(m["loss_weight"], F.when(m["role"] == "assistant", 1.0).otherwise(0.0))
    out = F.transform(messages, lambda m: F.struct(text(m).alias("text"), weight(m).alias("weight")))
    if generate:
        out = F.concat(out, F.array(F.struct(F.lit(f"{_OPEN}assistant\n").alias("text"), F.lit(0.0).alias("weight"))))
    return F.when(plain, out)


def _text(message: dict) -> str:
    if any(c["type"] != "text" for c in message["content"]):
        raise ValueError("content other than text")
    return "".join(c["value"] or "" for c in message["content"])


def last_query(messages: list[dict]) -> int:
    """The place of the last user message of plain text that is no wrapped tool response."""
    for i in range(len(messages) - 1, -1, -1):
        m = messages[i]
        if m["role"] == "user" and all(c["type"] == "text" for c in m["content"]):
            text = _text(m)
            if not (text.startswith("<tool_response>") and text.endswith("</tool_response>")):
                return i
    return len(messages) - 1


def _call(value: str) -> str:
    call = json.loads(value)
    arguments = call.get("arguments")
    given = arguments if isinstance(arguments, str) else json.dumps(arguments, ensure_ascii=False)
    return f'<tool_call>\n{{"name": "{call["name"]}", "arguments": {given}}}\n</tool_call>'


def split_content(message: dict) -> tuple[str, str, list[dict]]:
    """(text, reasoning, calls) of an answer; other types are refused."""
    of = {"text": [], "reasoning": [], "tool_call": []}
    for c in message["content"]:
        if c["type"] not in of:
            raise ValueError(f"unknown content type {c['type']}")
        of[c["type"]].append(c["value"] or "")
    return "".join(of["text"]), "".join(of["reasoning"]), [json.loads(v) for v in of["tool_call"]]


def _thinking_answer(m: dict, show: bool) -> str:
    text, reasoning, _ = split_content(m)
    body = text
    if show or reasoning and show is None:
        body = "<think>\n" + reasoning.strip("\n") + "\n</think>\n\n" + text.lstrip("\n")
    calls = [_call(c["value"]) for c in m["content"] if c["type"] == "tool_call"]
    return body + ("\n" if calls and text else "") + "\n".join(calls)


def _plain_answer(m: dict) -> str:
    out, before = "", None
    for c in m["content"]:
        if c["type"] == "text":
            out += c["value"] or ""
        elif c["type"] == "reasoning":
            out += f"<thinking>\n{c['value']}\n</thinking>\n\n"
        elif c["type"] == "tool_call":
            out += ("\n" if before in ("text", "tool_call") else "") + _call(c["value"])
        else:
            raise ValueError(f"unknown content type {c['type']}")
        before = c["type"]
    return out


def qwen3(messages: list[dict], tools: str | None = None, generate: bool = False, think: bool = False, thinking: bool = True) -> list[tuple[str, float]]:
    """Segments in the Qwen3 form. ``thinking``: reasoning is shown as thoughts, of the answers after
    the last query only (the last answer always has them, empty or not); without it, reasoning is
    shown in plain tags and ``think`` is refused. ``generate`` opens an answer, with an empty thought
    unless ``think``."""
    if not messages:
        return []
    weight = lambda m, default: default if m.get("loss_weight") is None else m["loss_weight"]
    out: list[tuple[str, float]] = []
    first = messages[0]
    led = first["role"] == "system"
    if tools:
        listed = json.loads(tools)
        listed = listed if isinstance(listed, list) else [listed]
        head = _text(first) + "\n\n" if led else ""
        body = PROMPTS["qwen"].lstrip("\n").replace("{tools}", "".join("\n" + json.dumps(t, ensure_ascii=False) for t in listed))
        out.append((f"{_OPEN}system\n{head}{body}{_CLOSE}", weight(first, 0.0) if led else 0.0))
    elif led:
        out.append((f"{_OPEN}system\n{_text(first)}{_CLOSE}", weight(first, 0.0)))
    query, end = last_query(messages), len(messages) - 1
    for i, m in enumerate(messages):
        role = m["role"]
        if role == "assistant":
            if thinking:
                body = _thinking_answer(m, True if i > query and i == end else None if i > query else False)
            else:
                body = _plain_answer(m)
            out.append((f"{_OPEN}assistant\n{body}{_CLOSE}", weight(m, 1.0)))
        elif role == "tool":
            opened = _OPEN + "user" if i == 0 or messages[i - 1]["role"] != "tool" else ""
            closed = _CLOSE if i == end or messages[i + 1]["role"] != "tool" else ""
            out.append((f"{opened}\n<tool_response>\n{_text(m)}\n</tool_response>{closed}", weight(m, 0.0)))
        elif role == "user" or role == "system" and i:
            out.append((f"{_OPEN}{role}\n{_text(m)}{_CLOSE}", weight(m, 0.0)))
    if generate:
        if think and not thinking:
            raise ValueError("this form does not think")
        out.append((f"{_OPEN}assistant\n" + ("<think>\n\n</think>\n\n" if thinking and not think else ""), 0.0))
    return out


def parse(text: str, thought: str = "think") -> list[dict]:
    """Generated text as typed content, in order; a call that is no JSON is refused."""
    out: list[dict] = []

    def plain(s: str) -> None:
        if s.strip():
            out.append({"type": "text", "value": s.strip()})

    at = 0
    for m in re.finditer(rf"<({thought}|tool_call)>\s*(.*?)\s*</\1>\s*", text, re.S):
        plain(text[at : m.start()])
        kind, value = m.group(1), m.group(2).strip()
        if kind == "tool_call":
            json.loads(value)
        out.append({"type": "tool_call" if kind == "tool_call" else "reasoning", "value": value})
        at = m.end()
    plain(text[at:])
    return out


#: Name -> (renderer of Python messages, the tag of thoughts in generated text).
RENDERERS = {
    "qwen3": (lambda ms, tools, **kw: qwen3(ms, tools, thinking=True, **kw), "think"),
    "qwen3_nothink": (lambda ms, tools, **kw: qwen3(ms, tools, thinking=False, **kw), "thinking"),
}


def renderer(name: str, **options):
    """A pandas UDF of (messages, tools) to segments; NULL where a message cannot be rendered."""
    if name not in RENDERERS:
        raise ValueError(f"no renderer {name}")
    render = RENDERERS[name][0]

    def one(messages, tools) -> list[dict] | None:
        if messages is None:
            return None
        rows = [{"role": m["role"], "content": list(m["content"]), "loss_weight": m.get("loss_weight")} for m in messages]
        try:
            return [{"text": t, "weight": float(w)} for t, w in render(rows, tools, **options)]
        except (ValueError, KeyError, TypeError):
            return None

    @F.pandas_udf(SEGMENTS)
    def udf(messages: pd.Series, tools: pd.Series) -> pd.Series:
        return pd.Series([one(m, t) for m, t in zip(messages, tools, strict=True)], dtype=object)

    return udf


def parser(name: str):
    """A pandas UDF from generated text to typed content; NULL for NULL and for bad calls."""
    tag = RENDERERS[name][1]

    def one(text):
        try:
            return parse(text, tag) if text is not None else None
        except ValueError:
            return None

    @F.pandas_udf("array<struct<type:string,value:string>>")
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return udf


def model_input(segments: Column, tokenizer) -> dict[str, Column]:
    """input_ids, attention_mask, labels, loss_weights and position_ids (from 1) of segments; a label
    counts where its weight is above 0."""
    held = F.transform(segments, lambda s: F.struct(tokenizer(s["text"]).alias("ids"), s["weight"].alias("w")))
    ids = F.flatten(F.transform(held, lambda s: s["ids"]))
    return {
        "input_ids": ids,
        "attention_mask": F.array_repeat(F.lit(1), F.size(ids)),
        "labels": F.flatten(F.transform(held, lambda s: F.when(s["w"] > 1e-6, s["ids"]).otherwise(F.array_repeat(F.lit(IGNORE), F.size(s["ids"]))))),
        "loss_weights": F.flatten(F.transform(held, lambda s: F.array_repeat(s["w"], F.size(s["ids"])))),
        "position_ids": F.when(F.size(ids) > 0, F.sequence(F.lit(1), F.size(ids))).otherwise(F.array().cast("array<int>")),
    }


def pair_input(chosen: Column, rejected: Column, tokenizer) -> dict[str, Column]:
    """The inputs of a pair in one sequence, with token_type_ids 1 for the chosen and 2 for the
    rejected; positions begin again."""
    a, b = model_input(chosen, tokenizer), model_input(rejected, tokenizer)
    out = {k: F.concat(a[k], b[k]) for k in a}
    kinds = [F.array_repeat(F.lit(i), F.size(x["input_ids"])) for i, x in ((1, a), (2, b))]
    return out | {"token_type_ids": F.concat(*kinds)}

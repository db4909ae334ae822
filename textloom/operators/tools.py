"""Tool calls in text: announced in a prompt, written and read back, by format.

A call is (name, arguments), the arguments being what their JSON holds. ``read`` gives the calls,
or None where the text holds none, in which case it is an ordinary answer.
"""

from __future__ import annotations

import ast
import datetime
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Calls = list[tuple[str, object]]

# --- fixed values: what the prompts of the formats say -----------------------------------------------------
_SIGNATURES = "You may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>{tools}\n</tools>\n\n"
_JSON_CALL = 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
_PARAMETER_CALL = "<function=example_function_name>\n<parameter=example_parameter_1>{open}value_1{close}</parameter>\n<parameter=example_parameter_2>{open}This is the value for the second parameter\nthat can span\nmultiple lines{close}</parameter>\n</function>\n"
PROMPTS = {
    "default": "You have access to the following tools:\n{tools}Use the following format if using a tool:\n```\nAction: tool name (one of [{names}])\nAction Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{\"input\": \"hello world\", \"num_beams\": 5}```)\n```\n",
    "glm4": "你是一个名为 ChatGLM 的人工智能助手。你是基于智谱 AI 公司训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n# 可用工具{tools}",
    "glm4_moe": "\n\n# Tools\n\n" + _SIGNATURES + "For each function call, output the function name and arguments within the following XML format:\n<tool_call>{function-name}\n<arg_key>{arg-key-1}</arg_key>\n<arg_value>{arg-value-1}</arg_value>\n<arg_key>{arg-key-2}</arg_key>\n<arg_value>{arg-value-2}</arg_value>\n...\n</tool_call>\n",
    "llama3": 'Cutting Knowledge Date: December 2023\nToday Date: {date}\n\nYou have access to the following functions. To call a function, please respond with JSON for a function call. Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.\n\n{tools}',
    "minimax1": 'You are provided with these tools:\n<tools>\n{tools}</tools>\n\nIf you need to call tools, please respond with <tool_calls></tool_calls> XML tags, and provide tool-name and json-object of arguments, following the format below:\n<tool_calls>\n{"name": <tool-name-1>, "arguments": <args-json-object-1>}\n...\n</tool_calls>',
    "minimax2": '\n\n# Tools\n\nYou may call one or more tools to assist with the user query.\nHere are the tools available in JSONSchema format:\n\n<tools>\n{tools}</tools>\n\nWhen making tool calls, use XML format to invoke tools and pass parameters:\n\n<minimax:tool_call>\n<invoke name="tool-name-1">\n<parameter name="param-key-1">param-value-1</parameter>\n<parameter name="param-key-2">param-value-2</parameter>\n...\n</invoke>\n</minimax:tool_call>',
    "mistral": "[AVAILABLE_TOOLS] {tools}[/AVAILABLE_TOOLS]",
    "qwen": "\n\n# Tools\n\n" + _SIGNATURES + _JSON_CALL,
    "qwen3_5": "\n\n# Tools\n\nYou have access to the following functions:\n\n<tools>{tools}\n</tools>\n\nIf you choose to call a function ONLY reply in the following format with NO suffix:\n\n<tool_call>\n" + _PARAMETER_CALL.format(open="\n", close="\n") + "</tool_call>\n\n<IMPORTANT>\nReminder:\n- Function calls MUST follow the specified format: an inner <function=...></function> block must be nested within <tool_call></tool_call> XML tags\n- Required parameters MUST be specified\n- You may provide optional reasoning for your function call in natural language BEFORE the function call, but NOT after\n- If there is no function call available, answer the question like normal with your current knowledge and do not tell the user about function calls\n</IMPORTANT>",
    "seed_oss": "system\nYou are Doubao, a helpful AI assistant. You may call one or more functions to assist with the user query.Tool List:\nYou are authorized to use the following tools (described in JSON Schema format). Before performing any task, you must decide how to call them based on the descriptions and parameters of these tools.{tools}\n工具调用请遵循如下格式:\n<seed:tool_call>\n" + _PARAMETER_CALL.format(open="", close="") + "</seed:tool_call>\n",
    "ling": "# Tools\n\n" + _SIGNATURES + _JSON_CALL + "\ndetailed thinking off",
    "lfm2": "List of tools: <|tool_list_start|>{tools}<|tool_list_end|>",
    "gemma4": "{tools}",
}
_GLM4_TOOL = "\n\n## {name}\n\n{body}\n在调用上述函数时，请使用 Json 格式表示调用的参数。"
_QUOTE = '<|"|>'


def _dump(x, **kw) -> str:
    return json.dumps(x, ensure_ascii=False, **kw)


def _load(x: str):
    """(whether it is JSON, what it holds)."""
    try:
        return True, json.loads(x)
    except ValueError:
        return False, None


def _word(v) -> str:
    return v if isinstance(v, str) else _dump(v)


def _bare(tool: dict) -> dict:
    return tool.get("function", tool) if tool.get("type") == "function" else tool


def _wrapped(tool: dict) -> dict:
    return tool if tool.get("type") == "function" else {"type": "function", "function": tool}


@dataclass(frozen=True)
class ToolFormat:
    """``announce`` describes the tools of the prompt, ``write`` the calls of an answer, ``read``
    finds them again."""

    announce: Callable[[list[dict]], str]
    write: Callable[[Calls], str]
    read: Callable[[str], Calls | None]


# --- announcing -----------------------------------------------------------------------------------------------


def _described(tools: list[dict]) -> str:
    out = []
    for t in map(_bare, tools):
        schema = t["parameters"]
        lines = [f"> Tool Name: {t['name']}\nTool Description: {t.get('description', '')}\nTool Args:\n"]
        for name, p in schema["properties"].items():
            notes = f", should be one of [{', '.join(p['enum'])}]" if p.get("enum") else ""
            notes += f", where each item should be {p['items'].get('type', '')}" if p.get("items") else ""
            need = ", required" if name in schema.get("required", []) else ""
            lines.append(f"  - {name} ({p.get('type', '')}{need}): {p.get('description', '')}{notes}\n")
        out.append("".join(lines) + "\n")
    return "".join(out)


def _declared(tools: list[dict]) -> str:
    quoted = lambda x: f"{_QUOTE}{x}{_QUOTE}"
    group = lambda parts: "{" + ",".join(p for p in parts if p) + "}"
    described = lambda x: f"description:{quoted(x['description'])}" if x.get("description") else ""
    typed = lambda x: f"type:{quoted(str(x['type']).upper())}" if x.get("type") else ""
    out = []
    for t in map(_bare, tools):
        parts = [f"description:{quoted(t.get('description', ''))}"]
        if p := t.get("parameters"):
            fields = group(f"{n}:{group([described(s), typed(s)])}" for n, s in p["properties"].items()) if p.get("properties") else ""
            need = "required:[" + ",".join(map(quoted, p["required"])) + "]" if p.get("required") else ""
            parts.append("parameters:" + group([f"properties:{fields}" if fields else "", need, typed(p)]))
        if r := t.get("response"):
            parts.append("response:" + group([described(r), typed(r) if str(r.get("type", "")).upper() == "OBJECT" else ""]))
        out.append(f"declaration:{t['name']}" + group(parts))
    return "\n".join(out)


def _announcing(name: str, tools_text: Callable[[list[dict]], str]) -> Callable[[list[dict]], str]:
    form = PROMPTS[name]

    def announce(tools: list[dict]) -> str:
        if not tools:
            return ""
        slots = {"{names}": ", ".join(_bare(t)["name"] for t in tools), "{date}": datetime.date.today().strftime("%d %b %Y"), "{tools}": tools_text(tools)}
        out = form
        for slot, value in slots.items():  # the tools' own text comes last and is not searched
            out = out.replace(slot, value, 1)
        return out

    return announce


def _each(before: str, one: Callable[[dict], dict], after: str = "", **kw):
    return lambda tools: "".join(before + _dump(one(t), **kw) + after for t in tools)


# --- writing --------------------------------------------------------------------------------------------------


def _tagged(key_open: str, key_close: str, value_open: str, value_close: str, head: str, foot: str, between: str = "\n"):
    """A writer of parameters as tags, one call after the other."""

    def write(calls: Calls) -> str:
        out = []
        for name, args in calls:
            body = "".join(f"\n{key_open}{k}{key_close}{value_open}{_word(v)}{value_close}" for k, v in args.items())
            out.append(head.replace("{name}", name) + body + foot)
        return between.join(out)

    return write


def _gemma_value(v) -> str:
    if isinstance(v, str):
        return f"{_QUOTE}{v}{_QUOTE}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_gemma_value(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_gemma_value, v)) + "]"
    return _dump(v) if v is None or isinstance(v, bool) else str(v)


def _gemma(calls: Calls) -> str:
    inner = lambda a: a if isinstance(a, str) else _gemma_value(a)[1:-1] if isinstance(a, dict) else _gemma_value(a)
    return "".join(f"<|tool_call>call:{n}{{{inner(a)}}}<tool_call|>" for n, a in calls)


def _one_call(calls: Calls) -> str:
    if len(calls) > 1:
        raise ValueError("this format holds one call only")
    return f"{calls[0][0]}\n{_dump(calls[0][1])}"


def _pythonic(calls: Calls) -> str:
    value = lambda v: f'"{v}"' if isinstance(v, str) else _dump(v)
    return "<|tool_call_start|>[" + ", ".join(f"{n}({', '.join(f'{k}={value(v)}' for k, v in a.items())})" for n, a in calls) + "]<|tool_call_end|>"


def _objects(key: str, calls: Calls) -> list[dict]:
    return [{"name": n, key: a} for n, a in calls]


# --- reading --------------------------------------------------------------------------------------------------


def _named(x, key: str) -> tuple[str, object] | None:
    return (x["name"], x[key]) if isinstance(x, dict) and "name" in x and key in x else None


def _whole(found: list) -> Calls | None:
    """The calls where all of them could be read."""
    return found if found and all(x is not None for x in found) else None


def _read_actions(text: str) -> Calls | None:
    out = []
    for name, given in re.findall(r"Action:\s*(\w+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)", text, re.S | re.A):
        good, args = _load(given.strip().strip('"').strip("`"))
        out.append((name, args) if good else None)
    return _whole(out)


def _read_tagged_json(text: str) -> Calls | None:
    parts = re.findall(r"<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)", text, re.S)
    return _whole([_named(_load(p.strip())[1], "arguments") for p in parts])


def _read_json(key: str):
    def read(text: str) -> Calls | None:
        good, x = _load(text.strip())
        return _whole([_named(c, key) for c in (x if isinstance(x, list) else [x])]) if good else None

    return read


def _read_first_line(text: str) -> Calls | None:
    name, end, rest = text.partition("\n")
    good, args = _load(rest.strip()) if end else (False, None)
    return [(name, args)] if good else None


def _read_lines(text: str) -> Calls | None:
    held = re.search(r"<tool_calls>\s*(.+?)\s*</tool_calls>", text, re.S)
    found = [_named(_load(x)[1], "arguments") for x in (held.group(1).split("\n") if held else [])]
    return [x for x in found if x is not None] or None


def _read_parameters(call: str, parameter: str, within: str | None = None, strip: bool = False):
    """A reader of calls with tagged parameters; a value that is no JSON is text."""

    def read(text: str) -> Calls | None:
        if within:
            held = re.search(within, text, re.S)
            text = held.group(1) if held else ""
        out = []
        for name, body in re.findall(call, text, re.S):
            args = {}
            for k, raw in re.findall(parameter, body, re.S):
                good, value = _load(raw.strip())
                args[k] = value if good else raw.strip() if strip else raw
            out.append((name.strip(), args))
        return out or None

    return read


def _read_gemma(text: str) -> Calls | None:
    out = []
    for name, body in re.findall(r"<\|tool_call>call:([^{\s]+)\{(.*?)\}<tool_call\|>", text, re.S):
        # Quoted strings are set aside, so that the keys found are none of their words.
        strings: list[str] = []

        def aside(m: re.Match, strings=strings) -> str:
            strings.append(_dump(m.group(1)))
            return f"\x00{len(strings) - 1}\x00"

        plain = re.sub(r'<\|"\|>(.*?)<\|"\|>', aside, body.strip(), flags=re.S)
        plain = re.sub(r"(^|[{\s,])([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', plain, flags=re.A)
        plain = re.sub("\x00(\\d+)\x00", lambda m, strings=strings: strings[int(m.group(1))], plain)
        good, args = _load("{" + plain + "}")
        if not good:
            good, args = _load(body.strip())
        out.append((name, args if good else body.strip()))
    return out or None


def _literal(node: ast.AST):
    """The value of a literal, of which true, false and null may be written as in JSON."""
    known = {"true": True, "false": False, "null": None}
    if isinstance(node, ast.Name) and node.id in known:
        return known[node.id]
    return ast.literal_eval(node)


def _read_pythonic(text: str) -> Calls | None:
    held = re.search(r"<\|tool_call_start\|>(.*?)<\|tool_call_end\|>", text, re.S)
    try:
        body = ast.parse(held.group(1).strip(), mode="eval").body if held else None
        nodes = body.elts if isinstance(body, ast.List) else [body]
        return _whole([(n.func.id, {k.arg: _literal(k.value) for k in n.keywords}) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) else None for n in nodes])
    except (SyntaxError, ValueError):
        return None


_write_json_tags = lambda calls: "\n".join(f"<tool_call>\n{_dump(x)}\n</tool_call>" for x in _objects("arguments", calls))
_INVOKE, _INVOKE_PARAMETER = r'<invoke name="(.*?)">(.*?)</invoke>', r'<parameter name="(.*?)">(.*?)</parameter>'
_PARAMETER = r"<parameter=(.*?)>(.*?)</parameter>"
FORMATS: dict[str, ToolFormat] = {
    "default": ToolFormat(_announcing("default", _described), lambda cs: "\n".join(f"Action: {n}\nAction Input: {_dump(a)}" for n, a in cs), _read_actions),
    "gemma4": ToolFormat(_announcing("gemma4", _declared), _gemma, _read_gemma),
    "glm4": ToolFormat(_announcing("glm4", lambda ts: "".join(_GLM4_TOOL.replace("{name}", t["name"]).replace("{body}", _dump(t, indent=4)) for t in map(_bare, ts))), _one_call, _read_first_line),
    "llama3": ToolFormat(_announcing("llama3", _each("", _wrapped, "\n\n", indent=4)), lambda cs: _dump(_objects("parameters", cs) if len(cs) > 1 else _objects("parameters", cs)[0]), _read_json("parameters")),
    "lfm2": ToolFormat(_announcing("lfm2", lambda ts: _dump([_bare(t) for t in ts])), _pythonic, _read_pythonic),
    "minimax1": ToolFormat(_announcing("minimax1", _each("", _bare, "\n")), lambda cs: "<tool_calls>\n" + "\n".join(map(_dump, _objects("arguments", cs))) + "\n</tool_calls>", _read_lines),
    "minimax2": ToolFormat(_announcing("minimax2", _each("<tool>", _bare, "</tool>\n")), _tagged('<parameter name="', '">', "", "</parameter>", '<invoke name="{name}">', "\n</invoke>"), _read_parameters(_INVOKE, _INVOKE_PARAMETER, r"<minimax:tool_call>\s*(.+?)\s*</minimax:tool_call>")),
    "mistral": ToolFormat(_announcing("mistral", lambda ts: _dump([_wrapped(t) for t in ts])), lambda cs: _dump(_objects("arguments", cs)), _read_json("arguments")),
    "qwen": ToolFormat(_announcing("qwen", _each("\n", _wrapped)), _write_json_tags, _read_tagged_json),
    "qwen3_5": ToolFormat(_announcing("qwen3_5", _each("\n", _bare)), _tagged("<parameter=", ">", "\n", "\n</parameter>", "<tool_call>\n<function={name}>", "\n</function>\n</tool_call>"), _read_parameters(r"<tool_call>\s*<function=\s*([^\s<>]+)\s*(.*?)\s*</function>\s*</tool_call>", _PARAMETER, strip=True)),
    # Its calls are written as keys and values, but read as JSON: what it writes is not read back.
    "glm4_moe": ToolFormat(_announcing("glm4_moe", _each("\n", _wrapped)), _tagged("<arg_key>", "</arg_key>", "\n<arg_value>", "</arg_value>", "\n<tool_call>{name}", ""), _read_tagged_json),
    "seed_oss": ToolFormat(_announcing("seed_oss", lambda ts: "\n" + _dump(ts)), _tagged("<parameter=", ">", "", "</parameter>", "\n<seed:tool_call>\n<function={name}>", "\n</function>\n</seed:tool_call>"), _read_parameters(r"<seed:tool_call>\s*<function=\s*([^\s<>]+)\s*(.*?)\s*</function>\s*</seed:tool_call>", _PARAMETER)),
    "ling": ToolFormat(_announcing("ling", _each("\n", _wrapped)), _write_json_tags, _read_tagged_json),
}


def tool_format(name: str) -> ToolFormat:
    if name not in FORMATS:
        raise ValueError(f"no tool format {name}")
    return FORMATS[name]


def extract(text: str | None, name: str = "default") -> Calls | None:
    return tool_format(name).read(text) if text else None


def calls_of(content: str) -> Calls:
    """The calls of a function message: one JSON object with name and arguments, or a list of them."""
    good, x = _load(content)
    found = [_named(c, "arguments") for c in (x if isinstance(x, list) else [x])] if good else []
    if not good or any(c is None for c in found):
        raise ValueError(f"no tool call in JSON: {content[:200]}")
    return found


def function_text(content: str, name: str = "default", thought: tuple[str, str] | None = None, call_words: tuple[str, str] | None = None) -> str:
    """A function message in a format. Marked calls are taken out of their text, which stays before
    them; else a marked thought stays before the calls."""
    between = lambda words: re.search(re.escape(words[0]) + "(.*?)" + re.escape(words[1]), content, re.S) if words else None
    write = tool_format(name).write
    if marked := between(call_words):
        return content.replace(marked.group(0), "") + write(calls_of(marked.group(1)))
    if mused := between(thought):
        return mused.group(0) + write(calls_of(content.replace(mused.group(0), "")))
    return write(calls_of(content))


def tools_text(content: str | None, name: str = "default") -> str:
    """The prompt of the tools given as a JSON list; none for no tools; bad JSON is refused."""
    if not content:
        return ""
    good, tools = _load(content)
    if not good:
        raise ValueError(f"no tools in JSON: {content[:200]}")
    return tool_format(name).announce(tools)


CALLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))


def extractor(name: str):
    """A pandas UDF from text to array<struct<name, arguments>>; NULL where the text has no call."""
    read = tool_format(name).read

    @F.pandas_udf(CALLS)
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"name": n, "arguments": _word(a)} for n, a in c] if t and (c := read(t)) else None)

    return udf


def writer(name: str, thought: tuple[str, str] | None = None):
    """A pandas UDF from function messages in JSON to their text; NULL for NULL and for bad JSON."""

    def one(content: str | None) -> str | None:
        try:
            return function_text(content, name, thought) if content else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def udf(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    return udf


def announcer(name: str):
    """A pandas UDF from tools in JSON to their prompt; NULL for bad JSON, "" for no tools."""

    def one(content: str | None) -> str | None:
        try:
            return tools_text(content, name)
        except (ValueError, KeyError, TypeError, AttributeError):
            return None

    @F.pandas_udf("string")
    def udf(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    return udf

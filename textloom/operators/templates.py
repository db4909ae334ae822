"""Chat templates as text: an array of messages becomes a prompt and a response."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import longest_difference, remove_thought
from textloom.operators.chat_templates import TEMPLATES, Template
from textloom.operators.tools import announcer, function_text

__all__ = ["TEMPLATES", "Template"]


def register(template: Template) -> None:
    if template.name in TEMPLATES:
        raise ValueError(f"{template.name} is registered")
    TEMPLATES[template.name] = template


def resolve(name: str | None, tool_format: str | None = None, default_system: str | None = None) -> Template:
    """The template of a name (``empty`` for none), with another tool format or system text on demand."""
    key = name or "empty"
    if key not in TEMPLATES:
        raise ValueError(f"no template {name}")
    out = TEMPLATES[key]
    if tool_format is not None:
        out = replace(out, tool_format=tool_format)
    return replace(out, default_system=default_system) if default_system is not None else out


def stop_tokens(template: Template, eos: str = "</s>") -> list[str]:
    """The end token and the stop words, each once."""
    return list(dict.fromkeys([eos, *template.stop_words]))


def special_tokens(template: Template, eos: str | None, pad: str | None = None) -> dict[str, str | list[str]]:
    """eos, pad and further stop words of a tokenizer under a template: where it replaces the end token,
    the first stop word is the new one; a missing end token is ``<|endoftext|>``, missing padding is the
    end token."""
    words = list(template.stop_words)
    if template.replace_eos:
        if not words:
            raise ValueError("stop words are needed to replace the end token")
        eos = words.pop(0)
    eos = eos or "<|endoftext|>"
    return {"eos": eos, "pad": pad or eos, "stop_words": words}


def _fill(form: str, content: Column, tokens: dict[str, str]) -> Column:
    for k, v in tokens.items():
        form = form.replace(k, v)
    before, _, after = form.partition("{{content}}")
    return F.concat(F.lit(before), content, F.lit(after))


def empty_thought(template: Template) -> str:
    return template.thought[1] if template.closing_only else "".join(template.thought)


def with_calls(messages: Column, template: Template) -> Column:
    """``messages`` with the function messages written in the template's tool format; one that holds no
    call in JSON is NULL."""
    words = template.thought if template.reasoning else None

    def one(content: str | None) -> str | None:
        try:
            return function_text(content or "", template.tool_format or "default", words, template.call_words)
        except ValueError:
            return None

    @F.pandas_udf("array<struct<role:string,content:string>>")
    def udf(dialogues: pd.Series) -> pd.Series:
        return dialogues.map(lambda ms: [{"role": m["role"], "content": one(m["content"]) if m["role"] == "function" else m["content"]} for m in ms] if ms is not None else None)

    return udf(messages)


def tools_of(template: Template, tools: Column) -> Column:
    """The prompt of the tools (in JSON) of a template; "" for none and NULL for bad JSON."""
    if not template.tool_format:
        return F.when(F.coalesce(tools, F.lit("")) == "", "").otherwise(_fill(template.tools, tools, {}))
    return announcer(template.tool_format)(tools)


def _strip(template: Template, content: Column) -> Column:
    return remove_thought(content, template.thought[0].strip(), template.thought[1].strip())


def render(template: Template, messages: Column, system: Column | None = None, eos: str = "</s>", bos: str = "<s>", tools: Column | None = None, strip: str = "history") -> Column:
    """An array with the text of each message; the first has the prefix and the system text, at whose
    end the prompt of the tools stands (``tools``, see ``tools_of``).

    ``strip``: whose thoughts a reasoning template leaves out: of answers before the last pair
    ("history"), of all ("all") or of none. Roles without a form of their own use the user's
    (observation) or the assistant's (function). Function messages are taken as they are: see
    ``with_calls``.
    """
    tokens = {"<eos>": eos, "<bos>": bos}
    given = F.coalesce(F.nullif(system, F.lit("")), F.lit(template.default_system)) if system is not None else F.lit(template.default_system)
    whole = F.concat(given, F.coalesce(tools, F.lit(""))) if tools is not None else given
    head = F.when(whole != "", _fill(template.system, whole, tokens)).otherwise("")
    prefix = F.lit(template.prefix.replace("<bos>", bos).replace("<eos>", eos))

    def one(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        if template.reasoning and strip != "none":
            early = (i % 2 == 1) if strip == "all" else (i % 2 == 1) & (i < F.size(messages) - 2)
            content = F.when(early, _strip(template, content)).otherwise(content)
        first = F.when(i == 0, head).otherwise("")
        user = _fill(template.user, F.concat(first, content) if template.system_in_user else content, tokens)
        text = (
            F.when(m["role"] == "user", user)
            .when(m["role"] == "assistant", _fill(template.assistant, content, tokens))
            .when(m["role"] == "observation", _fill(template.observation or template.user, content, tokens))
            .when(m["role"] == "function", _fill(template.function or template.assistant, content, tokens))
        )
        return F.concat(F.when(i == 0, prefix).otherwise(""), F.lit("") if template.system_in_user else first, text)

    return F.transform(messages, one)


def _thoughtless(template: Template, content: Column) -> Column:
    start, end = (w.strip() for w in template.thought)
    text = F.coalesce(content, F.lit(""))
    return ~text.contains(start) & ~text.contains(end)


def one_turn(template: Template, messages: Column, system: Column | None = None, think: bool | None = True, preserve: bool = False, **kw) -> tuple[Column, Column]:
    """(prompt, response): all messages but the last, and the last.

    An answer of a reasoning template without a thought gets an empty one: in the response, where it is
    learned, or in the prompt if ``think`` is not True; False also takes the thought of the answer.
    """
    strip = "none" if preserve else "history"
    if template.reasoning and think is False:
        last = F.element_at(messages, -1)
        messages = F.concat(F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0))), F.array(F.struct(last["role"].alias("role"), _strip(template, last["content"]).alias("content"))))
    texts = render(template, messages, system, strip=strip, **kw)
    prompt, response = F.array_join(F.slice(texts, F.lit(1), F.greatest(F.size(texts) - 1, F.lit(0))), ""), F.element_at(texts, -1)
    if not template.reasoning:
        return prompt, response
    blank = F.when(_thoughtless(template, F.element_at(messages, -1)["content"]), empty_thought(template)).otherwise("")
    return (prompt, F.concat(blank, response)) if think else (F.concat(prompt, blank), response)


def turn_pairs(template: Template, messages: Column, system: Column | None = None, think: bool | None = True, discard_history: bool = False, **kw) -> Column:
    """An array of struct(prompt, response), one for each two messages; empty thoughts as in ``one_turn``
    for every pair, or for the last one where the thoughts before it are discarded."""
    strip = "all" if think is False else "history" if discard_history else "none"
    texts = render(template, messages, system, strip=strip, **kw)

    def pair(t: Column, i: Column) -> Column:
        answer = F.get(messages, i + 1)["content"]
        answer = _strip(template, F.coalesce(answer, F.lit(""))) if template.reasoning and think is False else answer
        nxt = F.get(texts, i + 1)
        if not template.reasoning:
            return F.struct(i.alias("i"), t.alias("prompt"), nxt.alias("response"))
        asked = _thoughtless(template, answer)
        asked = asked & (i == F.size(messages) - 2) if discard_history else asked
        blank = F.when(asked, empty_thought(template)).otherwise("")
        prompt, response = (t, F.concat(blank, nxt)) if think else (F.concat(t, blank), nxt)
        return F.struct(i.alias("i"), prompt.alias("prompt"), response.alias("response"))

    return F.transform(F.filter(F.transform(texts, pair), lambda x: x["i"] % 2 == 0), lambda x: F.struct(x["prompt"].alias("prompt"), x["response"].alias("response")))


# --- templates as text of other systems ------------------------------------------------------------------------


def _pieces(form: str, eos: str, bos: str) -> tuple[str, str | None]:
    form = form.replace("<eos>", eos).replace("<bos>", bos)
    before, mark, after = form.partition("{{content}}")
    return before, after if mark else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", r"\n").replace("'", r"\'") + "'"


def jinja(template: Template, eos: str = "</s>", bos: str = "<s>") -> str:
    """The template as Jinja over ``messages``."""

    def expression(form: str, name: str) -> str:
        before, after = _pieces(form, eos, bos)
        parts = [_quoted(before)] if before else []
        if after is not None:
            parts += [name, *([_quoted(after)] if after else [])]
        return " + ".join(parts)

    prefix = expression(template.prefix, "content")
    out = f"{{{{ {prefix} }}}}" if prefix else ""
    if template.default_system:
        out += f"{{% set system_message = {_quoted(template.default_system)} %}}"
    first = "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}{% else %}{% set loop_messages = messages %}{% endif %}"
    if template.system_in_user:
        system = f"{{% if loop.index0 == 0 and system_message is defined %}}{{% set content = {expression(template.system, 'system_message')} + message['content'] %}}{{% endif %}}"
        said = ""
    else:
        system, said = "", f"{{% if system_message is defined %}}{{{{ {expression(template.system, 'system_message')} }}}}{{% endif %}}"
    turns = f"{{% if message['role'] == 'user' %}}{{{{ {expression(template.user, 'content')} }}}}{{% elif message['role'] == 'assistant' %}}{{{{ {expression(template.assistant, 'content')} }}}}{{% endif %}}"
    return out + first + said + "{% for message in loop_messages %}{% set content = message['content'] %}" + system + turns + "{% endfor %}"


def ollama(template: Template, eos: str = "</s>", bos: str = "<s>") -> str:
    """The template in the form of Go templates."""

    def filled(form: str, name: str) -> str:
        before, after = _pieces(form, eos, bos)
        return before + ("{{ " + name + " }}" + after if after is not None else "")

    each = '{{ range .Messages }}{{ if eq .Role "user" }}' + filled(template.user, ".Content") + '{{ else if eq .Role "assistant" }}' + filled(template.assistant, ".Content") + "{{ end }}{{ end }}"
    return filled(template.prefix, "") + "{{ if .System }}" + filled(template.system, ".System") + "{{ end }}" + each


def parse_template(apply, eos: str = "</s>") -> Template:
    """A template from how a tokenizer renders messages: ``apply(messages, generate)`` gives the text of a
    list of {role, content}. Each form is what the markers' surroundings say."""
    s, u, a = "{{system}}", "{{user}}", "{{content}}"
    system, user, answer = {"role": "system", "content": s}, {"role": "user", "content": u}, {"role": "assistant", "content": a}
    cut = lambda long, short: long[len(short) :] if long.startswith(short) else longest_difference(short, long)
    asked, answered = apply([user], True), apply([user, answer], False)
    again = cut(apply([user, answer, user], True), answered)  # a later user turn has no head of the system's
    lead = again[: again.index(u)]
    assistant = cut(answered, asked).replace(eos, "<eos>")
    head = asked[: asked.index(u)]
    head = head[: len(head) - len(lead)] if lead and head.endswith(lead) else head
    default = ""
    try:
        told = apply([system, user], True)
        form = told[: told.index(u)]
        form = form[: len(form) - len(lead)] if lead and form.endswith(lead) else form
        before, _, after = form.partition(s)
        if len(head) > len(before) + len(after) and head.startswith(before) and head.endswith(after):
            default = head[len(before) : len(head) - len(after)]
            head = ""
        prefix = head if form.startswith(head) else ""
        form = form[len(prefix) :].replace(s, a)
    except Exception:  # a tokenizer that refuses system messages
        prefix, form = head, a
    return Template("parsed", user=again.replace(u, a), assistant=assistant, system=form, prefix=prefix, default_system=default)

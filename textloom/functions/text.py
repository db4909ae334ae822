"""Text cleaning and paper metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and the separators that Java's own class leaves out.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

# --- fixed values: terms of the keyword score ---------------------------------------------------------
TERMS = {
    "rag": ["retrieval augmented generation", "retrieval-augmented generation", "rag", "graphrag"],
    "retrieval": ["retrieval", "retriever", "dense retrieval", "sparse retrieval", "hybrid retrieval", "vector search", "semantic search", "document retrieval", "knowledge retrieval", "bm25", "faiss"],
    "generation": ["llm", "large language model", "language model", "generative model", "transformer", "text generation"],
    "rl": ["reinforcement learning", "rl", "q-learning", "deep q network", "dqn", "policy gradient", "ppo", "trpo", "a2c", "a3c", "sac", "actor-critic", "reward function", "markov decision process", "mdp", "agent environment interaction"],
    "agentic_workflow": ["langgraph", "graph-based agent", "agent workflow", "multi-agent", "planner executor", "tool calling", "tool-use", "workflow orchestration", "stateful workflow", "state machine", "agent orchestration", "llm orchestration", "autonomous agent", "reasoning pipeline"],
    "kg": ["knowledge graph", "entity relation graph", "semantic graph", "ontology", "rdf", "triple store", "knowledge base graph", "graph database", "neo4j"],
}
# --- fixed values: categories that count as related ----------------------------------------------------
AI_CATEGORIES = ["csai", "cslg", "cscl", "cscv", "csir", "csro", "csma", "csse", "csdb", "csdc", "cshc", "csne", "cssy", "statml", "eessas", "eesssp"]
# --- fixed values: thresholds ---------------------------------------------------------------------------
CONFIDENCE, YEAR, QUOTA = 0.65, 2024, 150
FLAGS = {"is_rag": "RAG", "is_rl": "RL", "is_agentic_workflow": "Agentic Workflow", "is_kg": "Knowledge Graph"}


def clean(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; NULL stays NULL."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens(text: Column) -> Column:
    """The words of a cleaned text; NULL and blank texts have none."""
    return F.filter(F.split(F.coalesce(clean(text), F.lit("")), " "), lambda x: x != "")


def category_tokens(categories: Column) -> Column:
    """Categories in lower case without dots."""
    return tokens(F.replace(F.lower(categories), F.lit("."), F.lit("")))


def keywords(title: Column, categories: Column) -> Column:
    """The words of the title in lower case and the categories."""
    return F.concat(tokens(F.lower(title)), category_tokens(categories))


def matches(keyword: Column, terms: list[str]) -> Column:
    """Pairs of a keyword and a term that it contains."""
    return F.aggregate(keyword, F.lit(0), lambda n, k: n + sum((F.contains(k, F.lit(t)).cast("int") for t in terms), F.lit(0)))


def keyword_scores(keyword: Column) -> dict[str, Column]:
    """Score of each class; rag has 2 more where retrieval and generation terms occur too."""
    found = {k: matches(keyword, v) for k, v in TERMS.items()}
    rag = found["rag"] + F.when((found["retrieval"] > 0) & (found["generation"] > 0), 2).otherwise(0)
    return {"rag": rag, "rl": found["rl"], "agentic_workflow": found["agentic_workflow"], "kg": found["kg"]}


def best_class(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(class, confidence): the first of the highest scores; no class and 0 where all are 0."""
    best = F.greatest(*scores.values())
    name = F.lit(None).cast("string")
    for k in reversed(scores):
        name = F.when((best > 0) & (scores[k] == best), F.lit(k)).otherwise(name)
    return name, F.when(best > 0, F.least(F.lit(1.0), F.round(F.lit(0.5) + F.lit(0.1) * best, 10))).otherwise(F.lit(0.0))


def year_of(paper_id: Column) -> Column:
    """The year that a new-style id begins with (91 and later are 19xx); else NULL."""
    head = F.substring_index(F.substring_index(paper_id, "v", 1), ".", 1)
    two = F.when(head.rlike(r"^\d{4,}$"), F.substring(head, 1, 2).cast("int"))
    return F.when(two >= 91, two + 1900).otherwise(two + 2000)


def confidence_of(confidence: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(confidence, F.lit(key)), F.lit(0.0))


def accepted(confidence: Column) -> Column:
    """The highest of the four confidences reaches the limit and a flag is set."""
    top = F.greatest(*[confidence_of(confidence, k) for k in ("rag", "rl", "agentic_workflow", "kg")])
    flag = F.lit(False)
    for f in FLAGS:
        flag = flag | F.coalesce(F.col(f), F.lit(False))
    return (top >= CONFIDENCE) & flag


def labels() -> Column:
    """Names of the flags that are set, in their fixed order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(n)) for f, n in FLAGS.items()]))


def join_prompt(*parts: Column) -> Column:
    """The parts that are not empty, each on a line of its own."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def fill_slot(template: Column, slot: str, value: Column) -> Column:
    """The first ``{{slot}}`` of a template replaced; others stay."""
    mark = "{{" + slot + "}}"
    at = F.instr(template, mark)
    return F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), value, F.substring(template, at + len(mark), F.length(template)))).otherwise(template)


def remove_thought(text: Column, start: str = "<think>", end: str = "</think>") -> Column:
    """The text without its marked thoughts and the line ends that then begin it."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?s)\Q{start}\E.*?\Q{end}\E", ""), r"^\n+", "")


def timing(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


_SLOT = r"\{\{[a-zA-Z_][a-zA-Z0-9_]*\}\}"


def has_slot(form: Column) -> Column:
    """Whether a form holds a slot; one with content needs one, one without must have none."""
    return form.rlike(_SLOT)


def add_thought(text: Column, thought: str = "", start: str = "<think>", end: str = "</think>") -> Column:
    """The text after a marked thought, empty by default."""
    return F.concat(F.lit(f"{start}\n{thought}\n{end}\n\n"), text)


def longest_difference(short: str, long: str) -> str:
    """The characters of ``long`` that are left when ``short`` is matched in it, in order, as far as it
    goes; what follows the end of the match is not part of it."""
    out, wanted = [], iter(short)
    need = next(wanted, None)
    for c in long:
        if need is None:
            break
        if c == need:
            need = next(wanted, None)
        else:
            out.append(c)
    return "".join(out)


# --- fixed values: the prompt around an abstract --------------------------------------------------------------
ABSTRACT_PROMPT = '\n            Analyze the given abstract and classify the paper\n\n            ABSTRACT INPUT:\n            """\n            {abstract}\n            """\n        '


def prompt_of(abstract: str | None) -> str:
    return ABSTRACT_PROMPT.replace("{abstract}", abstract or "")


def wrapped(abstract: Column) -> Column:
    before, after = ABSTRACT_PROMPT.split("{abstract}")
    return F.concat(F.lit(before), F.coalesce(abstract, F.lit("")), F.lit(after))


def split_fields(schema: str) -> list[str]:
    """The fields of a schema in DDL, split at its outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(schema[at:i].strip())
            at = i + 1
    return [x for x in out if x]


def listed(text: Column) -> Column:
    """The parts of a comma list, trimmed."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


#: Options that are shown even when they are off.
SHOWN = ("packing", "enable_thinking", "use_reentrant_gc", "double_quantization", "freeze_vision_tower", "freeze_multi_modal_projector")


def command(program: str, options: dict) -> str:
    """A command line over several lines, in a fenced block; options without a value are left out."""
    import json

    word = lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else " ".join(map(str, v)) if isinstance(v, list) else str(v)
    kept = [f"    --{k} {word(v)} " for k, v in options.items() if k in SHOWN or not (v is None or v is False or v == "")]
    return "```bash\n" + "\\\n".join([f"{program} ", *kept]) + "\n```"


def payload(system: Column, user: Column) -> Column:
    """The messages of a call: system and user."""
    part = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(part("system", system), part("user", user))


# --- fixed values: how text is generated unless the options say otherwise -----------------------------------------
GENERATION = {"temperature": 0.1, "top_p": 0.9, "frequency_penalty": 1.0}


def generation(options: dict) -> dict:
    """The options of a generation with defaults; ``max_tokens`` must be given."""
    if "max_tokens" not in options:
        raise ValueError("max_tokens is missing")
    return {**GENERATION, **options}


def public_url(url: Column) -> Column:
    """Whether a url is http or https and its host is no local name and no private, local or reserved
    address in numbers. Names are not resolved here."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    private = host.rlike(r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^192\.0\.[02]\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^198\.(?:1[89]|51\.100)\.|^203\.0\.113\.|^(?:22[4-9]|2[3-5]\d)\.|^\[(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]$|^localhost$|\.local$|\.internal$|^\d+$")
    return F.coalesce(scheme.isin("http", "https") & (host != "") & ~private, F.lit(False))


def inside_folder(path: Column, folder: str) -> Column:
    """Whether a path stays under a folder: absolute, without steps up."""
    base = folder.rstrip("/") + "/"
    return F.coalesce(path.startswith(base) & ~path.rlike(r"(?:^|/)\.\.(?:/|$)") & ~path.contains("\x00"), F.lit(False))


def day(date: Column) -> Column:
    """A date as in tool prompts: 05 Mar 2024."""
    return F.date_format(date, "dd MMM yyyy")


def key_uuid(*parts: Column) -> Column:
    """A uuid made of a row's key, the same at every run, unlike a random one."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    v = F.concat(F.substring(h, 1, 12), F.lit("3"), F.substring(h, 14, 3), F.lit("8"), F.substring(h, 18, 15))
    return F.concat_ws("-", F.substring(v, 1, 8), F.substring(v, 9, 4), F.substring(v, 13, 4), F.substring(v, 17, 4), F.substring(v, 21, 12))

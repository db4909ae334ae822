"""Problem 3: broken prompt and response pairs.

Method: each reply is compressed with its prompt as a raw zstandard dictionary, which makes a
copy almost free; language and refusal dictionaries and a terminal-context model (how often a
word, and a word after its predecessor, ends a unit of text, counted over all replies) give the
other labels.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.common import broadcast_if_small, map_batches, materialize, one_row_per, words
from textloom.operators.sequence import with_previous

# --- fixed values: literals that count as no content -----------------------------------------
EMPTY_LITERALS = frozenset(["null", "n/a", "none", "<empty>", "[no response]"])

# --- fixed values: frequent function words by language -----------------------------------------
FUNCTION_WORDS = {
    "en": "the of and to a in is that it for on with as are was be by this from at which not or an we each when if how what does do did why can you your please i my have has there their they than once while because so both taken between under into must would list compare explain summarise rises argues no all some any were been but if then because after before during over about only more most other such these those will could does contain contains used next need needs use using results report reports we ask who whose where tell us reach works limits evidence section paper datasets training trained human return returns uses shows show yes two three few new first second third without within through against follows knowledge latency grows stem drawn removing queries",
    "de": "der die das und ist ein eine einen einem den dem des mit für auf von zu im nicht sich auch als es an werden aus bei wird sind wie warum was welche nach ohne bitte ich sie kann über noch hat hängen ersetzt zwischen dass kaum dazu leider tut mir keine wählt anschließend vergleich wir welche welcher welches braucht brauchen wurden wurde geprüft hand liefert ergebnisse zeigen teilen vergleichen beim einer eines sowie wenn dann oder aber nur noch ihr ihre seine benötigt schritte werte wert erreicht sinkt um prozentpunkte verfahren fasse zusammen abschnitt funktioniert studie vollständig beste besten",
    "fr": "le la les des et est un une du que dans pour sur avec il ne pas ce qui au plus par sont nous vous peux je comment pourquoi quels quelles sans selon entre ont été cette ces soit avant après ensuite il elle peu aux mesure suis résumer donne étapes étape baisse comparons tirés tirées quel quelle quelles a à y ou où si mais aussi très tous toutes aucune aucun notre votre leur leurs manque encore rapport utiles montrent résultats méthode demande choisit meilleurs partagent remplace entièrement faut besoin fonctionne partie main points",
    "es": "el la los las y es un una del que en para con por no se su al más son como cómo qué por cuáles cuál según entre ha sin este esta después lo siento puedo hasta sobre apenas me a está frente muestran indican necesita necesitan cae puntos comparamos tomados tomadas cobertura resume favor parte sobre funciona o y pero si también muy todos todas ninguna ninguno nuestro nuestra su sus le les faltan aún hay fue fueron revisaron mano método pasos hasta elige mejores estudio comparten sustituye completo resultados después sirve usan qué cuánto da correctos",
}
_VOTES: dict[str, dict[str, float]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _VOTES.setdefault(_w, {})[_lang] = 1.0
for _by in _VOTES.values():
    for _lang in _by:
        _by[_lang] = 1.0 / len(_by)

# --- fixed values: names of languages as a user may write them -----------------------------------
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés inglese 英语 英文",
    "de": "german deutsch deutscher allemand alemán 德语 德文",
    "fr": "french französisch français francés 法语 法文",
    "es": "spanish spanisch espagnol español castellano 西班牙语 西班牙文",
    "zh": "chinese mandarin chinesisch chinois chino 中文 汉语 普通话",
}

# --- fixed values: how a reply declines, by language -----------------------------------------------
REFUSALS = re.compile(
    r"""
    \bi(?:['’]m|\ am)\ (?:sorry|afraid)\b[^.!?]*\b(?:can(?:['’]?t|not)|unable|not\ able|won['’]t|not\ allowed)\b
  | \b(?:i|we)\ (?:really\ )?(?:can(?:['’]?t|not)|could\ not|will\ not|won['’]t|am\ (?:not\ able|unable|not\ allowed|not\ permitted)\ to|['’]m\ (?:not\ able|unable|not\ allowed)\ to)\ (?:be\ able\ to\ )?(?:help|assist|answer|comment|discuss|provide|share|respond|summari[sz]e|comply|do\ that|fulfil|explain|speak|talk|give|offer|complete|support|engage|say|tell|continue)\b
  | \bi\ (?:must|have\ to|need\ to|respectfully)\ (?:decline|refuse)\b | \bi\ (?:decline|refuse)\ to\b
  | \bi['’]d\ (?:rather|prefer)\ not\b | \bi\ would\ (?:rather|prefer)\ not\b | \bi\ prefer\ not\ to\b
  | \bnot\ something\ (?:i\ can|i['’]m\ comfortable|i\ am\ comfortable|i['’]m\ able|i\ am\ able)\b
  | \boutside\ (?:of\ )?what\ i\ (?:am|can|may)\b | \bagainst\ my\ (?:guidelines|policy|policies|rules)\b
  | \bnot\ be\ appropriate\ for\ me\ to\b | \bi\ do\ not\ have\ access\ to\b | \bi\ don['’]t\ have\ access\ to\b
  | \b(?:as|being)\ an?\ (?:\w+\ ){0,2}(?:assistant|model|ai)\b[^.!?]*\b(?:not\ able|unable|can(?:['’]?t|not)|not\ allowed|not\ permitted)\b
  | \bi['’]?m\ not\ (?:able|allowed|permitted|comfortable)\b | \bi\ am\ not\ (?:able|allowed|permitted|comfortable)\b
  | \bno\ (?:\w+\ )?(?:answer|reply|response|comment|information|details?|advice)\ (?:can|could|may|will|is\ able\ to)\ be\ (?:provided|given|offered|made|shared|supplied)\b
  | \b(?:answer|request|question|topic)\b[^.!?]{0,30}\b(?:can(?:not|['’]t)|will\ not|won['’]t|may\ not)\ be\ (?:answered|provided|given|processed|fulfilled|handled|discussed)\b
  | \bimpossible\ (?:for\ me\ )?to\ (?:answer|help|comment|process|handle|fulfil)\b | \bil\ m['’]est\ impossible\b | \bme\ (?:es|resulta)\ imposible\b | \b(?:ist\ mir|mir\ ist\ es)\b[^.!?]*\b(?:nicht\ möglich|unmöglich)\b
  | \bje\ ne\ (?:peux|puis)\ pas\b | \bpas\ en\ mesure\ de\b | \bje\ (?:préfère|refuse)\b | \bil\ ne\ m['’]est\ pas\ (?:permis|possible)\b | \bje\ ne\ suis\ pas\ autorisé
  | \bno\ puedo\ (?:ayudar|responder|contestar|comentar|hablar|dar|ofrecer)\b | \bprefiero\ no\b | \bno\ me\ (?:está|es)\ (?:permitido|posible)\b | \bno\ estoy\ autorizad | \bme\ niego\b
  | \bich\b[^.!?]*\bnicht\ (?:beantworten|helfen|dazu|weiterhelfen|äußern|sagen)\b | \bdarf\ ich\b[^.!?]*\b(?:keine|nicht|nichts)\b | \bich\ darf\b[^.!?]*\b(?:keine|nicht|nichts)\b | \b(?:möchte|kann|will|werde)\ ich\b[^.!?]*\b(?:nicht|keine|nichts)\b | \bich\ (?:möchte|kann|will|werde)\b[^.!?]*\b(?:nicht|keine|nichts)\b
  | 无法(?:回答|提供|帮助|协助|讨论|回应) | 不能(?:回答|提供|帮助|协助|讨论|回应) | 不便(?:回应|回答|评论|透露) | 拒绝(?:回答|讨论) | 我不(?:想|愿|会)(?:意)?(?:回答|讨论)
    """,
    re.IGNORECASE | re.VERBOSE,
)
#: Words after which a sentence reports somebody else, or stresses a point, and does not decline.
NO_REFUSAL = re.compile(r"\b(?:authors?|they|he|she|prompts?|models?)\b[^.!?]*\b(?:say|said|refused|cannot)\b|\bcannot stress\b|\bcan['’]t stress\b", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|‘[^’]*’|`[^`]*`|「[^」]*」")
_SENTENCES = re.compile(r"(?<=[.!?。！？])\s*|\n+")

# --- fixed values: labels that stand before a copied question -------------------------------------
COPY_LABELS = (
    "question", "q", "user", "you asked", "you wrote", "you said", "your question", "your question was", "the question", "the question was", "prompt", "human", "asked", "query", "the user asked", "instruction",
    "frage", "ihre frage", "sie fragten", "nutzer", "votre question", "vous avez demandé", "utilisateur", "pregunta", "su pregunta", "tu pregunta", "usted preguntó", "usuario", "问题", "问", "用户", "您的问题", "你的问题", "您问", "你问",
)
_LABELS = sorted((tuple(words(x)) for x in COPY_LABELS), key=len, reverse=True)

_LETTER = re.compile(r"[^\W_]")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")
_MARKS = ".!?。！？…"
_CLOSERS = "\"'”’»)]}`*_」』）】"
_LIST = re.compile(r"^\s*(?:[-*•–+]|\(?\d{1,3}[.)]|[a-z]\))\s+\S")
_NAME = r"(?:[A-Z][\w’'-]*|\d[\d.,]*\s?%?)"
_SHORT = re.compile(
    rf"^(?:(?:(?:[Oo]n|[Ii]n|[Aa]t|[Bb]y|[Ww]ith|[Ss]ur|[Aa]uf|[Ee]n|[Mm]it|[Aa]bout|[Oo]nly)\s+)?{_NAME}(?:(?:\s*,\s*|\s+(?:and|or|und|et|y|vs)\s+){_NAME})*)$"
)
_SHORT_WORD = re.compile(r"^(?:yes|no|oui|non|ja|nein|sí|si|true|false|是|否|不是|对|both|neither)$", re.I)
_FORMULA = re.compile(r"^[^.!?]{0,60}[=≈<>≤≥∝]\s*[-+−]?[\w.^(\\][^!?]*$")
_ABBREVIATED = re.compile(r"(?:\bet al|\be\.g|\bi\.e|\bcf|\bvs|\b[Ff]ig|\b[Ee]q|\b[Ss]ec|\bNo|\bvgl|\bz\. ?B|\bp\. ?ej)\.$")


def is_empty(text: str | None) -> bool:
    """NULL, no letter or digit, or only a literal that stands for nothing."""
    return text is None or not _LETTER.search(text) or text.strip().lower() in EMPTY_LITERALS


def language(text: str) -> str | None:
    """The language by its script or its function words; None where too little speaks for any."""
    cjk = len(_CJK.findall(text))
    if cjk >= 2 and cjk * 3 >= len(re.findall(r"[a-z]+", text)):
        return "zh"
    votes: Counter = Counter()
    n = 0
    for w in words(text):
        by = _VOTES.get(w)
        if by:
            n += 1
            for k, v in by.items():
                votes[k] += v
    if not votes:
        return None
    top = votes.most_common(2)
    rest = top[1][1] if len(top) > 1 else 0.0
    return top[0][0] if top[0][1] >= 1 and top[0][1] >= 1.5 * rest else None


def requested_language(prompt: str) -> set[str]:
    """Languages that the prompt names."""
    low = prompt.lower()
    found = set()
    own = set(words(low))
    for lang, names in LANGUAGE_NAMES.items():
        for name in names.split():
            if (name in own) if name.isascii() or name[0] < "⺀" else (name in low):
                found.add(lang)
    return found


def dictionary_share(prompt: str, reply: str) -> float:
    """Compressed size of the reply with the prompt as dictionary, over its size without one."""
    raw = " ".join(words(reply)).encode()
    base = " ".join(words(prompt)).encode()
    if not raw or len(base) < 8:
        return 1.0
    held = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    with_dict = len(zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False).compress(raw))
    alone = len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(raw))
    return with_dict / max(alone, 1)


#: A copy compresses to no more than this share; what is left is checked word by word.
COPY_SHARE, SHORT_PROMPT = 0.75, 24


def is_copy(prompt: str, reply: str) -> bool:
    """Nothing but the prompt: repeated, labelled, quoted, in other case, spacing or punctuation.

    The zstandard share selects candidates; prompts under SHORT_PROMPT bytes, where the frame around
    the compressed text outweighs it, are compared at once.
    """
    p, r = words(prompt), words(reply)
    if not p or not r or len(r) < len(p):
        return False
    if len(" ".join(p)) >= SHORT_PROMPT and dictionary_share(prompt, reply) > COPY_SHARE:
        return False
    i, copies = 0, 0
    while i < len(r):
        if r[i : i + len(p)] == p:
            i += len(p)
            copies += 1
            continue
        for lab in _LABELS:
            if tuple(r[i : i + len(lab)]) == lab:
                i += len(lab)
                break
        else:
            return False
    return copies > 0


def is_refusal(reply: str) -> bool:
    """A sentence outside quotation marks declines to answer."""
    bare = _QUOTED.sub(" ", reply)
    if not REFUSALS.search(bare):
        return False
    return any(REFUSALS.search(s) and not NO_REFUSAL.search(s) for s in _SENTENCES.split(bare) if s)


def ending(reply: str) -> str:
    """The kind of a reply's end: ``closed``, ``broken``, ``short``, ``list`` or ``open``.

    ``closed`` and ``broken`` are settled by form. ``short`` (one unit of up to SHORT_WORDS words),
    ``list`` (an item) and ``open`` (a longer text that stops without a mark) are left to the
    terminal-context model.
    """
    text = reply.rstrip()
    if text.count("```") % 2:
        return "broken"
    if text.endswith("```"):
        return "closed"
    last = text.rsplit("\n", 1)[-1].strip()
    core = text.rstrip(_CLOSERS + " ")
    tail = core[-1:] if core else text[-1:]
    if any(text.count(a) + text.count(a2) > text.count(b) + text.count(b2) for a, a2, b, b2 in (("(", "（", ")", "）"), ("[", "【", "]", "】"))) and not re.search(r"[:;]-?\($", text):
        return "broken"
    if tail in _MARKS:
        if tail == "." and (_ABBREVIATED.search(core) or re.search(r"(?:^|\s)0\.$", core)):
            return "broken"
        if text.endswith(("...", "…")) and len(words(text)) > 2:
            return "broken"
        return "closed"
    if tail in ",;:-–—、，；：/&+(" or re.search(r"\b(?:the|a|an|of|and|or|to|with|for|by|in|on|at|der|die|das|und|mit|le|la|les|des|et|de|el|los|y|con)$", last):
        return "broken"
    unit = _units(last)[-1].strip()
    if _LIST.match(last):
        return "list"
    if _FORMULA.match(unit) and not re.search(r"[a-z]{4,} [a-z]{3,}", unit):
        return "closed"
    if re.match(r"^(?:see|cf|vgl|voir|véase|siehe)\b\.?\s*\(.*\)$", unit, re.I):
        return "closed"
    if unit == text and (_SHORT_WORD.match(unit) or _SHORT.match(unit)):
        return "closed"
    if re.match(r"^\s*\|.*\|$", last) or re.match(r"^\s{4,}\S", text.rsplit("\n", 1)[-1]):
        return "closed"
    return "short" if unit == text and len(words(text)) <= SHORT_WORDS and not _CJK.search(text) else "open"


_UNIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_RAW = re.compile(r"[^\W_]+")


def _units(line: str) -> list[str]:
    return [x for x in _UNIT.split(line) if x] or [line]


class _Shapes(dict):
    """Token -> how the model counts it: numbers as ``#``, coined names (with digits or capitals
    inside) as ``@``, other words in lower case."""

    def __missing__(self, token: str) -> str:
        if token.isdigit():
            shape = "#"
        elif token.isascii() and (any(c.isdigit() for c in token) or any(c.isupper() for c in token[1:])):
            shape = "@"
        else:
            shape = token.lower()
        self[token] = shape
        return shape


def contexts(reply: str, shapes: dict[str, str]) -> list[list[str]]:
    """The shapes of each unit's words; a unit ends at a sentence mark or a line's end."""
    out = []
    for line in reply.split("\n"):
        for unit in _units(line):
            if tokens := _RAW.findall(unit):
                out.append([shapes[t] for t in tokens])
    return out


def _examine(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    ids, defects, kinds, lasts, pairs = [], [], [], [], []
    shapes = _Shapes()
    for key, prompt, reply in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        defect, kind, last, pair = None, "closed", None, None
        prompt = prompt or ""
        if is_empty(reply):
            defect = "empty"
        elif is_copy(prompt, reply):
            defect = "copied_question"
        elif is_refusal(reply):
            defect = "refusal"
        else:
            a, b = language(reply), language(prompt)
            if a and b and a != b and a not in requested_language(prompt):
                defect = "other_language"
            else:
                kind = ending(reply)
                if kind in MIN_END_SHARE:
                    final = contexts(reply, shapes)[-1]
                    last, pair = final[-1], " ".join(final[-2:])
        ids.append(key)
        defects.append(defect)
        kinds.append(kind)
        lasts.append(last)
        pairs.append(pair)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (defects, kinds, lasts, pairs))], ["id", "defect", "kind", "last", "pair"])


def _count_ends(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """How often each word, and each two words, occur and end a unit."""
    total: Counter = Counter()
    final: Counter = Counter()
    shapes = _Shapes()
    for reply in batch.column(0).to_pylist():
        if not reply:
            continue
        units = contexts(reply, shapes)
        marked = reply.rstrip()[-1:] in _MARKS
        for i, unit in enumerate(units):
            two = [f"{a} {b}" for a, b in zip(unit, unit[1:], strict=False)] if len(unit) > 1 else []
            total.update(unit)
            total.update(two)
            if i < len(units) - 1 or marked:  # a last unit without a mark is in question
                final[unit[-1]] += 1
                if two:
                    final[two[-1]] += 1
    keys = list(total)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k] for k in keys], pa.int64()), pa.array([final[k] for k in keys], pa.int64())], ["context", "n", "n_end"])


#: A reply without a final mark breaks off where its last word ends a unit in under this share of its
#: places: a text that stopped amid sentences must end as texts usually do, a short unit or a list's
#: item breaks off only where hardly anything ends so. The share of a word is smoothed by one place at
#: PRESUMED (so a fragment that ends no other unit breaks off a text or a list at any count, but no
#: short answer), the share after the word before by BACKOFF places at the word's share.
MIN_END_SHARE = {"open": 0.2, "list": 0.02, "short": 0.002}
PRESUMED = {"open": 0.01, "list": 0.01, "short": 0.5}
BACKOFF = 20.0
#: A single unit of up to this many words may be a complete answer without a mark.
SHORT_WORDS = 6
CONTEXT_ROWS = 200_000


def reply_pairs(chat: DataFrame) -> DataFrame:
    """(id, prompt, reply): each assistant row directly after a user row of its session.

    Order is created_at (NULLs first), then id; roles are trimmed and lowered. One row per id.
    """
    rows = one_row_per(chat, "id", ["session_id", "created_at", "role", "content"]).withColumn("role", F.lower(F.regexp_replace(F.coalesce("role", F.lit("")), r"^\s+|\s+$", "")))
    seq = with_previous(rows, "session_id", ["created_at", "id"], ["role", "content"])
    return seq.where("role = 'assistant' and has_prev and prev_role = 'user'").select("id", F.col("prev_content").alias("prompt"), F.col("content").alias("reply"))


def pair_defects(pairs: DataFrame) -> DataFrame:
    """(id, defect) for each defective pair of ``pairs`` (id, prompt, reply); at most one defect.

    NULL and blank replies are ``empty``; a NULL prompt can have no copy and no language. Repeated
    rows give one result row. An empty input gives an empty result.
    """
    pairs = pairs.select("id", "prompt", "reply")
    seen = materialize(map_batches(pairs, _examine, "id long, defect string, kind string, last string, pair string"), "pairs")
    settled = seen.where("defect is not null").select("id", "defect")
    broken = seen.where("defect is null and kind = 'broken'").select("id", F.lit("truncated").alias("defect"))
    asked = seen.where("defect is null and kind in ('short', 'list', 'open')").select("id", "kind", "last", "pair")
    # Only the ends in question are looked up, but they are counted over all replies; where their
    # number allows, the others are left out before the shuffle.
    keys = asked.select(F.col("last").alias("context")).union(asked.select("pair")).distinct()
    counted = map_batches(pairs.select("reply"), _count_ends, "context string, n long, n_end long")
    model = counted.join(broadcast_if_small(keys, CONTEXT_ROWS), "context", "left_semi").groupBy("context").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    model = materialize(model, "ends")
    one = model.select(F.col("context").alias("last"), F.col("n").alias("n1"), F.col("n_end").alias("e1"))
    two = model.select(F.col("context").alias("pair"), F.col("n").alias("n2"), F.col("n_end").alias("e2"))
    none = F.lit(0)
    by_kind = lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in x.items() for y in kv]), F.col("kind"))
    share = (F.coalesce("e1", none) + by_kind(PRESUMED)) / (F.coalesce("n1", none) + 1)
    share = (F.coalesce("e2", none) + F.lit(BACKOFF) * share) / (F.coalesce("n2", none) + BACKOFF)
    cut = asked.join(one, "last", "left").join(two, "pair", "left").where(share < by_kind(MIN_END_SHARE)).select("id", F.lit("truncated").alias("defect"))
    return settled.unionByName(broken).unionByName(cut).distinct()


def p3_found(spark, sf_dir: str) -> DataFrame:
    from textloom.common import read

    return pair_defects(reply_pairs(read(spark, sf_dir, "chat_history")))

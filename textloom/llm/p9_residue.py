"""Problem 9: template residue and error-page text.

Method: documents are cut into sentences; each gets a 64-bit SimHash of its words with digits
masked. Sentences that a dictionary of residue forms covers carry a trusted label. Near-duplicates
of labelled sentences are found through SimHash tables partitioned into blocks of bits (two
hashes within ``DISTANCE`` bits agree in one of DISTANCE + 1 blocks) and, as texts of the required
similarity often lie further apart than that, through the prefixes of their hashed shingles: of two
sets with a Jaccard similarity of ``SIMILARITY`` or more, the n - ceil(SIMILARITY * n) + 1 least of
each have one in common, so no such pair is missed. Pairs are verified by text similarity, and
labels spread through the connected components they form. A placeholder inside a sentence labels its
document, but does not spread: the sentence around it is content.

Two kinds of seeds are learned instead of listed. Placeholder Latin need not be the known text: a line
without a function word of any language whose words nearly all resemble its vocabulary is filler. And
the pages that residue comes from hold more sentences than the listed ones: a sentence that recurs in
LEARN_DOCS documents and stands beside trusted residue in LEARN_SHARE of its places is residue too.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.common import ASCII_WORDS, broadcast_if_small, map_batches, materialize, read, words

DISTANCE, BLOCKS, BLOCK_BITS = 3, 4, 16
SHINGLE, SIMILARITY = 5, 0.8
LEARN_DOCS, LEARN_SHARE = 3, 0.8
#: Labelled sentences of one round that may be broadcast (64 bytes each and their texts).
FRONTIER_ROWS = 50_000

# --- fixed values: forms of unfilled placeholders ---------------------------------------------------
PLACEHOLDER = re.compile(
    r"""
    \{\{[^{}]{0,80}\}\} | \{%[^%]{0,80}%\} | <%[^%]{0,80}%> | \$\{[\w.\ ]{1,60}\} | \$[A-Z][A-Z_]{2,40}\$ | %[A-Z][A-Z_]{2,40}% | %\([\w.]+\)s
  | @@[\w.\ -]{1,60}@@ | (?<![\w_])__[A-Za-z][A-Za-z_]{1,40}__(?![\w_]) | \[\[[\w\ .-]{1,60}\]\] | <<[\w\ .-]{1,60}>> | (?<!\w)\{(?:\d{1,2}|[a-z_]+_[a-z_]+)\}(?!\w)
  | <\s*(?:your|insert|enter|add|author|title|name|date|venue|abstract|keywords?)\b[^<>]{0,60}> | &lt;\s*[A-Za-z_\ ]{2,60}&gt; | <[A-Z][A-Z_\ ]{2,40}>
  | \[\s*(?:insert|enter|your|add|author|title|name|first\ name|last\ name|date|venue|abstract|citation|reference|affiliation|e-?mail|company|placeholder|todo|tbd|fill)\b[^\[\]]{0,60}\]
  | \(\s*(?:add|insert|enter|fill\ in)\ (?:a\ |the\ |your\ )?(?:reference|citation|name|title|text|date|figure|table|number|value|abstract|author)s?\b[^()]{0,30}\)
  | \bTODO\b\s*[:(] | ^\W*TODO\W*$ | \bTBD\b | \bFIXME\b | \bXX+\.X+\s?% | (?<![\w.])X\.XX?\b | \bXXX+\b
    """,
    re.VERBOSE | re.IGNORECASE,
)
_CASED = re.compile(r"^(?:\$[a-z]|%[a-z(]|<[a-z]|x\.x|xx|\W*todo|tbd|fixme)")  # forms that count in capitals only
# --- fixed values: filler text ------------------------------------------------------------------------
FILLER = re.compile(
    r"\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur adipiscing\b|\b(?:asdf|qwerty|blah|foo|test|bla)(?:[ ,]+(?:asdf|qwerty|blah|foo|test|bla)){2,}\b|\b(?:x{3,}[ .]+){2,}x{3,}|\btext goes here\b|\b(?:this is (?:a |an |some )?)?(?:dummy|placeholder|filler|sample) (?:paragraph|text)\b|\breplace this (?:paragraph|text|section|sentence)\b|\bthis (?:paragraph|text|section) is (?:a )?placeholder\b|\byour (?:text|content|abstract) (?:goes )?here\b",
    re.IGNORECASE,
)
# --- fixed values: the vocabulary of placeholder Latin ---------------------------------------------------
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum"
#: A line of at least LATIN_WORDS words is filler where this share of them resembles that vocabulary: by
#: its first three letters or any four letters in a row.
LATIN_WORDS, LATIN_SHARE = 6, 0.85
_LATIN_HEADS = frozenset(w[:3] for w in LATIN.split())
_LATIN_RUNS = frozenset(w[i : i + 4] for w in LATIN.split() for i in range(len(w) - 3))
# --- fixed values: frequent function words; a line with one of them is no placeholder Latin -----------------
COMMON = frozenset("the of and to a in is that it for on with as are was be by this from at which not or an we each when if der die das und ist ein eine den dem des mit für auf von zu im le la les et est un une du que dans pour sur par el los las y es del en con no se al".split())
# --- fixed values: messages of error pages --------------------------------------------------------------
ERROR = re.compile(
    r"""
    ^\W*(?:error\ |erreur\ |fehler\ |http\ |status\ )?[45]\d\d\b\s*[:,–-]?\s*(?:(?:page|not|service|internal|bad|gateway|forbidden|unauthori[sz]ed|error|too|request|unavailable|the\ archive|cette\ page|seite|página)\b|$)
  | \b(?:page|file|article|paper|document|resource|url|record|content)\b[^.!?]{0,40}\b(?:not\ found|could\ not\ be\ found|cannot\ be\ found|does\ not\ exist|has\ been\ (?:withdrawn|moved|removed|deleted)|is\ (?:not\ available|unavailable|no\ longer\ available))\b
  | ^\W*(?:page\ |file\ )?not\ found\b | ^\W*access\ (?:to\ this\ \w+\ )?(?:is\ |was\ )?denied\b | \byour\ session\b[^.!?]*\b(?:expired|does\ not\ permit|timed\ out|has\ ended)\b | ^\W*(?:please\ )?(?:sign|log)\ in\ (?:again\ )?to\ (?:read|view|continue|see|access)\b
  | ^\W*bad\ gateway\b | ^\W*gateway\ time-?out\b | ^\W*internal\ server\ error\b | ^\W*service\ (?:temporarily\ )?unavailable\b | ^\W*forbidden\W*$ | ^\W*unauthori[sz]ed\W*$
  | \btoo\ many\ requests\b | \bslow\ down\ and\ retry\b | ^\W*(?:please\ )?(?:try|retry)\ again\ (?:later|in\b) | ^\W*(?:please\ )?(?:refresh|reload)\ the\ page\b | \bwe\ could\ not\ load\ this\b | \b(?:could\ not|failed\ to|unable\ to|cannot)\ (?:load|display|open|retrieve)\ (?:this|the)\ (?:abstract|page|paper|document|content|article|pdf)\b
  | \bserver\ returned\ an?\ (?:empty|invalid|error)\b | \b(?:archive|server|service|site)\ is\ temporarily\ (?:overloaded|unavailable|down)\b | \bdid\ not\ respond\ in\ time\b | \bnot\ available\ in\ your\ (?:region|country)\b | \bconfirm\ that\ you\ are\ (?:a\ person|human|not\ a\ robot)\b | \bverify\ (?:that\ )?you\ are\ (?:a\ )?human\b | \bsolving\ the\ puzzle\b
  | \bpdf\ conversion\ failed\b | \bno\ text\ layer\b | ^\W*traceback\ \(most\ recent\ call\ last\) | ^\W*file\ "[^"]+",\ line\ \d+ | ^\W*\w*(?:error|exception):\s\S | ^\W*request\ id\s*[:\ ]\s*[\w-]+\W*$ | ^\W*at\ [\w.$]+\([\w.]+:\d+\)
  | \bzugriff\ verweigert\b | \bseite\ (?:wurde\ )?nicht\ gefunden\b | \bwurde\ verschoben\ oder\ gelöscht\b | \bmelden\ sie\ sich\ an\b | \bsitzung\ ist\ abgelaufen\b
  | \bpage\ (?:est\ )?introuvable\b | \baccès\ refusé\b | \bsession\ a\ expiré\b | \bpágina\ no\ encontrada\b | \bacceso\ denegado\b | \bvuelva\ al\ inicio\b | \bsesión\ ha\ caducado\b
  | 页面(?:不存在|未找到|已被删除) | 访问被拒绝 | 服务器错误 | 已被删除
    """,
    re.VERBOSE | re.IGNORECASE,
)
# --- fixed values: notices that scripts or cookies are required -----------------------------------------
SCRIPT = re.compile(
    r"""
    \b(?:enable|activate|turn\ on|allow|requires?|needs?|without|disabled)\b[^.!?]{0,40}\b(?:javascript|scripts|scripting|cookies)\b | \b(?:javascript|scripts|scripting|cookies)\b[^.!?]{0,40}\b(?:disabled|required|turned\ off|must\ be\ enabled|not\ enabled|is\ off|are\ off)\b
  | \bscript-capable\ browser\b | \bbrowser\b[^.!?]{0,30}\b(?:blocks|does\ not\ support|has\ disabled)\b[^.!?]{0,20}\bscripts?\b | \bturn\ (?:them|it)\ on\ in\ your\ browser\b | \bsome\ parts\ of\b[^.!?]{0,60}\bwill\ not\ load\b
  | \bjavascript\b[^.!?]{0,30}\b(?:aktivieren|aktiviert|erforderlich)\b | \baktivieren\ sie\b[^.!?]{0,30}\bjavascript\b | \bactiver\ javascript\b | \bactive\ javascript\b | \bactivar\ javascript\b | \bhabilite\ javascript\b | (?:启用|开启|打开)\s*javascript
    """,
    re.VERBOSE | re.IGNORECASE,
)
# --- fixed values: strings of which one is in every form above; a sentence without one is content -------
ANCHORS = (
    "{{", "{%", "<%", "${", "%(", "@@", "__", "[[", "<<", "&lt;", "todo", "tbd", "fixme", "x.x", "xxx", "lorem", "dolor", "consectetur", "asdf", "qwerty", "blah", "foo foo", "foo, foo", "test test", "bla bla", "goes here", "text here", "content here", "abstract here", "dummy", "placeholder", "filler", "sample text", "sample para", "replace this",
    "{0", "{1", "{2", "{3", "{4", "{5", "{6", "{7", "{8", "{9", "[insert", "[enter", "[your", "[add", "[author", "[title", "[name", "[first", "[last", "[date", "[venue", "[abstract", "[citation", "[reference", "[affiliation", "[e-mail", "[email", "[company", "[fill", "[ ",
    "(add", "(insert", "(enter", "(fill", "( ", "<your", "<insert", "<enter", "<add", "<author", "<title", "<name", "<date", "<venue", "<abstract", "<keyword", "< ",
    "javascript", "scripts", "scripting", "cookies", "script-capable", "browser", "not load", "turn them", "turn it", "turn on", "turned off",
    "your session", "session a", "not found", "be found", "not exist", "withdrawn", "not available", "longer available", "unavailable", "been moved", "been removed", "been deleted", "denied", "gateway", "server returned", "server error", "server is", "service is", "site is", "archive is", "forbidden", "unauthori", "too many requests", "slow down", "again later", "again in", "again to", "sign in", "log in", "refresh the", "reload the", "not load", "to load", "cannot load", "not display", "to display", "not open", "to open", "not retrieve", "to retrieve", "not respond", "a person", "are human", "a human", "not a robot", "the puzzle",
    "conversion failed", "text layer", "traceback", 'file "', "error:", "error 4", "error 5", "fehler 4", "fehler 5", "erreur 4", "erreur 5", "http 4", "http 5", "status 4", "status 5", "exception:", ".java:", ".py:", ".js:", "request id", "verweigert", "gefunden", "gelöscht", "melden sie", "abgelaufen", "introuvable", "refusé", "expiré", "encontrada", "denegado", "vuelva", "caducado", "页面", "拒绝", "服务器", "删除",
)
#: Forms in capitals between percent, dollar or angle signs, and names in braces.
_LOOSE = re.compile(r"\$[A-Z][A-Z_]{2}|%[A-Z][A-Z_]{2}|\{[a-z_]+_[a-z_]+\}|<[A-Z][A-Z_ ]{2}")
# --- fixed values: sentences that write about such strings ---------------------------------------------
MENTION = re.compile(r"\b(?:with the slots?|slots? (?:named|called)|the strings? |stands? for|such as|error messages?|counts? as|similar leftovers|were removed from|are replaced (?:by|with)|reply of|log lines?|received the sentence|placeholders? (?:such|like|of))\b", re.I)
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”]{1,300}”|«[^»]{1,300}»|`[^`]{1,300}`|„[^“”]{1,300}[“”]|「[^」]{1,300}」")
_STOP, _FULL_STOP = re.compile(r"([.!?])\s+"), re.compile(r"([。！？])\s*")
#: For ASCII: letters in lower case and line ends stay, digits become 0, the rest a blank.
_MASK = ASCII_WORDS | {ord("\n"): "\n"} | {ord(c): "0" for c in "123456789"}
_DIGITS = re.compile(r"\d+")

_machine: ahocorasick.Automaton | None = None


def _anchored(text: str) -> bool:
    global _machine
    if _machine is None:
        _machine = ahocorasick.Automaton()
        for a in ANCHORS:
            _machine.add_word(a, a)
        _machine.make_automaton()
    return next(_machine.iter(text.lower()), None) is not None or (("$" in text or "%" in text or "{" in text or "<" in text) and _LOOSE.search(text) is not None)


def one_a_line(text: str) -> str:
    """The text with each sentence on a line of its own."""
    text = _STOP.sub(r"\1\n", text)
    return text if text.isascii() else _FULL_STOP.sub(r"\1\n", text)


def sentences(text: str) -> list[str]:
    return [s for x in one_a_line(text).split("\n") if (s := x.strip())]


def residue(sentence: str) -> tuple[str, bool] | None:
    """(kind, whether the residue is the sentence itself) or None; mentions are None."""
    if not _anchored(sentence):
        return None
    is_trace = re.match(r"^\W*file \"[^\"]+\", line \d+", sentence, re.I)
    bare = sentence if is_trace else _QUOTED.sub('""', sentence)
    if bare.count('"') % 2 and not is_trace:  # a quotation that the sentence's end cut off
        bare = bare.rsplit('"', 1)[0] if not bare.lstrip("* ").startswith('"') else bare
    if MENTION.search(bare):
        return None
    for m in PLACEHOLDER.finditer(bare):
        if not _CASED.match(m.group()):
            return "placeholder", False
    if FILLER.search(bare):
        return "filler", True
    if SCRIPT.search(bare):
        return "script", True
    if ERROR.search(bare):
        return "error", True
    return None


def is_latin(ws: list[str]) -> bool:
    """Whether a line's words are placeholder Latin, of the known words or of others like them."""
    if len(ws) < LATIN_WORDS or not COMMON.isdisjoint(ws):
        return False
    like = sum(w[:3] in _LATIN_HEADS or any(w[i : i + 4] in _LATIN_RUNS for i in range(len(w) - 3)) for w in ws)
    return like >= LATIN_SHARE * len(ws)


def masked(lines: str) -> list[list[str]]:
    """For each line, its words in lower case with every run of digits as 0."""
    if lines.isascii():
        lines = lines.translate(_MASK)
        while "00" in lines:
            lines = lines.replace("00", "0")
        return [x.split() for x in lines.split("\n")]
    return [words(x) for x in _DIGITS.sub("0", lines).split("\n")]


class _Codes(dict):
    """Word -> its 64-bit hash, made on first use."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


#: Byte -> its eight bits, one in each byte of a 64-bit word: sums of up to 255 add without carry.
_SPREAD_BITS = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None].repeat(8, axis=2) & np.array([1] + [0] * 7, dtype=np.uint8), axis=2, bitorder="little").reshape(256, 8).copy().view(np.uint64).ravel()


def word_codes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many each text has (an empty one has one empty word)."""
    texts = [ws or [""] for ws in texts]
    codes = list(map(_Codes().__getitem__, chain.from_iterable(texts)))
    return np.array(codes, dtype=np.uint64), np.array([len(ws) for ws in texts], dtype=np.int64)


def shingle_prefixes(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, how many of them each text has, distinct shingles of each text): the least 32-bit hashes
    of each text's shingles, as many as make texts of SIMILARITY or more share one."""
    if not len(n):
        return np.empty(0, dtype=np.int32), n, n
    starts = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        # A shingle's words add up by place; a text shorter than a shingle has its own words only.
        rows = np.maximum(n - (SHINGLE - 1), 1)
        owner = np.repeat(np.arange(len(n)), rows)
        at = starts[owner] + np.arange(len(owner)) - (np.cumsum(rows) - rows)[owner]
        h = np.zeros(len(owner), dtype=np.uint64)
        for i in range(SHINGLE):
            inside = i < n[owner]
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, a[np.minimum(at + i, len(a) - 1)], np.uint64(0))
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    owner = (both >> np.uint64(32)).astype(np.int64)
    distinct = np.bincount(owner, minlength=len(n))
    take = distinct - np.ceil(SIMILARITY * distinct - 1e-9).astype(np.int64) + 1
    keep = np.arange(len(both)) - (np.cumsum(distinct) - distinct)[owner] < take[owner]
    return (both[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), take, distinct


def simhashes(texts: list[list[str]]) -> np.ndarray:
    """64-bit SimHash of each list of words, over its pairs of neighbours and its first word."""
    return _simhashes(*word_codes(texts))


def _simhashes(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.empty(0, dtype=np.int64)
    starts = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        b = a * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([[np.uint64(0)], a[:-1]])
        b[starts] = a[starts]
        b ^= b >> np.uint64(32)
        b *= np.uint64(0xBF58476D1CE4E5B9)
        b ^= b >> np.uint64(29)
    # Parts of at most 255 features are summed bytewise, then the parts of each text.
    parts = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), parts)
    first = np.cumsum(parts) - parts
    at = starts[owner] + (np.arange(len(owner)) - first[owner]) * 255
    half = n[:, None]
    octets = b.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(n), 8), dtype=np.uint8)
    for i in range(8):
        sums = np.add.reduceat(_SPREAD_BITS[octets[:, i]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(sums, first, axis=0)
        out[:, i] = np.packbits(2 * total > half, axis=1, bitorder="little").ravel()
    return out.view(np.int64).ravel()


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    ids, kinds, spread, beside, texts = [], [], [], [], []
    for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        lines = one_a_line(text)
        own = masked(lines)
        # A text without anchors has no sentence with one.
        raw = lines.split("\n") if _anchored(text) else None
        all_found = [(residue(raw[i].strip()) if raw else None) or (("filler", True) if len(ws) >= LATIN_WORDS and COMMON.isdisjoint(ws) and is_latin(ws) else None) for i, ws in enumerate(own)]
        held = [i for i, ws in enumerate(own) if ws or all_found[i]]
        trusted = [bool(all_found[i] and all_found[i][1]) for i in held]
        for at, i in enumerate(held):
            ids.append(d)
            kinds.append(all_found[i][0] if all_found[i] else None)
            spread.append(trusted[at])
            beside.append(any(trusted[max(at - 1, 0) : at]) or any(trusted[at + 1 : at + 2]))
            texts.append(own[i])
    if not ids:
        return None
    codes = word_codes(texts)
    keys, many, shingles = shingle_prefixes(*codes)
    keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(keys))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(spread, pa.bool_()), pa.array(beside, pa.bool_()), pa.array(_simhashes(*codes), pa.int64()), keys, pa.array(shingles, pa.int32()), pa.array([" ".join(t) for t in texts], pa.string())],
        ["doc_id", "kind", "spread", "beside", "sim", "keys", "shingles", "text"],
    )


def _tables(sim: str, keys: str):
    """What two near texts have in common: a block of bits with its place, or a shingle of the prefixes (above 32 bits)."""
    blocks = [F.shiftrightunsigned(F.col(sim), BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1) + F.lit(i << BLOCK_BITS) for i in range(BLOCKS)]
    return F.concat(F.array(*blocks), F.transform(F.col(keys), lambda k: k.cast("long") + F.lit(1 << 40)))


def _shingles(text):
    """Distinct runs of five words; a shorter text is one shingle."""
    w = F.split(text, " ")
    return F.array_distinct(F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))).otherwise(F.array(text)))


def learned(cut: DataFrame) -> DataFrame:
    """The rows of ``cut`` whose sentence is residue by its company: see LEARN_DOCS and LEARN_SHARE.

    Only sentences that stand beside trusted ones are looked up, but all their places are counted.
    """
    plain = cut.where("kind is null")
    near = plain.where("beside").groupBy("text").agg(F.count_distinct("doc_id").alias("c")).where(F.col("c") >= LEARN_DOCS).select("text")
    near = materialize(near, "beside")
    places = materialize(plain.join(broadcast_if_small(near, FRONTIER_ROWS), "text"), "places")
    sure = places.groupBy("text").agg(F.avg(F.col("beside").cast("int")).alias("share")).where(F.col("share") >= LEARN_SHARE).select("text")
    return places.join(broadcast_if_small(sure, FRONTIER_ROWS), "text")


def residue_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, kind) for each document and kind of residue in it: placeholder, filler, error, script.

    NULL and empty texts have none; repeated rows count once; extra columns are dropped. An empty
    table gives an empty result.
    """
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    cut = materialize(map_batches(rows, _cut, "doc_id long, kind string, spread boolean, beside boolean, sim long, keys array<int>, shingles int, text string"), "sentences")
    company = learned(cut)
    out = cut.where("kind is not null").select("doc_id", "kind").unionByName(company.select("doc_id", F.lit("error").alias("kind")))
    same = [F.first(c).alias(c) for c in ("sim", "keys", "shingles")]  # the same for equal texts
    trusted = cut.where("spread").groupBy("text").agg(*same, F.min("kind").alias("kind"))
    frontier = materialize(trusted.unionByName(company.groupBy("text").agg(*same, F.lit("error").alias("kind"))), "trusted")
    done = frontier.select("text")
    others = cut.where("kind is null").select("sim", "keys", "shingles", "text", F.explode(_tables("sim", "keys")).alias("table"))
    while not frontier.isEmpty():
        near = frontier.select(F.col("sim").alias("f_sim"), F.col("shingles").alias("f_shingles"), F.col("text").alias("f_text"), "kind", F.explode(_tables("sim", "keys")).alias("table"))
        close = F.bit_count(F.col("sim").bitwiseXOR(F.col("f_sim"))) <= DISTANCE
        sized = F.least("shingles", "f_shingles") >= SIMILARITY * F.greatest("shingles", "f_shingles") - 1e-9
        hits = (
            others.join(broadcast_if_small(near, BLOCKS * FRONTIER_ROWS), "table")
            .where(sized & ((F.col("table") >= 1 << 32) | close))
            .groupBy("text", "f_text").agg(*same, F.min("kind").alias("kind"))
        )
        a, b = _shingles(F.col("text")), _shingles(F.col("f_text"))
        both = F.size(F.array_intersect(a, b))
        hits = hits.where(both >= SIMILARITY * (F.size(a) + F.size(b) - both))
        new = materialize(hits.groupBy("text").agg(*same, F.min("kind").alias("kind")).join(done, "text", "left_anti"), "labelled")
        if new.isEmpty():
            break
        out = out.unionByName(cut.where("kind is null").select("doc_id", "text").join(broadcast_if_small(new.select("text", "kind"), FRONTIER_ROWS), "text").select("doc_id", "kind"))
        done = done.unionByName(new.select("text"))
        frontier = new
    return out.distinct()


def p9_residue(spark, sf_dir: str) -> DataFrame:
    return residue_sentences(read(spark, sf_dir, "documents"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return p9_residue(spark, sf_dir).select("doc_id").distinct()

"""Problem 1: noise in text from scanned pages.

Method: words are counted over the whole corpus and grouped by their confusable-glyph skeleton; in
a group the frequent form that a misreading can have come from is chosen, by its context where
several could be; lines with their digits and names masked that recur between the words of passages are
running headers, wherever they stand (a few listed forms are known from the start); and the repaired
lines are reflowed into paragraphs with SQL windows.

The dictionary that the passes hold is the words of a share of at least ``SHARE`` of all words, so
it has at most 1 / SHARE entries whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.common import broadcast_if_small, map_batches, materialize, one_row_per, read

SHARE, LEAST = 5e-6, 5
#: A form is frequent against a misreading that it is this many times as common as.
TIMES = 8
#: A masked line is a learned header when this many chunks, and this share of all, have it amid a
#: sentence beside a blank line, and these are HEAD_TIMES of the chunks that have such a line anywhere.
#: So there are at most a line's share of 1 / HEAD_SHARE masks.
RECURS, HEAD_SHARE, HEAD_TIMES = 3, 2e-5, 0.3
#: Chunks with learned headers whose line numbers may be broadcast.
HEADER_ROWS = 50_000
#: A number is out of place between words that stand beside a number more rarely than this.
NUMBER_SHARE, NUMBER_SEEN = 0.003, 40

# --- fixed values: (right, misread) strings of letters and glyphs ----------------------------------------
CONFUSIONS = (
    ("m", "rn"), ("rn", "m"), ("in", "m"), ("m", "in"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("w", "vv"), ("vv", "w"), ("u", "ii"), ("ii", "u"), ("ti", "fi"), ("fi", "ti"), ("e", "c"), ("c", "e"), ("i", "l"), ("l", "i"),
    ("l", "1"), ("l", "|"), ("l", "!"), ("l", "¡"), ("i", "1"), ("i", "|"), ("i", "!"), ("i", "¡"), ("i", "í"), ("o", "0"), ("s", "5"), ("s", "$"), ("g", "9"), ("q", "9"), ("b", "8"), ("b", "6"), ("a", "ɑ"), ("a", "@"), ("t", "†"), ("t", "+"), ("t", "7"), ("z", "2"), ("e", "~"), ("e", "€"), ("c", "¢"), ("e", "ε"), ("o", "ο"), ("u", "µ"), ("n", "η"), ("v", "ν"),
)
# --- fixed values: first parts that may stand with a suspended hyphen ----------------------------------------
PREFIXES = frozenset("pre post non sub inter intra micro macro multi semi over under short long mid high low left right up down in out one two three single double self co re".split())
#: Glyph -> what it shares with its confusables; the longer strings of a letter come out the same.
SKELETON = str.maketrans(
    {"l": "i", "1": "i", "|": "i", "!": "i", "¡": "i", "í": "i", "r": "i", "e": "c", "~": "c", "€": "c", "¢": "c", "ε": "c", "d": "ci", "h": "ii", "u": "ii", "µ": "ii", "m": "in", "w": "vv", "ν": "v", "f": "t", "†": "t", "+": "t", "7": "t", "0": "o", "ο": "o", "5": "s", "$": "s", "9": "g", "q": "g", "8": "b", "6": "b", "2": "z", "ɑ": "a", "@": "a", "η": "n"}
)
_GLYPHS = re.escape("".join(sorted({c for _, bad in CONFUSIONS for c in bad if not ("a" <= c <= "z")})))
_HYPHENS = "\\-‐‑\u00ad¬"

# --- fixed values: forms of page numbers and of running headers -------------------------------------------
_ROMAN = r"(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE_STRONG = r"(?:\[\s?(?:page|p\.|pg\.?)\s?\d{1,4}\s?\]|(?:Page|page|PAGE)\s\d{1,4}\s(?:of|/)\s\d{1,4}|\d{1,4}\s\|\sP\sa\sg\se|\d{1,4}\s\|\sPage|[—–~]\s?\d{1,4}\s?[—–~]|(?<!\S)-\s\d{1,4}\s-(?!\S))"
_PAGE_WEAK = rf"(?:\d{{1,4}}/\d{{1,4}}|pp?\.\s?\d{{1,4}}|(?:Page|page)\s\d{{1,4}}|\d{{1,4}}|{_ROMAN})"
_SPACED_CAPS = r"(?:[A-Z]\s){3,}[A-Z](?:\s{2,}(?:[A-Z]\s)+[A-Z])*(?![A-Za-z])"
_HEAD = (
    rf"(?:Preprint\.?\s(?:Under\sreview|Submitted|Accepted|Work\sin\sprogress)[^\n.]{{0,60}}?\b\d{{4}}\.?"
    rf"|(?:[A-Z][\w-]+\s){{1,4}}?(?:Letters|Journal|Transactions|Review|Proceedings|Bulletin|Annals),?\s[Vv]ol\.\s?\d+,\s[Nn]o\.\s?\d+(?:,\s\d{{4}})?"
    rf"|Draft\sof\s\d{{1,2}}\s[A-Z][a-z]+\s\d{{4}}(?:\s-\snot\sfor\s[a-z]+)?"
    rf"|(?:In\s)?Proceedings\sof\sthe\s\d+(?:st|nd|rd|th)\s[A-Z][\w-]+\son\s[A-Z][\w -]{{2,60}}?,\s\d{{4}}"
    rf"|{_SPACED_CAPS}"
    rf"|[A-Z][A-Z-]+\sAND\s[A-Z][A-Z-]+:\s[A-Z0-9][A-Z0-9 :,-]{{8,}}[A-Z0-9](?![a-z])"
    rf"|(?<!\S)[A-Z][^.!?\n|]{{8,60}}?\s{{2,}}\|\s{{2,}}[A-Z][\w-]+)"
)
_ET_AL = r"[A-Z][a-z]+\set\sal\."
_BOTH = rf"(?:(?:{_PAGE_STRONG}|{_PAGE_WEAK})\s{{2,}})?{_HEAD}(?:\s{{2,}}(?:{_PAGE_STRONG}|{_PAGE_WEAK})(?!\S))?"
PAGE_LINE = re.compile(rf"^\s*(?:{_PAGE_STRONG}|{_PAGE_WEAK})\s*$")
PAGE_LINE_STRONG = re.compile(rf"^\s*(?:{_PAGE_STRONG}|\d{{1,4}}/\d{{1,4}}|pp?\.\s?\d{{1,4}})\s*$")
HEADER_LINE = re.compile(rf"^\s*(?:{_BOTH}|(?:(?:{_PAGE_STRONG}|{_PAGE_WEAK})\s{{2,}})?{_ET_AL}(?:\s{{2,}}(?:{_PAGE_STRONG}|{_PAGE_WEAK}))?)\s*$")
ET_AL_INLINE = re.compile(rf"(?<=[a-z0-9,.)])[^\S\n]+((?:(?:{_PAGE_STRONG}|{_PAGE_WEAK})\s{{2,}})?{_ET_AL}(?:\s{{2,}}(?:{_PAGE_STRONG}|{_PAGE_WEAK}))?)(?=[^\S\n]+[a-z0-9])")
_CAPS_GATE = re.compile(r"[A-Z]\s[A-Z]\s[A-Z]\s")
HEADER_INLINE = re.compile(rf"(?<=\S)\s+({_BOTH})(?=\s+\S)")
PAGE_INLINE = re.compile(rf"(?<=\S)[^\S\n]+({_PAGE_STRONG})(?=[^\S\n]+\S)")
PAGE_INLINE_WEAK = re.compile(rf"(?<=[a-z,])\s+(\d{{1,3}}/\d{{1,3}}|p\.\s?\d{{1,4}}|(?=[ivxlc]{{2}}){_ROMAN})(?=\s+[a-z0-9(])")
NUMBER_INLINE = re.compile(r"(?<![\w.,/(|=*+^-])([A-Za-z]+)\s+(\d{1,3})\s+([a-z]+)(?![\w/])")
#: Lines of lists, headings, code and tables: numbers belong there.
_NO_PROSE = re.compile(r"^\s*(?:[-*•]|\(?\d{1,2}[.)]|[A-Z]\.|\d+(?:\.\d+)*\s+[A-Z])\s*\S|^\s{4,}\S|\||\t|\S\s{3,}\S")
HYPHEN = re.compile(rf"(?<=\w)[{_HYPHENS}]\s+(?=[^\W_])")
_LEFT = re.compile(rf"[^\W\d_][{_GLYPHS}\w]*$")
_RIGHT = re.compile(rf"[^\W_]+[{_GLYPHS}\w]*")
_SPACED_GATE = re.compile(r" [a-z]\s[a-z][ .,;:]")
SPACED = re.compile(r"(?<!\S)((?:[A-Za-z]\s)?(?:[a-z]\s){2,}[a-z])(?![^\s.,;:!?)])")
_TOKEN = re.compile(rf"[^\W_]+(?:[{_GLYPHS}]+[^\W_]*)*|[{_GLYPHS}]+[^\W_]+(?:[{_GLYPHS}]+[^\W_]*)*")
#: Punctuation around words becomes a blank.
_BLANK = {ord(c): " " for c in ".,;:()[]{}\"“”'’‘*`?"}
_DIGITS = re.compile(r"\d+")


def skeleton(word: str) -> str:
    return word.lower().translate(SKELETON)


def derivable(right: str, seen: str) -> bool:
    """Whether ``seen`` comes from ``right`` by one or more of CONFUSIONS."""
    stack, seen_states = [(0, 0, False)], set()
    while stack:
        state = stack.pop()
        if state in seen_states:
            continue
        seen_states.add(state)
        i, j, changed = state
        if i == len(right) and j == len(seen):
            if changed:
                return True
            continue
        for a, b in CONFUSIONS:
            if right.startswith(a, i) and seen.startswith(b, j):
                stack.append((i + len(a), j + len(b), True))
        if i < len(right) and j < len(seen) and right[i] == seen[j]:
            stack.append((i + 1, j + 1, changed))
    return False


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Tokens of letters (compounds whole and in parts) with how often a number follows or precedes."""
    n: Counter = Counter()
    follows: Counter = Counter()
    precedes: Counter = Counter()
    total = 0
    for text in batch.column(1).to_pylist():
        tokens = text.translate(_BLANK).split()
        total += len(tokens)
        n.update(tokens)
        for a, b in zip(tokens, tokens[1:], strict=False):
            if b and b[0].isdigit():
                if b.isdigit():
                    follows[a] += 1
            elif a and a.isdigit():
                precedes[b] += 1
    for t in [t for t in n if "-" in t]:
        for part in t.split("-"):
            n[part] += n[t]
    keys = ["", *(t for t in n if t and t[0].isalpha())]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([skeleton(k) for k in keys], pa.string()), pa.array([total, *(n[k] for k in keys[1:])], pa.int64()), pa.array([follows[k] for k in keys], pa.int64()), pa.array([precedes[k] for k in keys], pa.int64())],
        ["word", "skeleton", "n", "follows", "precedes"],
    )


class Lexicon:
    """The frequent words: plain ones by their skeleton, and where numbers are out of place."""

    def __init__(self, rows: list, least: int):
        self.words = {w for w, *_ in rows}
        self.by_skeleton: dict[str, list[tuple[int, str]]] = defaultdict(list)
        self.rare_before: set[str] = set()
        self.rare_after: set[str] = set()
        for w, s, n, f, p in rows:
            if w.isalpha() and w.islower() and w.isascii() and len(w) > 2 and n >= 2 * least:
                self.by_skeleton[s].append((n, w))
            if w.isalpha() and n >= NUMBER_SEEN:
                if f < NUMBER_SHARE * n:
                    self.rare_before.add(w)
                if p < NUMBER_SHARE * n and w.islower():
                    self.rare_after.add(w)
        count = {w: n for w, _, n, _, _ in rows}
        for forms in self.by_skeleton.values():
            forms.sort(reverse=True)
        # A form of the dictionary that is a misreading of one far more frequent is none. A word with
        # a capital may be a name; it is a misreading where it is one without the capital.
        misread: set[str] = set()
        for capital in (False, True):
            for w, s, n, *_ in rows:
                low = w.lower()
                if len(w) > 2 and capital == (w.isalpha() and w.isascii() and w != low) and (low in misread if capital else low == w or low not in count):
                    if any(m >= TIMES * n and v != low and derivable(v, low) for m, v in self.by_skeleton.get(s, ())):
                        misread.add(w)
        self.words -= misread
        self.misread = misread
        for forms in self.by_skeleton.values():
            forms[:] = [(n, w) for n, w in forms if w in self.words]
        self.count = count
        self.unclear = {s for s, forms in self.by_skeleton.items() if len(forms) > 1}
        #: form -> words seen before it, for skeletons of several forms (see ``with_context``).
        self.context: dict[str, Counter] = {}

    def ambiguous(self) -> set[str]:
        return {w for forms in self.by_skeleton.values() if len(forms) > 1 for _, w in forms}

    def right(self, seen: str, before: str = "") -> str | None:
        """The frequent form that ``seen`` is a misreading of."""
        if seen in self.words:
            return None
        low = seen.lower()
        if low in self.words or len(low) < 3:
            return None
        forms = [(n, w) for n, w in self.by_skeleton.get(low.translate(SKELETON), ()) if derivable(w, low)]
        if not forms:
            return None
        if len(forms) > 1:
            forms.sort(key=lambda x: (self.context.get(x[1], Counter())[before.lower()], x[0]), reverse=True)
        return forms[0][1]

    def known(self, word: str) -> bool:
        return word in self.words or word.lower() in self.words


def lexicon(rows: DataFrame) -> Lexicon:
    """Counted over all rows; at most 1 / SHARE words reach the driver."""
    counted = map_batches(rows, _count, "word string, skeleton string, n long, follows long, precedes long")
    table = materialize(counted.groupBy("word").agg(F.first("skeleton").alias("skeleton"), *[F.sum(c).alias(c) for c in ("n", "follows", "precedes")]), "words")
    total = (table.where("word = ''").select("n").first() or [0])[0]
    least = max(LEAST, int(SHARE * total))
    lex = Lexicon([tuple(r) for r in table.where((F.col("word") != "") & (F.col("n") >= least)).collect()], least)
    forms = lex.ambiguous()
    if forms:

        def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter = Counter()
            for text in batch.column(1).to_pylist():
                if not forms.isdisjoint(tokens := text.translate(_BLANK).split()):
                    seen.update((a.lower(), b) for a, b in zip(tokens, tokens[1:], strict=False) if b in forms)
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["before", "form", "n"])

        # Contexts of a share as above are enough to tell forms apart; their number is bounded too.
        for r in map_batches(rows, pairs, "before string, form string, n long").groupBy("before", "form").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect():
            lex.context.setdefault(r["form"], Counter())[r["before"]] = r["n"]
    return lex


def _prose(line: str, least: int = 3) -> bool:
    return len(re.findall(r"[^\W\d_]{2,}", line)) >= least


class Repair:
    """The damage of one text, and its lines without it."""

    def __init__(self, text: str, lex: Lexicon, heads: list[int] | None = None, forms: HeaderForms | None = None):
        self.noise: set[str] = set()
        self.lex = lex
        self.forms = forms
        lines = text.replace("\r\n", "\n").split("\n")
        kinds = [self._kind(x) for x in lines]
        for i in heads or ():  # learned headers
            kinds[i] = "header"
        self._between(lines, kinds)
        body = "\n".join(x for x, k in zip(lines, kinds, strict=True) if k == "text")
        body = self._inline(body)
        body = self._hyphens(body)
        if _SPACED_GATE.search(body):
            body = SPACED.sub(self._spaced, body)
        body = self._words(body)
        self.lines = body.split("\n")

    @staticmethod
    def _kind(line: str) -> str:
        s = line.strip()
        if not s:
            return "blank"
        if len(s) <= 24 and PAGE_LINE.match(line):
            return "page"
        if len(s) >= 7 and HEADER_LINE.match(line):
            return "header"
        return "text"

    def _between(self, lines: list[str], kinds: list[str]) -> None:
        """Settles which page numbers and headers stand between the words of the passage."""
        n = len(lines)
        for i in range(n):
            if kinds[i] not in ("page", "header"):
                continue
            before = next((j for j in range(i - 1, -1, -1) if kinds[j] == "text"), None)
            after = next((j for j in range(i + 1, n) if kinds[j] == "text"), None)
            inside = before is not None and after is not None
            if kinds[i] == "page" and not PAGE_LINE_STRONG.match(lines[i]):
                # A bare number or numeral may be a cell of a table or a number of a list.
                inside = inside and _prose(lines[before], 2) and _prose(lines[after], 2) and lines[before].rstrip()[-1:] not in ":|"
                inside = inside and not (before == i - 1 and after == i + 1 and lines[before].rstrip()[-1:] in ".!?")
            if inside:
                self.noise.add("header" if kinds[i] == "header" else "page_number")
                if kinds[i] == "header" and re.search(rf"^\s*(?:{_PAGE_STRONG}|{_PAGE_WEAK})\s{{2,}}|\s{{2,}}(?:{_PAGE_STRONG}|{_PAGE_WEAK})\s*$", lines[i]):
                    self.noise.add("page_number")
            elif kinds[i] == "page" or before is not None or after is not None:
                kinds[i] = "text" if kinds[i] == "page" and not PAGE_LINE_STRONG.match(lines[i]) else kinds[i]
        # A blank line beside noise came with it.
        for i in range(n):
            if kinds[i] == "blank":
                near = {kinds[j] for j in (i - 1, i + 1) if 0 <= j < n}
                kinds[i] = "drop" if near & {"page", "header"} else "text"

    def _inline(self, body: str) -> str:
        def header(m: re.Match) -> str:
            self.noise.add("header")
            s = m.group(1)
            if re.search(rf"^(?:{_PAGE_STRONG}|{_PAGE_WEAK})\s{{2,}}|\s{{2,}}(?:{_PAGE_STRONG}|{_PAGE_WEAK})$", s):
                self.noise.add("page_number")
            return ""

        def page(m: re.Match) -> str:
            self.noise.add("page_number")
            return ""

        if "   " in body or "Preprint" in body or "Letters" in body or "Vol." in body or "Draft of" in body or "Proceedings" in body or " AND " in body or _CAPS_GATE.search(body):
            body = HEADER_INLINE.sub(header, body)
        if "et al. " in body:
            body = ET_AL_INLINE.sub(header, body)
        if self.forms is not None:
            for form in self.forms.near(body):
                body = form.sub(header, body)
        if "[" in body or "age " in body or "|" in body or "—" in body or "~" in body or "–" in body or " - " in body:
            body = PAGE_INLINE.sub(page, body)

        def weak(m: re.Match) -> str:
            if m.group(1).isalpha() and self.lex.known(m.group(1)):
                return m.group()
            return page(m)

        def number(m: re.Match) -> str:
            if m.group(1) in self.lex.rare_before and m.group(3) in self.lex.rare_after:
                self.noise.add("page_number")
                return f"{m.group(1)} {m.group(3)}"
            return m.group()

        def prose(block: str) -> str:
            return NUMBER_INLINE.sub(number, PAGE_INLINE_WEAK.sub(weak, block))

        if "\n" not in body.strip():
            return prose(body)
        if not any(c.isdigit() for c in body) and not PAGE_INLINE_WEAK.search(body):
            return body
        out, block, code = [], [], False
        for line in body.split("\n"):
            fence = line.lstrip().startswith("```")
            code ^= fence
            if code or fence or not _prose(line, 4) or _NO_PROSE.search(line):
                if block:
                    out.append(prose("\n".join(block)))
                    block = []
                out.append(line)
            else:
                block.append(line)
        return "\n".join([*out, prose("\n".join(block))] if block else out)

    def _hyphens(self, body: str) -> str:
        lex = self.lex

        def join(a: str, mark: str, b: str) -> str | None:
            if b.lower() in ("and", "or", "to", "und", "et", "y") and not lex.known(a + b):
                return None
            whole = a + b
            if lex.known(whole):
                self.noise.add("hyphenation")
                return whole
            right = lex.right(whole)
            if right:
                self.noise |= {"hyphenation", "misread"}
                return right
            if a.lower() in PREFIXES:
                return None
            if mark not in "\u00ad¬":
                if lex.known(f"{a}-{b}") or (lex.known(a) and lex.known(b)) or not b[:1].islower():
                    return None
                x, y = lex.right(a), lex.right(b)
                if (x or lex.known(a)) and (y or lex.known(b)):  # a compound with a misread part
                    return None
            self.noise.add("hyphenation")
            return whole

        out, at = [], 0
        for m in HYPHEN.finditer(body):
            left = _LEFT.search(body, max(at, m.start() - 60), m.start())
            right = _RIGHT.match(body, m.end())
            if left and right and left.start() >= at and (whole := join(left.group(), m.group()[0], right.group())):
                out += [body[at : left.start()], whole]
                at = right.end()
        return "".join([*out, body[at:]]) if out else body

    def _spaced(self, m: re.Match) -> str:
        lex = self.lex
        whole = m.group(1).replace(" ", "").replace("\n", "")
        if len(whole) < 3:
            return m.group()
        if lex.known(whole) or lex.right(whole):
            self.noise.add("misread")
            return whole if lex.known(whole) else lex.right(whole) or whole
        for i in range(2, len(whole) - 1):
            if lex.known(whole[:i]) and lex.known(whole[i:]):
                self.noise.add("misread")
                return f"{whole[:i]} {whole[i:]}"
        if len(whole) >= 6 and " " not in m.group(1).replace(" ", "", 1).strip() + "x":
            self.noise.add("misread")
            return whole
        return m.group()

    def _words(self, body: str) -> str:
        lex = self.lex
        swaps: dict[str, str] = {}
        plain = body.translate(_BLANK)
        for w in set(plain.split()) - lex.words:
            if w.isdigit():
                continue
            for part in _TOKEN.findall(w):
                if part in swaps or part in lex.words or part[1:].lower() != part[1:]:
                    continue
                if not any("a" <= c <= "z" or c in "ɑ†" for c in part):
                    continue
                before = ""
                if lex.context and part.translate(SKELETON) in lex.unclear:
                    before = (re.findall(rf"(\S+)\s+{re.escape(part)}", plain) or [""])[0]
                right = lex.right(part, before) or (lex.right(part.rstrip("!|+"), before) if len(part) > 4 else None)
                if right and not (part.isalpha() and part.isascii() and part[0].isupper() and lex.count.get(part, 0) >= LEAST and part not in lex.misread):
                    swaps[part] = right.capitalize() if part[0].isupper() else right
        if not swaps:
            return body
        self.noise.add("misread")
        return re.sub(r"[^\s]+", lambda m: self._swap(m.group(), swaps), body)

    @staticmethod
    def _swap(token: str, swaps: dict[str, str]) -> str:
        return _TOKEN.sub(lambda m: swaps.get(m.group(), m.group()), token)


MASKS = "chunk_id string, line_no int, mask string, mid boolean"
_MASKED = re.compile(r"\d+|[^\W\d_][\w'’-]*")


def mask(line: str) -> str:
    """A line with its numbers as # and its names as @: words in capitals, and words with a capital but
    the first. Names in a row are one."""
    first = True

    def one(m: re.Match) -> str:
        nonlocal first
        word, lead = m.group(), first
        first = False
        if word[0].isdigit():
            return "#"
        return "@" if word[0].isupper() and (not lead or word.isupper()) else word

    return re.sub(r"@(?:\s+@)+", "@", _MASKED.sub(one, " ".join(line.split())))


class HeaderForms:
    """Learned masks as patterns of what stands amid a sentence, after line breaks have become blanks.

    Only masks with words of their own are used inline; a search for these words comes first.
    """

    def __init__(self, masks: list[str]):
        self.by_word: dict[str, list[re.Pattern]] = defaultdict(list)
        for m in masks:
            words = [w for w in re.findall(r"[^\W\d_]{4,}", m)]
            if not words:
                continue
            parts = [{"#": r"\d+", "@": r"[^\W\d_a-z][\w'’.-]*(?:\s+[^\W\d_a-z][\w'’.-]*){0,5}", " ": r"\s+"}.get(x) or re.escape(x) for x in re.findall(r"#|@|\s|[^#@\s]+", m)]
            form = rf"(?<=[a-z0-9,)])\s+((?:(?:{_PAGE_STRONG}|{_PAGE_WEAK})\s+)?{''.join(parts)}(?:\s+(?:{_PAGE_STRONG}|{_PAGE_WEAK})(?!\S))?)(?=\s+[a-z(])"
            self.by_word[max(words, key=len)].append(re.compile(form))

    def near(self, body: str) -> list[re.Pattern]:
        return [f for w, fs in self.by_word.items() if w in body for f in fs]


def _masks(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """MASKS of the raw lines that stand between lines of words; ``mid`` where such a line, beside a
    blank one, breaks a sentence."""
    out: list[tuple] = []
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        lines = text.replace("\r\n", "\n").split("\n")
        if len(lines) < 3:
            continue
        # Page numbers and listed headers may stand beside.
        texts = [i for i, x in enumerate(lines) if Repair._kind(x) == "text"]
        for a, i, b in zip(texts, texts[1:], texts[2:], strict=False):
            s, before, after = lines[i].strip(), lines[a].rstrip(), lines[b].lstrip()
            if s[:1].isupper() and len(s) <= MASK_LENGTH and len(s.split()) >= 3 and _prose(s, 2) and _prose(before, 2) and _prose(after, 2):
                blank = not lines[i - 1].strip() or not lines[i + 1].strip()
                out.append((key, i, mask(s), blank and _prose(before, 4) and before[-1] not in ".:;!?" and after[:1].islower()))
    if not out:
        return None
    types = [pa.string(), pa.int32(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in MASKS.split(", ")])


#: A running header is no longer than this; a page has no room for more.
MASK_LENGTH = 160


def learned(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """((chunk_id, heads), masks): the numbers of the lines with the masks of learned headers, and these
    masks, of which there are few (see HEAD_SHARE)."""
    masks = materialize(map_batches(rows, _masks, MASKS), "masks")
    least = max(RECURS, int(HEAD_SHARE * rows.count()))
    per = masks.groupBy("mask").agg(F.count_distinct(F.when(F.col("mid"), F.col("chunk_id"))).alias("c"), F.count_distinct("chunk_id").alias("n"))
    headers = materialize(per.where((F.col("c") >= least) & (F.col("c") >= HEAD_TIMES * F.col("n"))).select("mask"), "masks")
    heads = masks.join(headers, "mask").groupBy("chunk_id").agg(F.collect_set("line_no").alias("heads"))
    return materialize(heads, "headers"), sorted(r["mask"] for r in headers.collect())


LINES = "chunk_id string, line_no int, line string, noise array<string>"


def scan(rows: DataFrame) -> DataFrame:
    """LINES of every chunk that has damage; the noise that was found stands on line 0."""
    lex = rows.sparkSession.sparkContext.broadcast(lexicon(rows))  # at most 1 / SHARE words
    heads, masks = learned(rows)
    forms = rows.sparkSession.sparkContext.broadcast(masks)
    rows = rows.join(broadcast_if_small(heads, HEADER_ROWS), "chunk_id", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[tuple] = []
        inline = HeaderForms(forms.value) if forms.value else None
        for key, text, heads in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            r = Repair(text, lex.value, heads, inline)
            if r.noise:
                out += [(key, i, x, sorted(r.noise) if i == 0 else []) for i, x in enumerate(r.lines)]
        if not out:
            return None
        types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in LINES.split(", ")])

    return map_batches(rows.select("chunk_id", "chunk_text", "heads"), run, LINES)


def chunk_rows(df: DataFrame) -> DataFrame:
    """One row per chunk_id; NULL ids and texts are left out."""
    return materialize(one_row_per(df.where("chunk_text is not null"), "chunk_id", ["chunk_text"]), "chunks")


def noise_kinds(df: DataFrame) -> DataFrame:
    """(chunk_id, noise) for each chunk of ``df`` (chunk_id, chunk_text) and kind of damage found:
    hyphenation, misread, header, page_number.

    NULL and empty texts have none; repeated rows count once; an empty table gives none.
    """
    return scan(chunk_rows(df)).select("chunk_id", F.explode("noise").alias("noise")).distinct()


def repaired(df: DataFrame) -> DataFrame:
    """(chunk_id, chunk_text): the damaged chunks as continuous paragraphs.

    Lines join the one before unless a paragraph begins: after a blank line, at a list item, a
    heading, a table row or code. The windows are over the lines of one chunk.
    """
    lines = materialize(scan(chunk_rows(df)), "lines")
    body = lines.select("chunk_id", "line_no", F.regexp_replace("line", r"\s+$", "").alias("line"))
    w = Window.partitionBy("chunk_id").orderBy("line_no")
    item = F.col("line").rlike(r"^\s*(?:[-*•]|\(?\d{1,2}[.)]|[A-Z]\.|\d+(?:\.\d+)*\s+[A-Z])\s*\S|^\s{4,}\S|^```|^\s*\|")
    short = (F.size(F.split(F.trim("line"), r"\s+")) <= 3) & ~F.col("line").rlike(r"[.,;]$")
    body = body.withColumns({"item": item, "short": short, "blank": F.trim("line") == ""})
    body = body.withColumns({"p_blank": F.lag("blank", 1, True).over(w), "p_short": F.lag("short", 1, False).over(w)})
    fresh = F.col("p_blank") | F.col("item") | (F.col("short") & F.col("p_short")) | F.col("line").rlike(r"^[A-Z]") & F.col("p_short")
    body = body.where("not blank").withColumn("para", F.sum(fresh.cast("int")).over(w))
    paras = body.groupBy("chunk_id", "para").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), " ").alias("p"))
    return paras.groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para", "p"))), lambda x: x["p"]), "\n\n").alias("chunk_text"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return noise_kinds(read(spark, sf_dir, "chunk_embeddings"))


def p1_repaired(spark, sf_dir: str) -> DataFrame:
    return repaired(read(spark, sf_dir, "chunk_embeddings"))

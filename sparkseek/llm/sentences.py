"""Sentence units of documents in many scripts, by a pushdown automaton.

Lines are first told apart: fenced code has no units; headings, commit titles and
quoted lines are one unit each; list items and paragraphs are texts to be split.
In a text the automaton keeps a stack of open quotations and brackets. A mark at
depth 0 ends a unit unless an abbreviation, number, initial or ellipsis speaks
against it; a mark inside a closed pair ends one only if what follows can't go
on with the sentence. Abbreviations are read backwards from the mark in a trie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codefiles import spread

# Abbreviations by what may follow them.
NEVER_END = """dr prof mr mrs ms messrs st jr sr hon gen col lt sgt capt rev mt cf vs e.g i.e viz approx al et ca bzw mio mrd tsd evtl ggf inkl exkl
bspw vgl z. b z.b u. a u.a d. h d.h s. o o. ä u. ä i. d. r env aprox sra srta dra dña ud uds p. ej p.ej p. ex p.ex mme mlle mm डॉ श्री प्रो""".split("\n")
MAYBE_END = "a.m p.m etc inc ltd co corp u.s u.k e.u mon tue tues wed thu thurs fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec usw gmbh bros est dept"
BEFORE_NUMBER = "no nos nr fig figs sec secs eq eqs ch chap vol pp p pág núm art abschn abb kap s bd n° pt ver rev ed"
# Words that make a number before a full stop an ordinal in German, and what may follow it.
ORDINAL_BEFORE = frozenset("am vom zum dem der den des ab bis seit im ihr sein jeder jede jeden".split())
ORDINAL_AFTER = frozenset("Tag Tage Tages Mal Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Woche Quartal Jahrhundert Kapitel Stock Platz".split())
# Lower-case names a sentence may begin with, and words that carry on after a quotation.
TOOL_NAMES = frozenset("npm npx git yarn pnpm pip node deno bun cargo rustc gcc curl docker kubectl iOS macOS eBay jQuery".split())
CARRY_ON = re.compile(r"\s*(?:と|って|は|が|を|に|の|も(?!う)|で(?!も)|や(?!は)|へ|から|まで|という|然后|然後|并|並|但|就|而|后|後|的|說|说|地|是|等|和|或|及|，|、|,|；|;|：|:)")

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“", "‘": "’", "‚": "‘"}
_BRACKETS = frozenset("([{（【［")
_OPEN = frozenset(_PAIRS)
_CLOSE = frozenset(_PAIRS.values()) | {"“", '"'}
_TOKEN = re.compile(r"(?P<M>\.{2,}|[.!?…。！？।॥｡︒؟۔]+(?:[.!?…。！？]*))|(?P<P>[()\[\]{}（）【】［］「」『』《》〈〉«»‹›“”„\"`])")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
_WIDE_MARK = re.compile(r"[。！？।॥｡︒؟۔]")
_CJK = re.compile(r"[　-ヿ㐀-鿿豈-﫿＀-｠]")
_WORD_AT = re.compile(r"\S+")
_LETTERS_AT = re.compile(r"\w+")
_BLANK = re.compile(r"\s*$")
_FENCE = re.compile(r"\s{0,3}(```+|~~~+)")
_HEADING = re.compile(r"#{1,6}(?:\s|$)")
_QUOTED = re.compile(r">")
_ITEM = re.compile(r"(?:-|\d{1,9}\.)[ \t]+")
_TITLE = re.compile(r"(?:build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(?:\([^()\n]*\))?!?: ")


def _trie() -> dict:
    """Abbreviations without their last full stop, backwards; the key "" holds the class."""
    root: dict = {}
    never: list[str] = []
    for line in NEVER_END:
        words = line.split(" ")
        i = 0
        while i < len(words):  # "z. b" is one abbreviation of two parts
            word = words[i]
            while word.endswith(".") and i + 1 < len(words):
                i += 1
                word += " " + words[i]
            never.append(word)
            i += 1
    for kind, entries in (("never", never), ("maybe", MAYBE_END.split()), ("number", BEFORE_NUMBER.split())):
        for entry in entries:
            at = root
            for ch in reversed(entry):
                at = at.setdefault(ch, {})
            at.setdefault("", kind)
    return root


_ABBREVIATIONS = _trie()


def _abbreviation(text: str, at: int, start: int) -> str | None:
    """The class of the longest abbreviation that ends right before the full stop at `at`."""
    node, i, kind = _ABBREVIATIONS, at - 1, None
    while True:
        if "" in node and (i < start or not (text[i].isalnum() or text[i] == ".")):
            kind = node[""]
        if i < start:
            return kind
        ch = text[i]
        node = node.get(" " if ch.isspace() else ch.lower())
        if node is None:
            return kind
        i -= 1
        if ch.isspace():
            while i >= start and text[i].isspace():
                i -= 1


def _code_like(text: str, at: int, end: int) -> bool:
    """Whether the word at `at` is a name from code or a tool, with which a sentence may start in lower case."""
    m = _WORD_AT.match(text, at, end)
    if not m:
        return False
    word = m[0]
    if word[0] == "`":
        return True
    core = word.rstrip(".,;:!?)\"'”»")
    return core in TOOL_NAMES or bool(re.search(r"[a-z][A-Z]|\w[./_(]\w|\w\(\)|[a-z]\d", core))


def _goes_on(text: str, at: int, end: int) -> bool:
    """Whether the text at `at` (no white space) carries a sentence on: a plain word in lower case or a mark."""
    if at >= end:
        return False
    ch = text[at]
    if ch in ",;:–—-)]}":
        return True
    return ch.islower() and not _code_like(text, at, end)


def _skip(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def _partners(text: str, start: int, end: int) -> tuple[list[re.Match], dict[int, int]]:
    """Marks and pair characters in order, and each closed pair's two places; what never closes is no pair."""
    tokens, partner, stack = [], {}, []
    awaited: dict[str, int] = {}  # open pairs by the character that closes them
    in_code = text.count("`", start, end) > 1
    for m in _TOKEN.finditer(text, start, end):
        if m.lastgroup == "M":
            tokens.append(m)
            continue
        ch, at = m[0], m.start()
        if ch == "`" and not in_code:
            continue
        if stack and stack[-1][0] == "`" and ch != "`":
            continue
        tokens.append(m)
        depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == ch), None) if awaited.get(ch) else None
        if depth is not None and not (ch in '"' and at + 1 < end and (text[at + 1].isalnum()) and (at == start or text[at - 1].isspace())):
            partner[stack[depth][2]], partner[at] = at, stack[depth][2]
            for _, closer, _ in stack[depth:]:
                awaited[closer] -= 1
            del stack[depth:]
        elif ch in "\"`":
            if ch == "`" or at == start or not text[at - 1].isalnum():
                stack.append((ch, ch, at))
                awaited[ch] = awaited.get(ch, 0) + 1
        elif ch in _OPEN:
            stack.append((ch, _PAIRS[ch], at))
            awaited[_PAIRS[ch]] = awaited.get(_PAIRS[ch], 0) + 1
    return tokens, partner


def split_text(text: str, start: int, end: int, lead: int = 0) -> list[tuple[int, int]]:
    """Units of text[start:end]; the first `lead` characters are a list mark and end nothing."""
    start = _skip(text, start, end)
    while end > start and text[end - 1].isspace():
        end -= 1
    if start >= end:
        return []
    tokens, partner = _partners(text, start, end)
    gaps = [m.span() for m in _THAI_GAP.finditer(text, start, end)]
    cuts: list[int] = []
    unit, depth, inner = start, 0, -1  # inner: end of the last mark inside the pair just being closed
    opener = -1
    events = sorted([(m.start(), 0, m) for m in tokens] + [(a, 1, None) for a, _ in gaps], key=lambda e: (e[0], e[1]))
    for at, what, m in events:
        if at < unit or at < start + lead:
            continue
        if what == 1:
            if depth == 0:
                cuts.append(at)
                unit = _skip(text, at, end)
            continue
        if m.lastgroup == "P":
            other = partner.get(at)
            if other is None:
                continue
            if other > at:
                if depth == 0:
                    opener = at
                depth, inner = depth + 1, -1
                continue
            depth -= 1
            if depth or inner < 0 or text[inner:at].strip("\"”’»)]}）】」』》   "):
                continue
            stop = at + 1
            follow = _skip(text, stop, end)
            whole = opener == unit and text[opener] in _BRACKETS
            if follow >= end:
                break
            wide = bool(_WIDE_MARK.match(text[inner - 1]) or _CJK.match(text[at]))
            if follow == stop and not wide:
                continue
            if not whole:
                if wide and follow == stop and CARRY_ON.match(text, stop):
                    continue
                if wide and follow == stop and text[opener] in _BRACKETS:
                    continue
                if _goes_on(text, follow, end) or (text[inner - 1] == "." and _stop_kind(text, inner - 1, follow, end, opener + 1) is False):
                    continue
            cuts.append(stop)
            unit = follow
            continue
        stop = m.end()
        if depth:
            inner = stop
            continue
        mark = m[0]
        while stop < end and text[stop] in _CLOSE and partner.get(stop) is None:
            stop += 1
        if stop >= end:
            break
        follow = _skip(text, stop, end)
        if _WIDE_MARK.search(mark):
            ends = not (mark[0] == "…" and mark.strip("…") == "")
        elif follow == stop:
            ends = False  # inside a number, name, version or path
        elif mark.startswith("..") or "…" in mark and mark.strip("….") == "":
            ends = not _goes_on(text, follow, end) and not _CJK.match(text[follow])
        elif "!" in mark or "?" in mark:
            ends = text[follow] not in ",;"
        else:
            ends = _stop_kind(text, m.start(), follow, end, unit) is not False
        if ends:
            cuts.append(stop)
            unit = follow
    out, unit = [], start
    for cut in [*cuts, end]:
        a, b = _skip(text, unit, end), cut
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        unit = cut
    return out


def _stop_kind(text: str, dot: int, follow: int, end: int, start: int) -> bool | None:
    """False if the full stop at `dot` belongs to an abbreviation, initial or ordinal; else None."""
    if follow >= end:
        return None
    kind = _abbreviation(text, dot, start)
    nxt = text[follow]
    if kind == "never":
        return False
    if kind == "maybe":
        return False if _goes_on(text, follow, end) or nxt.isdigit() else None
    if kind == "number":
        lone = dot - 2 < start or not text[dot - 2].isalnum()
        return False if lone or nxt.isdigit() or nxt in "([§#" else None
    before = text[dot - 1] if dot > start else ""
    if before.isalpha() and (dot - 2 < start or not (text[dot - 2].isalnum() or text[dot - 2] in "-_/")):
        return False  # an initial
    if before.isdigit():
        i = dot - 1
        while i > start and text[i - 1].isdigit():
            i -= 1
        if i == start:
            return False  # the unit begins with a number
        j = i
        while j > start and text[j - 1].isspace():
            j -= 1
        k = j
        while j < i and k > start and (text[k - 1].isalnum() or text[k - 1] == "_"):
            k -= 1
        after = _LETTERS_AT.match(text, follow, end)
        if (text[k:j].lower() in ORDINAL_BEFORE and after and after[0][0].isupper()) or (after and after[0] in ORDINAL_AFTER):
            return False
    return None


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit in code points, end exclusive, without white space at either end."""
    if not text:
        return []
    units: list[tuple[int, int]] = []
    begin, stop, lead = -1, -1, 0  # the text being gathered
    fence, first, at = "", True, 0

    def close() -> None:
        nonlocal begin
        if begin >= 0:
            units.extend(split_text(text, begin, stop, lead))
            begin = -1

    for line in text.split("\n"):
        a, b = at, at + len(line)
        at = b + 1
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip(" \t\r" + fence[0]):
                fence = ""
            continue
        if m:
            close()
            fence, first = m[1], False
            continue
        if _BLANK.match(line):
            close()
            continue
        if _HEADING.match(line) or _QUOTED.match(line) or (first and _TITLE.match(line)):
            close()
            left = len(line) - len(line.lstrip())
            units.append((a + left, a + len(line.rstrip())))
        elif item := _ITEM.match(line):
            close()
            begin, stop, lead = a, b, item.end()
        elif begin >= 0:
            stop = b
        else:
            begin, stop, lead = a, b, 0
        first = False
    close()
    return units


UNIT_SCHEMA = "doc_id long, start_char int, end_char int"


def _unit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, starts, ends = [], [], []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            for a, b in sentence_units(text):
                ids.append(doc_id)
                starts.append(a)
                ends.append(b)
        yield pd.DataFrame({"doc_id": pd.array(ids, "int64"), "start_char": pd.array(starts, "int32"), "end_char": pd.array(ends, "int32")})


def document_units(documents: DataFrame) -> DataFrame:
    """Sentence units of every document: doc_id, start_char, end_char.

    Null, empty and blank texts have none. Each row of the table is split on
    its own; no row is shuffled if the scan has enough partitions. Further
    columns are ignored.
    """
    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()
    return spread(ready).mapInPandas(_unit_batches, UNIT_SCHEMA)


def unit_texts(documents: DataFrame) -> DataFrame:
    """The units with their text and number in the document: doc_id, unit_no (1-based), start_char, end_char, unit."""
    ready = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i + 1, a, b, t[a:b]) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, (a, b) in enumerate(sentence_units(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "unit_no", "start_char", "end_char", "unit"])

    return ready.mapInPandas(run, "doc_id long, unit_no int, start_char int, end_char int, unit string")

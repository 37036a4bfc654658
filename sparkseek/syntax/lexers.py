"""Tokens of source files: kinds, places, line breaks before them, matching brackets.

A `Tokens` always ends with one token of kind EOF. Text that is no token of the
language gives one of kind ERR, which no grammar accepts, and reading goes on
behind it. White space and comments are between tokens: their text is what lies
between one token's end and the next one's start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Tokens:
    text: str
    kind: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    newline: list[bool] = field(default_factory=list)
    match: list[int] = field(default_factory=list)


# The words of ECMAScript and TypeScript.
JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
JS_CONTEXTUAL = frozenset(
    "abstract accessor as asserts async await constructor declare from get global implements infer interface is keyof let module namespace of out override package private protected public readonly require satisfies set static target type unique using yield meta".split()
)
# After these words an expression starts, so a slash opens a regular expression.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
_OPERAND_END = frozenset(["NAME", "NUM", "STR", "REGEX", "TFULL", "TTAIL", ")", "]", "}", "PRIVATE", "J>", "++", "--", "this", "super", "null", "true", "false"]) | (JS_CONTEXTUAL - _BEFORE_OPERAND)

_TURNING = frozenset(["/", "/=", "<", "{", "}"])  # operators after which something else may be read

_JS_TRIVIA = r"(?>[\s﻿]*(?:(?://[^\n  ]*|/\*[\s\S]*?\*/)[\s﻿]*)*)"
_JS = re.compile(
    _JS_TRIVIA + r"(?:(?P<NAME>[A-Za-z_$][\w$]*+(?![\\‌‍])|(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(?P<NUM>(?=[\d.])(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:\d+(?:_\d+)*n|(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?))(?![\w$]))"
    r"""|(?P<STR>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')"""
    r"|(?P<OP>[()\[\]{},;:~@]|=>|===?|!==?|\*\*=?|<<=?|<=|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\.\.\.|\+\+|--|[-+*/%&|^]=|[<>+\-*/%&|^!?=.])"
    r"|(?P<PRIVATE>#(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<TICK>`))"
)
_TRIVIA = re.compile(_JS_TRIVIA)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JSX_OPEN = re.compile(r"<(?:\s*(?:[A-Za-z_$][\w$.:-]*)(?!\s*,|\s+extends\b)|\s*>)")
_TAG = re.compile(r"""(?P<JNAME>[A-Za-z_$][\w$-]*)|(?P<JSTR>"[^"]*"|'[^']*')|(?P<JOP>[<>/=.:{])""")
_TAG_NAME = re.compile(r"\s*(/?)\s*([A-Za-z_$][\w$.:-]*)?")
_JSX_TEXT = re.compile(r"[^<{>}]+")


def lex_js(text: str, jsx: bool) -> Tokens:
    """Tokens of JavaScript or TypeScript, with JSX if asked for.

    A slash opens a regular expression where an operand can start. JSX is told
    from a comparison in the same way; its tags and texts get kinds of their own
    (J<, J>, J/, J=, J., J:, JNAME, JSTR, JTEXT), and a closing tag whose name
    doesn't match the open one gives ERR.
    """
    kind: list[str] = []
    start: list[int] = []
    end: list[int] = []
    newline: list[bool] = []
    pos, size, mode = 0, len(text), "js"
    stack: list[str] = []  # what each open brace returns to: b block, t template, or a JSX mode
    elements: list[str] = []  # names of open JSX elements
    bases: list[int] = []  # number of open elements at which a JSX expression ends
    closing = selfclose = False
    words, match_token, match_trivia = JS_RESERVED | JS_CONTEXTUAL, _JS.match, _TRIVIA.match
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else size

    def put(k, a, b, nl=False):
        kind.append(k)
        start.append(a)
        end.append(b)
        newline.append(nl)

    while True:
        if mode == "text":
            if pos >= size:
                break
            ch = text[pos]
            if ch == "{":
                stack.append("text")
                put("{", pos, pos + 1)
                pos, mode = pos + 1, "js"
            elif ch == "<":
                put("J<", pos, pos + 1)
                slash, name = _TAG_NAME.match(text, pos + 1).groups()
                pos, mode, closing, selfclose = pos + 1, "tag", bool(slash), False
                if closing:
                    if not elements or elements[-1] != (name or ""):
                        put("ERR", pos, pos)
                else:
                    elements.append(name or "")
            else:
                m = _JSX_TEXT.match(text, pos)
                if m:
                    put("JTEXT", pos, m.end())
                    pos = m.end()
                else:
                    put("ERR", pos, pos + 1)
                    pos += 1
            continue
        if mode == "tag":
            pos = match_trivia(text, pos).end()
            if pos >= size:
                break
            m = _TAG.match(text, pos)
            if not m:
                put("ERR", pos, pos + 1)
                pos += 1
                continue
            k, at, pos = m.lastgroup, pos, m.end()
            if k != "JOP":
                put(k, at, pos)
                continue
            ch = m[0]
            if ch == "{":
                stack.append("tag")
                put("{", at, pos)
                mode = "js"
            elif ch == ">":
                put("J>", at, pos)
                if closing or selfclose:
                    if elements:
                        elements.pop()
                    mode = "js" if len(elements) <= bases[-1] else "text"
                    if mode == "js":
                        bases.pop()
                else:
                    mode = "text"
                closing = selfclose = False
            else:
                if ch == "/" and not closing:
                    selfclose = True
                put("J" + ch, at, pos)
            continue
        m = match_token(text, pos)
        if not m:
            gap = match_trivia(text, pos).end()
            if gap >= size:
                break
            put("ERR", gap, gap + 1, "\n" in text[pos:gap])
            pos = gap + 1
            continue
        k = m.lastgroup
        at, after = m.span(k)
        nl = at > pos and text.find("\n", pos, at) >= 0
        pos = at
        if k == "NAME":
            word = text[at:after]
            kind.append(word if word in words else k)
            start.append(at)
            end.append(after)
            newline.append(nl)
            pos = after
        elif k == "OP":
            op, last = text[at:after], kind[-1] if kind else ""
            if op not in _TURNING:
                pass
            elif op in ("/", "/=") and last not in _OPERAND_END:
                r = _REGEX.match(text, pos)
                if r:
                    put("REGEX", pos, r.end(), nl)
                    pos = r.end()
                    continue
            elif op == "<" and jsx and last not in _OPERAND_END and _JSX_OPEN.match(text, pos):
                bases.append(len(elements))
                elements.append(_TAG_NAME.match(text, pos + 1)[2] or "")
                put("J<", pos, pos + 1, nl)
                pos, mode, closing, selfclose = pos + 1, "tag", False, False
                continue
            elif op == "{":
                stack.append("b")
            elif op == "}":
                back = stack.pop() if stack else "b"
                if back == "t":
                    r = _TEMPLATE.match(text, pos + 1)
                    if not r:
                        put("ERR", pos, size, nl)
                        pos = size
                        continue
                    if r[1] == "`":
                        put("TTAIL", pos, r.end(), nl)
                    else:
                        put("TMID", pos, r.end(), nl)
                        stack.append("t")
                    pos = r.end()
                    continue
                if back in ("tag", "text"):
                    put("}", pos, pos + 1, nl)
                    pos, mode = pos + 1, back
                    continue
            kind.append(op)
            start.append(at)
            end.append(after)
            newline.append(nl)
            pos = after
        elif k == "TICK":
            r = _TEMPLATE.match(text, pos + 1)
            if not r:
                put("ERR", pos, size, nl)
                pos = size
                continue
            if r[1] == "`":
                put("TFULL", pos, r.end(), nl)
            else:
                put("THEAD", pos, r.end(), nl)
                stack.append("t")
            pos = r.end()
        else:
            put(k, pos, after, nl)
            pos = after
    if text.rfind("/*") > (end[-1] if end else -1) and text.find("*/", text.rfind("/*")) < 0:
        put("ERR", size, size, True)
    put("EOF", size, size, True)
    return Tokens(text, kind, start, end, newline, brackets(kind))


_OPENERS = {"(": ")", "[": "]", "{": "}", "THEAD": "TTAIL"}
_BRACKETS = frozenset(_OPENERS) | frozenset(_OPENERS.values())


def brackets(kind: list[str]) -> list[int]:
    """For each opening bracket the position of its closing one (0: none), and the other way round."""
    match = [0] * (len(kind) + 1)
    open_at: list[int] = []
    for i in [i for i, k in enumerate(kind) if k in _BRACKETS]:
        k = kind[i]
        if k in _OPENERS:
            open_at.append(i)
        else:
            if open_at and _OPENERS[kind[open_at[-1]]] == k:
                j = open_at.pop()
                match[j], match[i] = i, j
            else:  # a stray closer: drop openers that it can't belong to
                while open_at and _OPENERS[kind[open_at[-1]]] != k:
                    open_at.pop()
                if open_at:
                    j = open_at.pop()
                    match[j], match[i] = i, j
    return match


# Python's keywords.
PY_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
PY_SOFT = frozenset(["match", "case", "type", "_"])
_PY_STR = r"""(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')"""
_PY = re.compile(
    rf"(?P<STR>{_PY_STR})"
    r"|(?P<NAME>[^\W\d]\w*)"
    r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w]))"
    r"|(?P<OP>\*\*=?|//=?|>>=?|<<=?|->|:=|\.\.\.|[-+*/%@&|^=<>!]=|[-+*/%@&|^=<>~()\[\]{},:;.])"
)
_PY_GAP = re.compile(r"(?:[ \t\f]+|\\\r?\n|#[^\n]*)*")
_PY_GAP_IN = re.compile(r"(?:[ \t\f\r\n﻿]+|\\\r?\n|#[^\n]*)*")
_PY_BLANK = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\r?(?:\n|$))*?(?=[ \t\f]*[^\s#]|\Z)")
_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_LEADING_ZERO = re.compile(r"0(?:_?\d)*[1-9]")


def lex_python(text: str) -> Tokens:
    """Tokens of Python with NEWLINE, INDENT and DEDENT; an indentation error gives ERR."""
    kind: list[str] = []
    start: list[int] = []
    end: list[int] = []
    open_brackets: list[str] = []
    indents = [(0, 0)]
    pos, size = 1 if text.startswith("﻿") else 0, len(text)

    def put(k, a, b):
        kind.append(k)
        start.append(a)
        end.append(b)

    line_start = True
    while True:
        if line_start:
            line_start = False
            m = _PY_BLANK.match(text, pos)
            pos = m.end() if m else pos
            lead = _PY_INDENT.match(text, pos)
            pos = lead.end()
            if pos >= size:
                break
            here = _width(lead[0])
            if here != indents[-1]:
                if here[0] > indents[-1][0] and here[1] > indents[-1][1]:
                    indents.append(here)
                    put("INDENT", pos, pos)
                elif here[0] < indents[-1][0] and here[1] < indents[-1][1]:
                    while here[0] < indents[-1][0]:
                        indents.pop()
                        put("DEDENT", pos, pos)
                    if here != indents[-1]:
                        put("ERR", pos, pos)
                else:
                    put("ERR", pos, pos)
        pos = (_PY_GAP_IN if open_brackets else _PY_GAP).match(text, pos).end()
        if pos >= size:
            break
        ch = text[pos]
        if ch == "\n" or ch == "\r":
            pos += 2 if text.startswith("\r\n", pos) else 1
            if kind and kind[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                put("NEWLINE", pos - 1, pos)
            line_start = True
            continue
        m = _PY.match(text, pos)
        if not m:
            put("ERR", pos, pos + 1)
            pos += 1
            continue
        k, word = m.lastgroup, m[0]
        if k == "NAME" and (word in PY_KEYWORDS or word in PY_SOFT):
            k = word
        elif k == "OP":
            k = word
            if word in "([{":
                open_brackets.append({"(": ")", "[": "]", "{": "}"}[word])
            elif word in ")]}":
                if not open_brackets or open_brackets.pop() != word:
                    put("ERR", pos, pos)
        elif k == "NUM" and _PY_LEADING_ZERO.fullmatch(word):
            k = "ERR"
        put(k, pos, m.end())
        pos = m.end()
    if open_brackets:
        put("ERR", size, size)
    if kind and kind[-1] not in ("NEWLINE", "DEDENT"):
        put("NEWLINE", size, size)
    for _ in indents[1:]:
        put("DEDENT", size, size)
    put("EOF", size, size)
    return Tokens(text, kind, start, end, [False] * len(kind), brackets(kind))


def _width(lead: str) -> tuple[int, int]:
    """Columns of an indentation with tabs to 8 and to 1, which must agree on every comparison."""
    if "\t" not in lead and "\f" not in lead:
        return len(lead), len(lead)
    wide = narrow = 0
    for ch in lead:
        if ch == "\t":
            wide, narrow = (wide // 8 + 1) * 8, narrow + 1
        elif ch == "\f":
            wide = narrow = 0
        else:
            wide, narrow = wide + 1, narrow + 1
    return wide, narrow


_JSON = re.compile(
    r"""(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<WORD>true|false|null)(?!\w)|(?P<OP>[{}\[\],:])""", re.ASCII
)
_JSON_GAP = re.compile(r"[ \t\r\n]*")


def lex_json(text: str) -> Tokens:
    """Tokens of strict JSON."""
    kind: list[str] = []
    start: list[int] = []
    end: list[int] = []
    pos, size = 0, len(text)
    while True:
        pos = _JSON_GAP.match(text, pos).end()
        if pos >= size:
            break
        m = _JSON.match(text, pos)
        if m:
            kind.append(m[0] if m.lastgroup == "OP" else m.lastgroup)
        else:
            kind.append("ERR")
        start.append(pos)
        pos = m.end() if m else pos + 1
        end.append(pos)
    kind.append("EOF")
    start.append(size)
    end.append(size)
    return Tokens(text, kind, start, end, [False] * len(kind), brackets(kind))

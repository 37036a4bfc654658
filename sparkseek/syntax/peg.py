"""Packrat parsing-expression grammars compiled to Python.

A grammar is text, one rule a line: ``Name <- expression``; ``Name := expression``
memoises the rule's results by position, which keeps re-tried rules linear.
Expressions: 'kind' matches one token of that kind, <cls> one token whose kind is
in the named set, sequence, ordered choice ``/``, ``* + ?``, lookahead ``& !``,
``(...)``, and the zero-width conditions ``NONL`` (no line break before the next
token), ``NL`` (a line break), ``ARROW`` (the bracket here closes before ``=>``
or ``:``), ``FAIL`` and the statement end ``SEMI``.

Rules become functions over token positions returning the next position or -1;
parsing runs them over one token sequence at a time, without making them anew.
Ordered choices test the first-token sets of their alternatives, so most
alternatives that can't match cost one set lookup. A second build of the same
grammar also notes the furthest position at which any terminal failed; it runs
only on inputs that were rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_TOKEN = re.compile(r"\s*(?:'([^']+)'|<(\w+)>|(\w+)|([()/*+?&!]))")
_ANY = None  # a first set that can't be told


class Grammar:
    """Compiled grammar; `parse` returns -1 on full match, else the furthest failing token."""

    def __init__(self, text: str, classes: dict[str, frozenset[str]], start: str):
        self.rules: dict[str, tuple] = {}
        self.memo: set[str] = set()
        self.classes = classes
        for line in text.strip().splitlines():
            line = line.strip()
            if not line or line.startswith("--"):
                continue
            name, arrow, body = re.match(r"(\w+)\s*(<-|:=)\s*(.*)$", line).groups()
            if arrow == ":=":
                self.memo.add(name)
            tokens = [m.groups() for m in _TOKEN.finditer(body)]
            expr, rest = self._choice(tokens, 0)
            if rest != len(tokens):
                raise ValueError(f"rule {name}: can't read on at {tokens[rest:]}")
            self.rules[name] = expr
        self.first: dict[str, frozenset | None] = {}
        self.null: dict[str, bool] = {}
        self._fixpoint()
        self.start = start
        self._fast: Callable | None = None
        self._slow: Callable | None = None
        self._space = self._compile(False, "if True:")  # rules as functions over K, NL and MATCH, set before each parse

    # grammar text to trees
    def _choice(self, t, i):
        alts = []
        while True:
            seq, i = self._sequence(t, i)
            alts.append(seq)
            if i < len(t) and t[i][3] == "/":
                i += 1
                continue
            return (alts[0] if len(alts) == 1 else ("alt", alts)), i

    def _sequence(self, t, i):
        items = []
        while i < len(t) and t[i][3] not in ("/", ")"):
            item, i = self._item(t, i)
            items.append(item)
        return (items[0] if len(items) == 1 else ("seq", items)), i

    def _item(self, t, i):
        if t[i][3] in ("&", "!"):
            inner, j = self._item(t, i + 1)
            return ("and" if t[i][3] == "&" else "not", inner), j
        lit, cls, name, op = t[i]
        if lit:
            e = ("tok", lit)
        elif cls:
            e = ("cls", cls)
        elif name in ("NONL", "NL", "SEMI", "ARROW", "FAIL"):
            e = (name,)
        elif name:
            e = ("rule", name)
        elif op == "(":
            e, i = self._choice(t, i + 1)
        else:
            raise ValueError(f"unexpected {t[i]}")
        i += 1
        while i < len(t) and t[i][3] in ("*", "+", "?"):
            e = {"*": ("star", e), "+": ("seq", [e, ("star", e)]), "?": ("opt", e)}[t[i][3]]
            i += 1
        return e, i

    # first sets
    def _fixpoint(self):
        for name in self.rules:
            self.first[name], self.null[name] = frozenset(), False
        changed = True
        while changed:
            changed = False
            for name, e in self.rules.items():
                f, n = self._fn(e)
                if f != self.first[name] or n != self.null[name]:
                    self.first[name], self.null[name], changed = f, n, True

    def _fn(self, e):
        kind = e[0]
        if kind == "tok":
            return frozenset([e[1]]), False
        if kind == "cls":
            return self.classes[e[1]], False
        if kind == "rule":
            return self.first[e[1]], self.null[e[1]]
        if kind == "seq":
            out: frozenset | None = frozenset()
            for x in e[1]:
                f, n = self._fn(x)
                out = _ANY if out is _ANY or f is _ANY else out | f
                if not n:
                    return out, False
            return out, True
        if kind == "alt":
            pairs = [self._fn(x) for x in e[1]]
            f = _ANY if any(a is _ANY for a, _ in pairs) else frozenset().union(*(a for a, _ in pairs))
            return f, any(b for _, b in pairs)
        if kind in ("star", "opt"):
            return self._fn(e[1])[0], True
        if kind == "FAIL":
            return frozenset(), False
        if kind == "SEMI":
            return _ANY, True
        return frozenset(), True  # conditions

    # trees to Python
    def _build(self, track: bool) -> Callable:
        """A maker of the rules as functions bound to one token sequence."""
        return self._compile(track, "def make(K, NL, MATCH, far):")["make"]

    def _compile(self, track: bool, head: str) -> dict:
        self.n, self.sets, self.track = 0, {}, track
        out = [head]
        for name in self.rules:
            if name in self.memo:
                out.append(f"  M_{name} = {{}}")
        for name, e in self.rules.items():
            out.append(f"  def r_{name}(p):")
            if name in self.memo:
                out.append(f"    d = M_{name}.get(p)")
                out.append("    if d is not None: return d")
            self._gen(e, "p", "d", 4, out)
            if name in self.memo:
                out.append(f"    M_{name}[p] = d")
            out.append("    return d")
        if head.startswith("def"):
            out.append("  return {" + ", ".join(f"{n!r}: r_{n}" for n in self.rules) + "}")
        space = dict(self.sets)
        exec(compile("\n".join(out), f"<peg {self.start}>", "exec"), space)  # noqa: S102
        return space

    def _var(self):
        self.n += 1
        return f"v{self.n}"

    def _set(self, kinds):
        for name, have in self.sets.items():
            if have == kinds:
                return name
        name = f"S{len(self.sets)}"
        self.sets[name] = kinds
        return name

    def _test(self, kinds, at):
        if len(kinds) == 1:
            return f"K[{at}] == {next(iter(kinds))!r}"
        return f"K[{at}] in {self._set(frozenset(kinds))}"

    def _gen(self, e, src, dst, ind, out):
        pad, kind = " " * ind, e[0]
        if kind in ("tok", "cls"):
            test = self._test(frozenset([e[1]]) if kind == "tok" else self.classes[e[1]], src)
            out.append(f"{pad}if {test}: {dst} = {src} + 1")
            if self.track:
                out += [f"{pad}else:", f"{pad} {dst} = -1", f"{pad} if {src} > far[0]: far[0] = {src}"]
            else:
                out.append(f"{pad}else: {dst} = -1")
        elif kind == "rule":
            out.append(f"{pad}{dst} = r_{e[1]}({src})")
        elif kind == "seq":
            acc = self._var()
            out.append(f"{pad}{acc} = -1")
            at, deep = src, ind
            for x in e[1]:
                t = self._var()
                self._gen(x, at, t, deep, out)
                out.append(" " * deep + f"if {t} >= 0:")
                at, deep = t, deep + 1
            out.append(" " * deep + f"{acc} = {at}")
            out.append(f"{pad}{dst} = {acc}")
        elif kind == "alt":
            acc = self._var()
            out.append(f"{pad}{acc} = -1")
            for i, x in enumerate(e[1]):
                f, n = self._fn(x)
                conds = [f"{acc} < 0"] if i else []
                if f is not _ANY and not n and not self.track:
                    conds.append(self._test(f, src) if f else "False")
                if conds:
                    out.append(f"{pad}if {' and '.join(conds)}:")
                    self._gen(x, src, acc, ind + 1, out)
                else:
                    self._gen(x, src, acc, ind, out)
            out.append(f"{pad}{dst} = {acc}")
        elif kind == "star":
            f, n = self._fn(e[1])
            at, t = self._var(), self._var()
            out.append(f"{pad}{at} = {src}")
            loop = self._test(f, at) if f and not n and not self.track else "True"
            out.append(f"{pad}while {loop}:")
            self._gen(e[1], at, t, ind + 1, out)
            out.append(f"{pad} if {t} <= {at}: break")
            out.append(f"{pad} {at} = {t}")
            out.append(f"{pad}{dst} = {at}")
        elif kind == "opt":
            t = self._var()
            f, n = self._fn(e[1])
            if f and not n and not self.track:
                out.append(f"{pad}{t} = -1")
                out.append(f"{pad}if {self._test(f, src)}:")
                self._gen(e[1], src, t, ind + 1, out)
            else:
                self._gen(e[1], src, t, ind, out)
            out.append(f"{pad}{dst} = {t} if {t} >= 0 else {src}")
        elif kind in ("and", "not"):
            t = self._var()
            self._gen(e[1], src, t, ind, out)
            out.append(f"{pad}{dst} = {src} if {t} {'>=' if kind == 'and' else '<'} 0 else -1")
        elif kind == "FAIL":
            out.append(f"{pad}{dst} = -1")
        else:
            test = {"NONL": f"not NL[{src}]", "NL": f"NL[{src}]", "ARROW": f"MATCH[{src}] > 0 and K[MATCH[{src}] + 1] in ('=>', ':')"}.get(kind)
            if kind == "SEMI":
                out.append(f"{pad}if K[{src}] == ';': {dst} = {src} + 1")
                out.append(f"{pad}elif K[{src}] == '}}' or K[{src}] == 'EOF' or NL[{src}]: {dst} = {src}")
                out.append(f"{pad}else: {dst} = -1")
            else:
                out.append(f"{pad}{dst} = {src} if {test} else -1")
            if self.track:
                out.append(f"{pad}if {dst} < 0 and {src} > far[0]: far[0] = {src}")

    def matchers(self, kinds: list[str], newline: list[bool], match: list[int]) -> dict[str, Callable[[int], int]]:
        """A function for each rule: from a token position to the position after the match, or -1."""
        if self._fast is None:
            self._fast = self._build(False)
        return self._fast(kinds, newline, match, [0])

    def parse(self, kinds: list[str], newline: list[bool], match: list[int]) -> int:
        """-1 if the whole input matches, else the position of the furthest failing token."""
        n = len(kinds)
        space = self._space
        space["K"], space["NL"], space["MATCH"] = kinds, newline, match
        try:
            if space[f"r_{self.start}"](0) == n:
                return -1
        finally:
            for name in self.memo:
                space[f"M_{name}"].clear()
        if self._slow is None:
            self._slow = self._build(True)
        far = [0]
        self._slow(kinds, newline, match, far)[self.start](0)
        return min(far[0], n - 1)

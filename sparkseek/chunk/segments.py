"""Top-level segments of a TypeScript file with what they can be split into.

Statements are cut out by the TypeScript grammar; a token at which no statement
starts is an error node and is passed over to the next line. Lines are 0-based
here and inclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..syntax.grammars import grammar
from ..syntax.lexers import Tokens, lex_js

# Node types that make segments, members, properties and blocks.
SEMANTIC = frozenset(
    "function_declaration generator_function_declaration class_declaration abstract_class_declaration interface_declaration type_alias_declaration enum_declaration module export_statement import_statement lexical_declaration variable_declaration expression_statement".split()
)
CONTAINERS = frozenset("class_declaration abstract_class_declaration interface_declaration".split())
MEMBERS = frozenset("method_definition public_field_definition property_signature method_signature abstract_method_signature property_definition".split())
BLOCKS = frozenset("if_statement for_statement for_in_statement while_statement do_statement switch_statement try_statement return_statement throw_statement lexical_declaration variable_declaration expression_statement".split())
LONG_BLOCK, BLOCK_DEPTH = 15, 2


@dataclass
class Segment:
    first: int
    last: int
    kind: str
    symbol: str | None = None
    owner: str | None = None  # what members are named after where the segment itself has no symbol
    children: list[Segment] = field(default_factory=list)
    blocks: list[Segment] = field(default_factory=list)


@dataclass
class _Node:
    """A statement: its tokens [start, end) and type."""

    start: int
    end: int
    kind: str


class FileSegments:
    """Reads one file; `segments()` gives its top-level segments."""

    def __init__(self, path: str, text: str):
        tsx = path.endswith(".tsx")
        self.t: Tokens = lex_js(text, tsx)
        self.rule = grammar("tsx" if tsx else "ts").matchers(self.t.kind, self.t.newline, self.t.match)
        starts = [0]
        starts += [i + 1 for i, ch in enumerate(text) if ch == "\n"]
        self.starts = starts

    # places
    def row(self, at: int) -> int:
        lo, hi = 0, len(self.starts) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.starts[mid] <= at:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def span(self, node: _Node) -> tuple[int, int]:
        return self.row(self.t.start[node.start]), self.row(max(self.t.end[node.end - 1] - 1, self.t.start[node.start]))

    def word(self, i: int) -> str:
        return self.t.text[self.t.start[i] : self.t.end[i]]

    def comment_row(self, before: int, at: int) -> int | None:
        """Row of the first comment between two tokens."""
        begin = self.t.end[before] if before >= 0 else 0
        gap = self.t.text[begin : self.t.start[at]]
        for i in range(len(gap) - 1):
            if gap[i] == "/" and gap[i + 1] in "/*":
                return self.row(begin + i)
        return None

    # statements
    def statements(self, start: int, stop: int) -> list[_Node]:
        out, i, t = [], start, self.t
        while i < stop and t.kind[i] != "EOF":
            end = self.rule["Stmt"](i)
            if end <= i or end > stop:
                j = i + 1
                while j < stop and t.kind[j] != "EOF" and not t.newline[j]:
                    j = t.match[j] + 1 if i < j < t.match[j] < stop and t.kind[j] in ("(", "[", "{", "THEAD") else j + 1
                out.append(_Node(i, max(j, i + 1), "ERROR"))
                i = max(j, i + 1)
                continue
            out.append(_Node(i, end, self.kind_of(i, end)))
            i = end
        return out

    def kind_of(self, i: int, end: int) -> str:
        k, after = self.t.kind[i], self.t.kind[i + 1]
        if k == "import":
            return "expression_statement" if after in ("(", ".") else "import_statement"
        if k == "export":
            return "export_statement"
        if k == "@":
            j = i
            while self.t.kind[j] == "@":
                j = self.rule["Decorator"](j)
            return self.kind_of(j, end)
        if k == "function" or (k == "async" and after == "function"):
            if self.t.kind[end - 1] != "}":
                return "function_signature"
            return "generator_function_declaration" if "*" in self.t.kind[i : i + 3] else "function_declaration"
        if k == "class":
            return "class_declaration"
        if k == "abstract" and after == "class":
            return "abstract_class_declaration"
        if k == "declare" and self.rule["Declare"](i) == end:
            return "ambient_declaration"
        for word, rule, kind in (("interface", "Interface", "interface_declaration"), ("type", "TypeAlias", "type_alias_declaration"), ("enum", "Enum", "enum_declaration"), ("const", "Enum", "enum_declaration"), ("module", "Namespace", "module")):
            if k == word and self.rule[rule](i) == end:
                return kind
        if k == "let" or k == "const":
            return "lexical_declaration"
        if k == "for":
            j = self.t.match[i + 1] if after == "(" else 0
            inside = self.t.kind[i + 2 : j] if j else []
            return "for_in_statement" if after == "await" or ";" not in inside and ("of" in inside or "in" in inside) else "for_statement"
        simple = {"var": "variable_declaration", "if": "if_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "try": "try_statement", "return": "return_statement", "throw": "throw_statement", "{": "statement_block", ";": "empty_statement", "break": "break_statement", "continue": "continue_statement", "debugger": "debugger_statement", "with": "with_statement"}
        if k in simple:
            return simple[k]
        return "labeled_statement" if after == ":" else "expression_statement"

    # what a statement holds
    def declaration(self, node: _Node) -> _Node | None:
        """What an export statement declares; the node itself if it is none."""
        if node.kind != "export_statement":
            return node
        i = node.start + 1
        if self.t.kind[i] == "default":
            i += 1
            named = self.t.kind[i] in ("class", "abstract", "interface") or (self.t.kind[i] in ("function", "async") and self.rule["FuncDecl"](i) == node.end)
            return _Node(i, node.end, self.kind_of(i, node.end)) if named else None
        if self.t.kind[i] in ("{", "*", "="):
            return None
        kind = self.kind_of(i, node.end)
        return _Node(i, node.end, kind) if kind != "expression_statement" else None

    def default_value(self, node: _Node) -> int | None:
        """First token of an exported value."""
        if node.kind == "export_statement" and self.t.kind[node.start + 1] == "default" and self.declaration(node) is None:
            return node.start + 2
        return None

    def name(self, node: _Node) -> str | None:
        if node.kind == "export_statement":
            inner = self.declaration(node)
            return self.name(inner) if inner else ("default" if self.default_value(node) is not None else None)
        if node.kind in CONTAINERS or node.kind in ("function_declaration", "generator_function_declaration", "type_alias_declaration", "enum_declaration", "module", "function_signature"):
            words = ("function", "class", "interface", "type", "enum", "module", "namespace")
            for i in range(node.start, node.end):
                if self.t.kind[i] in words:
                    j = i + 2 if self.t.kind[i + 1] == "*" else i + 1
                    return self.word(j) if self.t.kind[j] not in ("{", "(", "<", "extends") else None
        return None

    def values(self, node: _Node) -> list[tuple[str, int, int]]:
        """(name, first token, end) of the initial values of a declaration."""
        out, i = [], node.start + 1
        while i < node.end:
            at = self.rule["Target"](i)
            if at < 0:
                break
            name = self.word(i)
            typed = self.rule["TypeAnn"](at) if self.t.kind[at] == ":" else at
            at = typed if typed > 0 else at
            if self.t.kind[at] == "=":
                end = self.rule["Assign"](at + 1)
                out.append((name, at + 1, end))
                at = end
            if self.t.kind[at] != ",":
                break
            i = at + 1
        return out

    def is_function(self, start: int, end: int) -> bool:
        """Whether the tokens are one arrow function or function expression."""
        return self.rule["Arrow"](start) == end or self.rule["FuncExpr"](start) == end

    def function_body(self, start: int, end: int) -> int | None:
        """The opening brace of a function's body."""
        last = end - 1
        while last > start and self.t.kind[last] == ";":
            last -= 1
        return self.t.match[last] if self.t.kind[last] == "}" and start < self.t.match[last] < last else None

    def function_of(self, node: _Node) -> tuple[int, int] | None:
        """Tokens of the function that a statement is or wraps; an exported constant's does not count."""
        inner = self.declaration(node)
        if inner and inner.kind in ("function_declaration", "generator_function_declaration"):
            return inner.start, inner.end
        value = self.default_value(node)
        if value is not None:
            end = self.rule["Assign"](value)
            end = end if end > 0 else self.rule["AnonFunc"](value)
            return (value, end) if end > 0 and (self.is_function(value, end) or self.rule["AnonFunc"](value) == end) else None
        if node.kind in ("lexical_declaration", "variable_declaration"):
            for _, a, b in self.values(node):
                if b > 0 and self.is_function(a, b):
                    return a, b
        return None

    def object_of(self, node: _Node) -> tuple[int, str | None] | None:
        """The brace of the object literal that a statement declares first, and the declared name."""
        inner = self.declaration(node)
        if inner is None:
            value = self.default_value(node)
            return (value, "default") if value is not None and self._object_at(value) else None
        if inner.kind in ("lexical_declaration", "variable_declaration"):
            for name, a, _ in self.values(inner):
                return (a, name) if self._object_at(a) else None
        return None

    def _object_at(self, i: int) -> bool:
        if self.t.kind[i] != "{":
            return False
        end = self.rule["Object"](i)
        return end > 0 and self.t.kind[end] in (";", "as", "satisfies", "EOF", ",", "}") or end > 0 and self.t.newline[end]

    # members, properties, blocks
    def members(self, node: _Node) -> list[Segment]:
        inner = self.declaration(node)
        interface = inner.kind == "interface_declaration"
        brace = next((i for i in range(inner.start, inner.end) if self.t.kind[i] == "{" and self.t.match[i] == inner.end - 1), None)
        if brace is None:
            return []
        out, i, stop, pending = [], brace + 1, self.t.match[brace], None
        while i < stop:
            comment = self.comment_row(i - 1, i)
            pending = comment if pending is None else pending
            if self.t.kind[i] in (";", ","):
                i, pending = i + 1, None
                continue
            start = i
            while not interface and self.t.kind[start] == "@":
                start = self.rule["Decorator"](start)
                pending = None
            rule = "TypeMember" if interface else "Member"
            end = self.rule[rule](start)
            if end <= start or end > stop:
                i, pending = i + 1, None
                continue
            close = end - 1 if self.t.kind[end - 1] in (";", ",") and end - 1 > start else end
            kind, name = self._member_kind(start, close, interface, inner.kind)
            if kind in MEMBERS:
                first, last = self.span(_Node(start, close, kind))
                out.append(Segment(pending if pending is not None else first, last, kind, name))
            i, pending = end, None
        return out

    def _member_kind(self, start: int, end: int, interface: bool, owner: str) -> tuple[str, str | None]:
        k = self.t.kind
        i, abstract = start, False
        while k[i] in ("static", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor", "async", "get", "set", "*") and k[i + 1] not in ("(", "=", ";", ":", "?", "!", "<", ",") and i + 1 < end:
            abstract = abstract or k[i] == "abstract"
            i += 1
        if k[i] in ("(", "<", "new") and interface:
            return "call_signature", None
        if k[i] == "[" and k[i + 2] == ":":
            return "index_signature", None
        if k[i] == "{":
            return "class_static_block", None
        name = self.word(i) if k[i] != "[" else self.t.text[self.t.start[i] : self.t.end[self.t.match[i]]]
        j = self.t.match[i] + 1 if k[i] == "[" else i + 1
        j += k[j] in ("?", "!")
        if k[j] in ("(", "<"):
            if interface:
                return "method_signature", name
            return ("method_definition", name) if k[end - 1] == "}" else ("abstract_method_signature" if abstract else "method_signature", name)
        return ("property_signature" if interface else "public_field_definition"), name

    def properties(self, brace: int) -> list[Segment]:
        out, i, stop, pending = [], brace + 1, self.t.match[brace], None
        while i < stop:
            comment = self.comment_row(i - 1, i)
            pending = comment if pending is None else pending
            if self.t.kind[i] == ",":
                i, pending = i + 1, None
                continue
            end = self.rule["Prop"](i)
            if end <= i or end > stop:
                i, pending = i + 1, None
                continue
            k, j = self.t.kind, i
            while k[j] in ("async", "get", "set", "*") and k[j + 1] not in ("(", ":", ",", "}", "<"):
                j += 1
            key = self.t.match[j] if k[j] == "[" else j
            if k[i] == "...":
                kind, name = "spread_element", "..." + self.t.text[self.t.start[i + 1] : self.t.end[end - 1]]
            elif k[key + 1] == ":":
                kind, name = "pair", self.t.text[self.t.start[j] : self.t.end[key]]
            elif k[key + 1] in ("(", "<"):
                kind, name = "method_definition", self.t.text[self.t.start[j] : self.t.end[key]]
            elif end == i + 1:
                kind, name = "shorthand_property_identifier", None
            else:
                i, pending = end, None
                continue
            first, last = self.span(_Node(i, end, kind))
            part = Segment(pending if pending is not None else first, last, kind, name)
            if kind == "method_definition":
                part.blocks = self.function_blocks(i, end)
            out.append(part)
            i, pending = end, None
        return out

    def function_blocks(self, start: int, end: int) -> list[Segment]:
        brace = self.function_body(start, end)
        if brace is None:
            return []
        body = self.statements(brace + 1, self.t.match[brace])
        if len(body) == 1 and body[0].kind == "return_statement":
            inner = self._returned_function(body[0].start + 1, body[0].end)
            if inner:
                return self.function_blocks(*inner)
        return self.logical_blocks(body, BLOCK_DEPTH)

    def _returned_function(self, start: int, end: int) -> tuple[int, int] | None:
        for rule in ("Arrow", "FuncExpr"):
            stop = self.rule[rule](start)
            if 0 < stop <= end and (self.t.kind[stop] in (";", "}", ")", "as", "EOF") or self.t.newline[stop]):
                return start, stop
        if self.t.kind[start] == "await":
            return self._returned_function(start + 1, end)
        if self.t.kind[start] == "(" and start < self.t.match[start] < end:
            return self._returned_function(start + 1, self.t.match[start])
        return None

    def logical_blocks(self, nodes: list[_Node], depth: int) -> list[Segment]:
        out: list[Segment] = []
        for node in nodes:
            if node.kind not in BLOCKS:
                continue
            first, last = self.span(node)
            if last - first + 1 > LONG_BLOCK and depth > 0:
                inner = self.body_statements(node)
                if len(inner) > 1:
                    finer = self.logical_blocks(inner, depth - 1)
                    if len(finer) > 1:
                        out += finer
                        continue
            out.append(Segment(first, last, node.kind))
        return out

    def body_statements(self, node: _Node) -> list[_Node]:
        """Statements of the blocks directly under a compound statement, else-if chains as statements."""
        k, match, i, end, out = self.t.kind, self.t.match, node.start, node.end, []

        def block(at: int) -> int:
            out.extend(self.statements(at + 1, match[at]))
            return match[at] + 1

        if node.kind == "if_statement":
            i = match[i + 1] + 1
            i = block(i) if k[i] == "{" else self.rule["Stmt"](i)
            if 0 < i < end and k[i] == "else":
                if k[i + 1] == "{":
                    block(i + 1)
                elif k[i + 1] == "if":
                    out.append(_Node(i + 1, end, "if_statement"))
        elif node.kind in ("for_statement", "for_in_statement", "while_statement"):
            i += 2 if k[i + 1] == "await" else 1
            i = match[i] + 1
            if k[i] == "{":
                block(i)
        elif node.kind == "do_statement":
            if k[i + 1] == "{":
                block(i + 1)
        elif node.kind == "try_statement":
            i = block(i + 1)
            while i < end and k[i] in ("catch", "finally"):
                i += 1
                i = match[i] + 1 if k[i] == "(" else i
                i = block(i)
        return out

    def segments(self) -> list[Segment]:
        """Top-level semantic statements; consecutive comments before one belong to it, others are dropped."""
        out, pending, before = [], None, -1
        for node in self.statements(0, len(self.t.kind) - 1):
            comment = self.comment_row(before, node.start)
            pending = comment if pending is None else pending
            before = node.end - 1
            if node.kind not in SEMANTIC:
                pending = None
                continue
            first, last = self.span(node)
            part = Segment(pending if pending is not None else first, last, node.kind, self.name(node))
            pending = None
            inner = self.declaration(node)
            function = None
            if inner and inner.kind in CONTAINERS:
                part.children = self.members(node)
            else:
                function = self.function_of(node)
                if function:
                    part.blocks = self.function_blocks(*function)
            if not part.children and not function:
                literal = self.object_of(node)
                if literal:
                    part.children, part.owner = self.properties(literal[0]), literal[1]
            out.append(part)
        return out

"""Credentials in source and configuration text: finding and masking them.

Every literal (quoted strings, values of settings lines, values named in
comments) is cut into words by Viterbi: the cheapest reading of its characters
as dictionary words, pronounceable syllables, digits and separators, and, at a
higher price, unexplained characters. What stays unexplained makes a credential,
and the context sets how much is needed:

* nothing but an assignment: a long run of mixed character classes that has no
  known hash or data format;
* a name that asks for a credential: a shorter one, and hash formats count, as a
  key may look like one; a name that asks for a password: any character beyond
  plain words in lower case, as people choose passwords of words and digits;
* a structure that carries one (webhook address with a token, authorization
  header, private key): a run in the part that carries it; the password of a URL
  is one by its place, whatever its characters.

Placeholders, references and labels are left out by their form. Words come from
a public tokenizer's vocabulary, if it is there, and a short list of our own.
"""

from __future__ import annotations

import base64
import binascii
import math
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.codefiles import spread, task_count

# Words that explain text in names and literals.
WORDS = frozenset(
    """the and for not with your here this that must empty forgot enter please change changeme todo replace
    password passwd pass phrase secret token api key auth access private public header label client session user
    admin root app name host port data base database url uri http https internal example local simple value config
    setting path file node hash tree index search query vector chunk cache shard segment snapshot merkle budget quota
    limit range region signal stream symbol worker window table text type string number test none null true false
    font image html json text plain application charset utf mirror service server store storage buffer cursor frame
    corpus batch bucket policy payload probe ledger lease leaf anchor digest grammar manifest header select where from
    order group function return const export import default code generated edit version release license copyright""".split()
)
_WORD_COST, _SYLLABLE_COST, _DIGIT_COST, _PLAIN_COST, _UNEXPLAINED = 1.0, 1.6, 0.9, 0.4, 2.2
_MAX_SYLLABLES = 100  # of one piece of a run
_VOWELS = frozenset("aeiou")


@lru_cache(maxsize=4)
def vocabulary_words(path: str | None) -> frozenset[str]:
    """Words of at least four lower-case letters that a .tiktoken rank file holds whole (with a blank before them); none if there is no file."""
    if not path or not os.path.exists(path):
        return frozenset()
    with open(path, "rb") as ranks:
        tokens = (base64.b64decode(line.split()[0]) for line in ranks if line.strip())
        return frozenset(t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{4,}", t))


class Lexicon:
    """Cuts texts into words; short texts, which recur, are remembered."""

    def __init__(self, words: frozenset[str] = frozenset()):
        self.words = WORDS | words
        self.longest = max(map(len, self.words))
        self._remembered = lru_cache(maxsize=65536)(self._longest_unexplained)

    def residual(self, text: str) -> str:
        """The longest unexplained stretch of a text."""
        return self._remembered(text) if len(text) <= 200 else self._longest_unexplained(text)

    def strength(self, text: str) -> int:
        """Length of the unexplained stretch, and one for each kind of character beyond the first."""
        kinds = (any(c.isdigit() for c in text), any(c.islower() for c in text), any(c.isupper() for c in text), any(not c.isalnum() and not c.isspace() for c in text))
        return len(self.residual(text)) + sum(kinds) - 1

    def _longest_unexplained(self, text: str) -> str:
        """The characters of the longest stretch that the cheapest segmentation leaves unexplained.

        Separators and digits inside the stretch belong to it. Words must be in one
        letter case (lower, upper or capital first); a syllable is a consonant and
        a vowel of the same case inside a run of at least two syllables; a longer run
        is read in pieces of up to `_MAX_SYLLABLES`, so the work is linear.
        """
        words, longest_word = self.words, self.longest
        n, lower = len(text), text.lower()
        best = [0.0] + [math.inf] * n
        how: list[tuple[int, bool]] = [(0, True)] * (n + 1)
        for i in range(n):
            cost = best[i]
            ch = text[i]
            step = _DIGIT_COST if ch.isdigit() else _UNEXPLAINED if ch.isalpha() else _PLAIN_COST
            if cost + step < best[i + 1]:
                best[i + 1], how[i + 1] = cost + step, (i, not ch.isalpha())
            if not ch.isalpha():
                continue
            for j in range(i + 3, min(n, i + longest_word) + 1):
                if not lower[j - 1].isalpha():
                    break
                if lower[i:j] in words and (text[i:j].islower() or text[i:j].isupper() or text[i + 1 : j].islower()):
                    if cost + _WORD_COST < best[j]:
                        best[j], how[j] = cost + _WORD_COST, (i, True)
            j = i
            while j + 1 < n and j < i + 2 * _MAX_SYLLABLES and lower[j].isalpha() and lower[j].isascii() and lower[j] not in _VOWELS and lower[j + 1] in _VOWELS and (j == i or (text[j] + text[j + 1]).islower() or text[i : j + 2].isupper()) and (text[j + 1].islower() or text[i : j + 2].isupper()):
                j += 2
                price = cost + _SYLLABLE_COST * (j - i) / 2
                if j - i >= 4 and price < best[j]:
                    best[j], how[j] = price, (i, True)
        pieces = []
        i = n
        while i > 0:
            start, known = how[i]
            pieces.append((start, i, known))
            i = start
        longest, begin = (0, 0), -1  # begin of the stretch, or -1
        for start, end, known in reversed(pieces):
            piece = text[start:end]
            if not known or piece.isdigit():
                begin = start if begin < 0 else begin
            elif begin < 0 or not (len(piece) <= 1 and piece in "+/=_-." or len(piece) <= 4):  # a short word by chance within noise belongs to it
                begin = -1
            if begin >= 0 and end - begin > longest[1] - longest[0]:
                longest = (begin, end)
        return text[longest[0] : longest[1]]


PLAIN = Lexicon()


def residual(text: str) -> str:
    """The longest stretch of a text that the built-in words leave unexplained."""
    return PLAIN.residual(text)


_HASH = re.compile(
    r"^(?:[0-9a-fA-F]{7,128}|(?:md5|sha1|sha224|sha256|sha384|sha512)[-:][A-Za-z0-9+/=]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
)
_REFERENCE = re.compile(r"\$[A-Z_]++\b|%\(\w++\)s|%[A-Z_]++%|<[^<>]*+>|process\.env|os\.environ|getenv|\bvault[:.]|\bssm:|secretsmanager|@@\w+@@")
_FRAMES = (("${", "}"), ("{{", "}}"), ("$(", ")"), ("#{", "}"))
_PLACEHOLDER = re.compile(
    r"^(?:x{3,}|\*{3,}|\.{3,}|-{3,}|_{3,}|0{4,}|1234\d*|change[-_ ]?(?:me|this|it)!?|to[-_ ]?do|fix[-_ ]?me|tbd|replace[-_ ]?(?:me|this)?.*|your[-_ ].*|my[-_ ](?:secret|password|token|key).*|none|null|nil|undefined|true|false|example.*|sample.*|dummy.*|test(?:ing)?|redacted|masked|hidden|secret|password|passwd|token|placeholder.*|insert[-_ ].*|enter[-_ ].*|n/?a)$",
    re.I,
)
_CREDENTIAL_NAME = re.compile(
    r"passw(?:or)?d|passphrase|pwd|(?:db|admin|user|root|smtp|ftp|redis|pg|mysql|login)_?pass|^pass$|secret|(?:access|auth|refresh|bearer|id|bot|session|csrf|personal|deploy|api|git|npm|slack)_?token|^token$|_token$|api_?key|(?:secret|signing|private|encryption|crypt|master|account|storage|license|ssh|service|deploy|shared|host|aes|hmac)_?key|credential|authorization|proxy_?auth|auth_?header|^auth$|_auth$|jwt|bearer"
)
_OTHER_NAME = re.compile(r"label|hint|prompt|message|text|title|header_?name|token_?header|budget|sort_?key|group_?key|cache_?key|key_?id|public|^pub_?|_pub$|hash|checksum|digest|integrity|revision|commit|request_?id|placeholder|error|regex|pattern|field|column|_name$|_url$|_path$|_file$|length|size|limit|policy|count|expiry|ttl|type$")
_PASSWORD_NAME = re.compile(r"passw(?:or)?d|passphrase|pwd|pass$|pass_")

_URL = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://([^\s/:@'\"`]*+):([^\s@/'\"`]++)@[^\s'\"`]++", re.I)
_WEB = re.compile(r"https?://[^\s'\"`]++", re.I)
_HOOK_TOKEN = re.compile(r"(?=[A-Za-z_-]*+\d)(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+")
_AUTH = re.compile(r"^\s*(Basic|Bearer|Token|Digest|ApiKey)\s+(\S{8,})\s*$", re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_ALL = re.compile(r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)((?:(?!-----)[\s\S])*)(-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?")
_JWT = re.compile(r"^eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}$")


class Span(NamedTuple):
    """A place of a credential in a text, and what it is."""

    start: int
    end: int
    kind: str


def _flat(name: str) -> str:
    """A name in lower case with underscores between its words."""
    return re.sub(r"[\W_]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)).strip("_").lower()


@lru_cache(maxsize=65536)
def asks_for_credential(name: str) -> bool:
    """Whether a name means a credential, as `dbPassword` does and `passwordLabel` and `sortKey` do not."""
    flat = _flat(name)
    if not flat:
        return False
    return bool(_CREDENTIAL_NAME.search(flat) or _CREDENTIAL_NAME.search(flat.replace("_", ""))) and not (_OTHER_NAME.search(flat) or re.search(r"label|header$|tokenheader|budget|keyid|sortkey", flat.replace("_", "").replace("authheader", "").replace("authorizationheader", "")))


def _placeholder(value: str) -> bool:
    bare = value.strip().strip("\"'`")
    if _REFERENCE.search(bare) or _PLACEHOLDER.match(bare):
        return True
    if any((i := bare.find(a)) >= 0 and bare.find(b, i + 2) >= 0 for a, b in _FRAMES):
        return True
    core = re.sub(r"[^A-Za-z0-9]", "", bare)
    return len(set(core.lower())) <= 3 or bool(re.search(r"(.)\1{5,}", core)) or bool(re.search(r"x{8,}", core, re.I))


def _mixed(run: str) -> bool:
    classes = sum((any(c.isdigit() for c in run), any(c.islower() for c in run), any(c.isupper() for c in run)))
    return classes >= 2 and len(set(run)) >= 8


_NOTABLE = re.compile(r"://|-----BEGIN|[A-Za-z0-9_.-]{14}|^\s*(?:Basic|Bearer|Token|Digest|ApiKey)\s", re.I)


def _hook_tokens(value: str) -> Iterator[tuple[int, int]]:
    """Places of the tokens of webhook addresses: the first part of the path after the word that looks like one and ends the address or its path."""
    for web in _WEB.finditer(value):
        at = web[0].lower().find("hook", web[0].find("://") + 3)
        at = web[0].find("/", at) if at >= 0 else -1
        while at >= 0:
            m = _HOOK_TOKEN.match(web[0], at + 1)
            if m and (m.end() == len(web[0]) or web[0][m.end()] == "?"):
                yield web.start() + m.start(), web.start() + m.end()
                break
            at = web[0].find("/", at + 1)


def classify(name: str, value: str, lexicon: Lexicon = PLAIN) -> list[Span]:
    """Credential spans of one literal value given to `name`; offsets count from the value's start."""
    if len(value) < 6 or not (_NOTABLE.search(value) or asks_for_credential(name)):
        return []
    spans: list[Span] = []
    for m in _URL.finditer(value) if "://" in value else ():
        if not _placeholder(m[2]):
            spans.append(Span(m.start(2), m.end(2), "url"))
    for a, b in _hook_tokens(value) if "://" in value else ():
        if not _placeholder(value[a:b]) and len(lexicon.residual(value[a:b])) >= 8:
            spans.append(Span(a, b, "webhook"))
    if spans:
        return spans
    if _PEM.search(value):
        m = _PEM_ALL.search(value)
        return [Span(m.start(), m.end(), "private_key")] if _holds_key(m, lexicon) else []
    if "-----BEGIN" in value or re.match(r"\s*(?:data:|[a-z][a-z0-9+.-]*://|sourceMappingURL)", value):
        return []
    m = _AUTH.match(value)
    if m and not _placeholder(m[2]):
        if m[1].lower() == "basic":
            try:
                if b":" in base64.b64decode(m[2], validate=True):
                    return [Span(m.start(2), m.end(2), "header")]
            except (binascii.Error, ValueError):
                pass
        elif len(lexicon.residual(m[2])) >= 8 or _HASH.match(m[2]):
            return [Span(m.start(2), m.end(2), "header")]
        return []
    bare = value.strip()
    lead = len(value) - len(value.lstrip())
    whole = [Span(lead, lead + len(bare), "literal")]
    if not bare or _placeholder(bare):
        return []
    plain = not re.search(r"\s", bare)
    if asks_for_credential(name):
        if _PASSWORD_NAME.search(_flat(name)):
            return whole if lexicon.strength(bare) >= 1 and not re.fullmatch(r"[a-z]+|[\d.]+", bare) and (plain or re.search(r"\d", bare)) else []
        if not plain or len(bare) < 8 or re.fullmatch(r"[\d.]+", bare):
            return []
        return whole if len(lexicon.residual(bare)) >= 6 or _HASH.match(bare) else []
    if not plain:
        return []
    run = lexicon.residual(bare) if len(bare) >= 14 else ""
    if _JWT.match(bare):
        return whole if len(run) >= 14 else []
    if _HASH.match(bare) or re.search(r"[+/=(){}\[\]<>;:,@\\$%!?*&|^~`'\"#]", bare):
        return []  # hashes, data, code and paths; keys of known kinds use letters, digits and _-. only
    return whole if len(run) >= 14 and _mixed(run) and not _HASH.match(run) else []


def _holds_key(m: re.Match, lexicon: Lexicon) -> bool:
    """Whether a private key's frame has more in it than words and references."""
    body = m[2].replace("\\n", "\n").strip(" \t\r\n\"'`+,")
    return not body or (not _REFERENCE.search(body) and any(len(lexicon.residual(x)) >= 8 for x in re.findall(r"[A-Za-z0-9+/=]{8,}", body)))


_CODE_LITERAL = r"""\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_SLASH = re.compile(rf"(?P<S>{_CODE_LITERAL})|(?P<C>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))")
_HASHED = re.compile(rf"(?P<S>{_CODE_LITERAL})|(?P<C>\#[^\n]*)")
_IS_KEY = re.compile(r"\s*:(?!:)")
_JOIN = re.compile(r"""\s*(?:\+\s*|\\\r?\n\s*)?(?:[furbFURB]{1,2}(?=["']))?""")
_SETTING = re.compile(r"""^[ \t]*(?:-[ \t]+)?(?:export[ \t]+)?["']?([A-Za-z_][\w.-]*)["']?[ \t]*(=|:(?=\s))[ \t]*(.*?)[ \t]*\r?$""", re.M)
_NAMED_IN_COMMENT = re.compile(r"""(?<![\w.-])([A-Za-z_][\w.-]*)\s*(?:=|:)\s*["'`]?([^\s"'`](?:[^\n"'`]*[^\s"'`,;*/])?)""")
_FURTHER_NAME = re.compile(r"[\s,;](?=[A-Za-z_][\w.-]*(?:\s*=|:\s))")
_BARE_URL = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s'\"`]++", re.I)


def _back(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _own_name(text: str, at: int) -> str:
    """The name that ends at `at`, perhaps in quotes or an index; walked backwards."""
    at = _back(text, at)
    if at and text[at - 1] == "]":
        at = _back(text, at - 1)
    if at and text[at - 1] in "\"'`":
        at -= 1
    begin = at
    while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_$.-"):
        begin -= 1
    while begin < at and not ((text[begin].isascii() and text[begin].isalpha()) or text[begin] in "_$"):
        begin += 1
    return text[begin:at]


def _name_before(text: str, at: int) -> str:
    """The name a literal that starts at `at` is given to, or compared with, or passed after; empty if there is none.

    Between the two may stand blanks, a bracket, one of `= == === != := : , (`
    and a type annotation. Nothing is walked over twice, as a quote ends the walk.
    """
    lead = at
    while lead and at - lead < 2 and text[lead - 1] in "furbFURB":
        lead -= 1
    if lead < at and lead and (text[lead - 1].isspace() or text[lead - 1] in "([=:,"):
        at = lead
    at = _back(text, at)
    starts = [_back(text, at - 1), at] if at and text[at - 1] in "([" else [at]
    for i in starts:
        if not i:
            continue
        if text[i - 1] == "=":
            j = i - 1
            while j and i - j < 3 and text[j - 1] == "=":
                j -= 1
            if j and text[j - 1] in "!:":
                j -= 1
        elif text[i - 1] in ":,(":
            j = i - 1
        else:
            continue
        j = kind = _back(text, j)
        while kind and (text[kind - 1].isalnum() or text[kind - 1] in "_<>[]|. "):
            kind -= 1
        if kind < j and kind and text[kind - 1] == ":":
            typed = _own_name(text, kind - 2 if kind > 1 and text[kind - 2] == "?" else kind - 1)
            if typed:
                return typed
        name = _own_name(text, j)
        if name:
            return name
    return ""


def find_secrets(path: str | None, content: str | None, lexicon: Lexicon = PLAIN) -> list[Span]:
    """Spans of the credentials in one content, in order of place.

    The span of a value cut into several literals starts in its first piece and
    ends with its last. A null content has none; the language follows the path.
    """
    if not content:
        return []
    base = (path or "").rsplit("/", 1)[-1].lower()
    if base.endswith((".yaml", ".yml")) or base.startswith(".env") or ".env." in base or base.endswith(".env"):
        return _in_settings(content, lexicon)
    hashed = base.endswith(".py")
    out: list[Span] = []
    pending: list[tuple[int, int, str]] = []  # pieces of one value

    def flush() -> None:
        if not pending:
            return
        start = pending[0][0]
        name = pending[0][2]
        if len(pending) == 1:
            value = content[start : pending[0][1]]
            out.extend(Span(start + s.start, start + s.end, s.kind) for s in classify(name, value, lexicon))
        else:
            value = "".join(content[a:b] for a, b, _ in pending)
            if classify(name, value, lexicon):
                out.append(Span(start, pending[-1][1], "pieces"))
        pending.clear()

    last_end = -1
    for m in (_HASHED if hashed else _SLASH).finditer(content):
        if m.lastgroup == "C":
            flush()
            last_end = -1
            out.extend(Span(m.start() + x.start, m.start() + x.end, x.kind) for x in _in_comment(m[0], lexicon))
            continue
        literal = m[0]
        mark = 3 if literal.startswith(('"""', "'''")) else 1
        closed = 3 if mark == 3 and literal.endswith(literal[:3]) and len(literal) >= 6 else 1 if mark == 1 and len(literal) > 1 and literal[-1] == literal[0] else 0
        start, end = m.start() + mark, m.end() - closed
        gap = content[last_end : m.start()] if last_end >= 0 else None
        if gap is not None and _JOIN.fullmatch(gap) and ("+" in gap or hashed or "\\" in gap):
            pending.append((start, end, pending[0][2] if pending else ""))
        else:
            flush()
            if _IS_KEY.match(content, m.end()):  # a member's name is no value
                last_end = -1
                continue
            pending.append((start, end, _name_before(content, m.start()).rsplit(".", 1)[-1]))
        last_end = m.end()
    flush()
    for m in _PEM_ALL.finditer(content):  # keys outside literals
        if not any(s.start <= m.start() < s.end for s in out) and _holds_key(m, lexicon):
            out.append(Span(m.start(), m.end(), "private_key"))
    return _apart(out)


def _apart(spans: list[Span]) -> list[Span]:
    """Spans in order of place without those that overlap an earlier or, at one start, a longer one."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end, s.kind)):
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


def _in_comment(comment: str, lexicon: Lexicon) -> list[Span]:
    """Every named credential of a comment, also of several in a line, and every URL with one."""
    out: list[Span] = []
    if "=" in comment or ":" in comment:
        cuts = [0, *[m.end() for m in _FURTHER_NAME.finditer(comment)], len(comment)]
        parts = [(a, n) for a, b in zip(cuts, cuts[1:]) for n in _NAMED_IN_COMMENT.finditer(comment[a:b])]
        for at, n in parts:
            if not n[2].startswith("//"):
                out.extend(Span(at + n.start(2) + s.start, at + n.start(2) + s.end, s.kind) for s in classify(n[1], n[2], lexicon))
        for u in _BARE_URL.finditer(comment) if "://" in comment else ():
            out.extend(Span(u.start() + s.start, u.start() + s.end, s.kind) for s in classify("", u[0], lexicon))
        out = _apart(out)
        if len(cuts) > 2:  # values that hold what looks like a further name
            for n in _NAMED_IN_COMMENT.finditer(comment):
                if not n[2].startswith("//"):
                    whole = [Span(n.start(2) + s.start, n.start(2) + s.end, s.kind) for s in classify(n[1], n[2], lexicon)]
                    first = bisect_left(out, (n.start(2),))
                    if not (first < len(out) and out[first].start < n.end(2)):
                        out[first:first] = [w for w in whole if not first or out[first - 1].end <= w.start]
    return out


def _in_settings(content: str, lexicon: Lexicon) -> list[Span]:
    out: list[Span] = []
    for m in _PEM_ALL.finditer(content):
        if _holds_key(m, lexicon):
            out.append(Span(m.start(), m.end(), "private_key"))
    for m in _SETTING.finditer(content):
        if any(s.start < m.end() and m.start() < s.end for s in out):
            continue
        value, at = m[3], m.start(3)
        if value[:1] in "\"'" and value[:1]:
            close = value.find(value[0], 1)
            value, at = value[1 : close if close > 0 else None], at + 1
        else:
            value = re.sub(r"\s+#.*$", "", value)
        out.extend(Span(at + s.start, at + s.end, s.kind) for s in classify(m[1], value, lexicon))
    for m in re.finditer(r"^[ \t]*#([^\n]*)", content, re.M):
        out.extend(Span(m.start(1) + s.start, m.start(1) + s.end, s.kind) for s in _in_comment(m[1], lexicon))
    return _apart(out)


MASK = "REDACTED"


def _masked(match_text: str, kind: str) -> str:
    if kind == "pieces":  # the first piece carries the mask, the others become empty; quotes and joins stay
        quote = next((c for c in match_text if c in "\"'`"), '"')
        parts = re.split(rf"({re.escape(quote)}[^\"'`]*?{re.escape(quote)})", match_text)
        return MASK + "".join(p if i % 2 else "" for i, p in enumerate(parts))
    if kind == "private_key":
        m = _PEM_ALL.match(match_text)
        body = re.sub(r"[A-Za-z0-9+/=]+", lambda w: w[0] if w[0] == "n" else "*" * 0 + MASK if len(w[0]) > 2 else "", m[2].replace("\\n", "\x00")).replace("\x00", "\\n")
        return m[1] + body + (m[3] or "")
    return MASK


def redact(path: str | None, content: str | None, lexicon: Lexicon = PLAIN) -> str | None:
    """The content with only the credential values masked; literals keep their quotes, keys their frame and lines."""
    if content is None:
        return None
    out, at = [], 0
    for s in find_secrets(path, content, lexicon):
        if s.start < at:
            continue
        out += [content[at : s.start], _masked(content[s.start : s.end], s.kind)]
        at = s.end
    return "".join([*out, content[at:]])


FOUND_SCHEMA = "row_id long, file_path string, line_no int, start_char int, end_char int, kind string"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _lexicon(words: frozenset[str]) -> Lexicon:
    return Lexicon(words)


def secret_places(chunks: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Each credential once: row_id, file_path, line_no (1-based in content), start_char, end_char, kind.

    Records delivered again have the same row_id and values, so their places are
    the same and one is kept. `vocabulary` is a rank file on the driver, whose
    words go to the tasks; without it the built-in words serve alone. Rows
    with null row_id or content give none.
    """
    words = vocabulary_words(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(words)
        for pdf in batches:
            rows = []
            for row_id, path, content in zip(pdf["row_id"], pdf["file_path"], pdf["content"]):
                at, line = 0, 1
                for s in find_secrets(path, content, lexicon):
                    line, at = line + content.count("\n", at, s.start), s.start
                    rows.append((row_id, path, line, s.start, s.end, s.kind))
            yield pd.DataFrame(rows, columns=["row_id", "file_path", "line_no", "start_char", "end_char", "kind"])

    ready = chunks.select("row_id", "file_path", "content").dropna(subset=["row_id", "content"])
    return spread(ready).mapInPandas(run, FOUND_SCHEMA).dropDuplicates(["row_id", "start_char", "end_char"])


def redacted_chunks(chunks: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Each record once with its content masked: row_id, file_path, redacted, changed. A null content stays null.

    Contents are shuffled once, by row_id, into as many partitions as the work needs.
    """
    words = vocabulary_words(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(words)
        for pdf in batches:
            masked = [redact(p, c, lexicon) for p, c in zip(pdf["file_path"], pdf["content"])]
            yield pd.DataFrame({"row_id": pdf["row_id"], "file_path": pdf["file_path"], "redacted": masked, "changed": [a != b for a, b in zip(masked, pdf["content"])]})

    ready = chunks.select("row_id", "file_path", "content").dropna(subset=["row_id"]).repartition(task_count(chunks.sparkSession), "row_id").dropDuplicates(["row_id"])
    return ready.mapInPandas(run, "row_id long, file_path string, redacted string, changed boolean")

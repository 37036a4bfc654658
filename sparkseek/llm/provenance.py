"""Source files nobody wrote by hand here: generated, minified, third-party, data.

Copies are told by content: token streams (comments, letter case, quotes and
layout removed) are fingerprinted by winnowing, the repositories of every
fingerprint are counted, and files most of whose fingerprints recur in several
repositories are suspects. As hand-written code is copied between repositories
too, a mark has to confirm one: a banner or folder of third-party code on the file
itself or on files that hold most of its fingerprints. What is generated,
minified or data recurs nowhere and is told by its banner, name or shape.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..operators.codefiles import FILE, extension, whole_files

# The extensions that can be cases, folders and names of each kind.
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".cjs", ".py")
VENDOR_FOLDERS = frozenset("node_modules bower_components third_party third-party thirdparty vendor deps external extern externals jspm_packages site-packages".split())
GENERATED_FOLDERS = frozenset("__generated__ _generated gen generated codegen autogen .generated".split())
_GENERATED_NAME = re.compile(r"\.g\.(?:ts|js|py)$|_pb\.(?:ts|js|py)$|_pb2(?:_grpc)?\.py$|\.pb\.(?:ts|js)$|[._-](?:generated|autogen|designer)\.\w+$", re.I)
_MINIFIED_NAME = re.compile(r"[.-]min\.(?:js|cjs)$", re.I)
_GENERATED = re.compile(
    r"auto[- ]?generated|@generated\b|(?:code|file|source)\s+(?:was\s+|is\s+)?(?:automatically\s+)?(?:generated|produced|created)|\bgenerated (?:by|from|with|using)|do not (?:edit|modify)|nicht von hand|automatisch (?:erzeugt|generiert)|machine[- ](?:written|generated)|(?:changes|edits)[^\n]{0,20} (?:will|would) be (?:overwritten|lost)|regenerate instead|généré automatiquement|generado automáticamente",
    re.I,
)
_THIRD_PARTY = re.compile(
    r"/\*!|upstream\s*:|\(c\) the [^\n|]*(?:contributors|authors)|copyright \(c\)[^\n]*(?:contributors|authors)|released under the [^\n]*licen[cs]e|^[ \t]*(?://|\*|#)?[ \t]*[\w./-]+@\d+\.\d+\.\d+\b|\bv?\d+\.\d+\.\d+[^\n]*\|[^\n]*licen[cs]e|spdx-license-identifier:(?=[\s\S]*upstream)|(?:vendored|copied|bundled|imported) from https?://",
    re.I | re.M,
)
_HEAD_SLASH = re.compile(r"\s*(?:#![^\n]*\n\s*)?((?:(?://[^\n]*|/\*[\s\S]*?\*/)\s*)*)")
_HEAD_HASH = re.compile(r"\s*((?:#[^\n]*\s*)*(?:(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')\s*)?)")
_LINE_COMMENT = re.compile(r"[ \t]*//")
_BLOCK_OPENS = re.compile(r"^[ \t]*/\*", re.M)
_COMMENT_SLASH = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")
_COMMENT_HASH = re.compile(r"(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|\#[^\n]*")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`")
_DATA = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|\b0[xX][0-9a-fA-F]+|\b\d[\d._eE+-]*|[\[\](){},:]")
_MAYBE_DATA = str.maketrans("", "", "0123456789abcdefABCDEFxX._+-[](){},:\"'`")
_SERIAL = re.compile(r"^(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:interface|function|class|const|let|type|enum|def)[ \t]+[A-Za-z_$][\w$]*?(\d+)\b|^[A-Za-z_]\w*?(\d+)[ \t]*=", re.M)
_TOP = re.compile(r"^(?!import\b|from\b)[A-Za-z_@][^\n]*", re.M)
_TOKEN = re.compile(r"\w+|[^\w\s;,\"'`]")

MIN_DATA_CHARS, MIN_DATA_SHARE = 1200, 0.8
MAX_MINIFIED_SPACE, MIN_MINIFIED_LINE, MIN_MINIFIED_CHARS = 0.07, 80, 200
MIN_SERIAL, GRAM, WINDOW, COPY_SHARE = 8, 10, 8, 0.7


def _tail_comments(text: str, python: bool) -> str:
    """The comments that end the text, each beginning on a line of its own; read from the end, comment by comment."""
    end = begin = len(text.rstrip())
    while begin > 0:
        line = text.rfind("\n", 0, begin) + 1
        if text.startswith("#", line) if python else _LINE_COMMENT.match(text, line, begin):
            begin = line
        elif not python and text.endswith("*/", 0, begin):
            before = text.rfind("*/", 0, begin - 2)
            m = _BLOCK_OPENS.search(text, before + 2 if before >= 0 else 0, begin)
            if not m:
                break
            begin = m.start()
        else:
            break
        while begin and text[begin - 1].isspace():
            begin -= 1
    return text[begin:end]


def _comments_at_ends(text: str, python: bool) -> str:
    head = (_HEAD_HASH if python else _HEAD_SLASH).match(text)
    return (head[1] if head else "") + "\n" + _tail_comments(text, python)


def _bare(text: str, python: bool) -> str:
    """The text without its comments."""
    return (_COMMENT_HASH if python else _COMMENT_SLASH).sub(lambda m: m[1] or " ", text)


def own_marks(path: str, text: str) -> str | None:
    """`third_party`, `generated`, `data` or `minified` by what the file itself shows; else None."""
    return marks_and_code(path, text)[0]


def marks_and_code(path: str, text: str) -> tuple[str | None, str | None]:
    """own_marks and, where they had to read it, the text without its comments."""
    bare: list[str] = []
    return _marks(path, text, bare), bare[0] if bare else None


def _marks(path: str, text: str, read: list[str]) -> str | None:
    folders = [f.lower() for f in path.replace("\\", "/").split("/")]
    name, python = folders.pop(), path.lower().endswith(".py")
    if VENDOR_FOLDERS & set(folders):
        return "third_party"
    ends = _comments_at_ends(text, python)
    if _GENERATED.search(ends):
        return "generated"
    if _THIRD_PARTY.search(ends):
        return "third_party"
    if GENERATED_FOLDERS & set(folders) or _GENERATED_NAME.search(name):
        return "generated"
    bare = _bare(text, python)
    read.append(bare)
    numbers = [int(a or b) for a, b in _SERIAL.findall(bare)]
    steps = sum(y == x + 1 for x, y in zip(numbers, numbers[1:]))
    if len(numbers) >= MIN_SERIAL and steps >= 0.9 * (len(numbers) - 1) and len(numbers) >= 0.7 * len(_TOP.findall(bare)):
        return "generated"
    dense, code = len("".join(bare.split())), _LITERAL.sub('""', bare)
    packed = "".join(code.split())
    # what stands outside literals and is in no number or bracket can't be data, whatever the rest is
    if dense >= MIN_DATA_CHARS and dense - len(packed.translate(_MAYBE_DATA)) >= MIN_DATA_SHARE * dense:
        data = len("".join("".join(_DATA.findall(bare)).split()))
        if data >= MIN_DATA_SHARE * dense:
            return "data"
    lines = [x for x in code.split("\n") if x.strip()]
    if len(code) >= MIN_MINIFIED_CHARS and lines:
        space = 1 - len(packed) / len(code)
        if space <= MAX_MINIFIED_SPACE and len(code) / len(lines) >= MIN_MINIFIED_LINE and re.search(r"[;{}=]", code):
            return "minified"
    if _MINIFIED_NAME.search(name):
        return "minified"
    return None


class _Codes(dict):
    """Codes of tokens; those of recurring ones are kept."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        code = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return code


_CODES = _Codes()


def winnow(path: str, text: str, bare: str | None = None) -> np.ndarray:
    """Winnowed fingerprints of the normalised token stream: the least hash of every window, each once."""
    tokens = _TOKEN.findall((_bare(text, path.lower().endswith(".py")) if bare is None else bare).lower())
    if not tokens:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(_CODES.__getitem__, tokens), np.uint64, len(tokens))
    grams = _rolling(codes + np.uint64(1), min(GRAM, len(codes)))
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    if len(grams) > WINDOW:
        grams = _least(grams, WINDOW)
    grams.sort()
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))].astype(np.int64)


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """The polynomial hash of every run of `size` codes, put together from those of half the size."""
    out, width, base = codes, 1, 0x9E3779B97F4A7C15
    for bit in bin(size)[3:]:
        out = out[:-width] * np.uint64(pow(base, width, 1 << 64)) + out[width:]
        width *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(base) + codes[width:]
            width += 1
    return out


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every window of `size` values."""
    width = 1
    while width < size:
        step = min(width, size - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


_MARKED = "repo string, root_dir string, file_path string, kind string, prints array<bigint>"


def _mark_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kinds, prints = [], []
        for path, text in zip(pdf["file_path"], pdf["text"]):
            kind, bare = marks_and_code(path, text)
            kinds.append(kind)
            prints.append(winnow(path, text, bare).tolist() if kind in (None, "third_party") else [])
        out = pdf[FILE].copy()
        out["kind"], out["prints"] = kinds, prints
        yield out


def marked_files(files: DataFrame) -> DataFrame:
    """Each code file with the kind it shows itself (or null) and, for third-party and unmarked ones, its fingerprints."""
    code = files.filter(F.col("file_path").isNotNull() & extension(F.col("file_path")).isin(*CODE_EXTENSIONS))
    return code.select(*FILE, F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_mark_batches, _MARKED)


def _print_table(marked: DataFrame) -> DataFrame:
    """print, recurs (in at least two repositories), third (in a file marked as third-party), of the prints that have either.

    Whether a print has two repositories shows in the least and greatest of
    their hashes, which combine before the shuffle however often a print occurs.
    """
    each = marked.select(F.explode("prints").alias("print"), F.xxhash64("repo").alias("repo"), (F.col("kind").isNotNull()).cast("int").alias("third"))
    counted = each.groupBy("print").agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.max("third").alias("third"))
    return counted.select("print", (F.col("a") != F.col("b")).cast("int").alias("recurs"), "third").filter("recurs = 1 OR third = 1")


def foreign_files(files: DataFrame, copy_share: float = COPY_SHARE) -> DataFrame:
    """Files not written by hand here: repo, root_dir, file_path, kind, share, recurring.

    kind is generated, minified, data; copy (at least copy_share of its
    fingerprints recur in other repositories, and a mark of its own or of files
    with copy_share of them says third-party); or third_party (such a mark, but
    the fingerprints don't recur). share is the share of fingerprints in marked
    files, recurring that in several repositories; both are null for other kinds.
    Empty files and files of other extensions are no cases; a null text is
    empty. A fingerprint that very many files share meets one row of the table
    of fingerprints.
    """
    marked = cut(marked_files(files))
    open_files = marked.filter("kind IS NULL OR kind = 'third_party'")
    prints = open_files.select(*FILE, "kind", F.size("prints").alias("total"), F.explode("prints").alias("print"))
    shares = prints.join(_print_table(open_files), "print").groupBy(*FILE, "kind", "total").agg((F.sum("third") / F.col("total")).alias("share"), (F.sum("recurs") / F.col("total")).alias("recurring"))
    copies = shares.filter(F.col("share") >= copy_share)  # all of a marked file's prints are in a marked file
    told = F.when(F.col("recurring") >= copy_share, "copy").otherwise("third_party")
    bare = marked.filter("kind = 'third_party' AND size(prints) = 0").select(*FILE, "kind", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("recurring"))
    other = marked.filter("kind <> 'third_party'").select(*FILE, "kind", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("recurring"))
    return copies.select(*FILE, told.alias("kind"), F.round("share", 6).alias("share"), F.round("recurring", 6).alias("recurring")).unionByName(bare).unionByName(other)


def foreign_code(chunks: DataFrame) -> DataFrame:
    """foreign_files of chunk records."""
    return foreign_files(whole_files(chunks))


def recurrence_report(chunks: DataFrame) -> DataFrame:
    """For each third-party file: its fingerprints and how many of them recur in other repositories."""
    marked = cut(marked_files(whole_files(chunks)))
    prints = marked.select(*FILE, "kind", F.explode("prints").alias("print"))
    spread = prints.groupBy("print").agg(F.approx_count_distinct("repo").alias("repos"))
    return prints.filter("kind = 'third_party'").join(spread, "print").groupBy(*FILE).agg(F.count(F.lit(1)).alias("prints"), F.count_if(F.col("repos") > 1).alias("recurring"), F.max("repos").alias("most_repos"))

"""Source files that do not parse, by packrat grammars; where and why, and rates."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codefiles import FILE, extension, whole_files
from ..syntax.grammars import LANGUAGES, furthest_failure

PARSE_SCHEMA = "repo string, root_dir string, file_path string, language string, valid boolean, line int, col int, cause string"
_MARKER = re.compile(r"^(?:<{7}|\|{7}|={7}|>{7})(?: |$|\r)", re.M)


def parse_verdict(language: str, text: str) -> tuple[bool, int | None, int | None, str | None]:
    """(valid, line, column, cause) of one text; line and column (1-based) of the furthest failure.

    Causes: `conflict` (merge markers in a text that fails), `truncated` (failure
    at the end of the text), `language` (the whole text is valid in another of
    the languages, or fails at its first token), `syntax`.
    """
    tokens, far = furthest_failure(language, text)
    if far < 0:
        return True, None, None, None
    at = min(tokens.start[far], len(text))
    line, col = text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1
    if _MARKER.search(text):
        cause = "conflict"
    elif far <= 1 or any(other != language and furthest_failure(other, text)[1] < 0 for other in ("ts", "tsx", "python", "json")):
        cause = "language"
    elif tokens.kind[far] == "EOF":
        cause = "truncated"
    else:
        cause = "syntax"
    return False, line, col, cause


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(1_000_000)
    for pdf in batches:
        verdicts = [parse_verdict(lang, text) for lang, text in zip(pdf["language"], pdf["text"])]
        out = pdf[[*FILE, "language"]].copy()
        out["valid"] = [v[0] for v in verdicts]
        out["line"] = pd.array([v[1] for v in verdicts], dtype="Int32")
        out["col"] = pd.array([v[2] for v in verdicts], dtype="Int32")
        out["cause"] = [v[3] for v in verdicts]
        yield out


def with_language(files: DataFrame) -> DataFrame:
    """Files in one of the languages read here, by extension in any letter case; others are left out."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return files.withColumn("language", F.create_map(*pairs)[extension(F.col("file_path"))]).dropna(subset=["language"])


def parse_files(files: DataFrame) -> DataFrame:
    """A verdict for each file (repo, root_dir, file_path, text) in a known language.

    The text must match the language's grammar to its end. A null text is
    empty; an empty text is valid except in JSON. Further columns are dropped.
    """
    ready = with_language(files).select(*FILE, "language", F.coalesce("text", F.lit("")).alias("text"))
    return ready.mapInPandas(_parse_batches, PARSE_SCHEMA)


def unparsable_files(chunks: DataFrame) -> DataFrame:
    """Verdicts of the files that don't parse, from chunk records."""
    return parse_files(whole_files(chunks)).filter(~F.col("valid"))


def parse_rates(chunks: DataFrame) -> DataFrame:
    """Per repository and language: files, files that fail, rate, and failures by cause."""
    causes = [F.count_if(F.col("cause") == c).alias(f"{c}_files") for c in ("conflict", "truncated", "language", "syntax")]
    counted = parse_files(whole_files(chunks)).groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("failed"), *causes)
    return counted.withColumn("rate", F.round(F.col("failed") / F.col("files"), 6))

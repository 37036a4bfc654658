"""Files of a directory tree: listing with ignore rules on the driver, reading in the tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE_FILES = (".gitignore", ".cursorignore")


@lru_cache(maxsize=4096)
def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern on the path below the ignore file, negated, folders only) of one ignore line."""
    text = line.rstrip("\n\r")
    text = text.rstrip() if not text.endswith("\\ ") else text
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text.removeprefix("\\")
    folders = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.+", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            body = text[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            if text[i] == "\\" and i + 1 < len(text):
                i += 1
            out, i = out + re.escape(text[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folders


def _ignored(rules: list[tuple[str, list[str]]], path: str, folder: bool) -> bool:
    """Whether the last matching rule of the ignore files above a path excludes it."""
    verdict = False
    for base, lines in rules:
        below = path[len(base) :].lstrip("/") if base else path
        for line in lines:
            rule = _pattern(line)
            if rule and (folder or not rule[2]) and rule[0].match(below):
                verdict = not rule[1]
    return verdict


def global_ignore_lines() -> list[str]:
    """Lines of the user's ignore file: core.excludesFile of the git configuration, else git/ignore of the configuration folder."""
    base = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "git"
    file = base / "ignore"
    for config in (Path.home() / ".gitconfig", base / "config"):
        if config.is_file():
            m = re.search(r"^\s*excludesfile\s*=\s*(.+?)\s*$", config.read_text("utf-8", "replace"), re.I | re.M)
            if m:
                file = Path(m[1].strip('"')).expanduser()
                break
    return file.read_text("utf-8", "replace").split("\n") if file.is_file() else []


def list_files(root: str, extensions: tuple[str, ...] = (), skip_dirs: tuple[str, ...] = ("node_modules",)) -> list[str]:
    """Sorted paths below root: no hidden names, none that ignore files exclude, none in skip_dirs.

    Extensions are compared without regard to letter case; without any, all
    files that have one. Ignore files count in every folder, the user's own for all.
    """
    top = Path(root)
    if not top.is_dir():
        raise NotADirectoryError(root)
    wanted = {e.strip().lower().lstrip(".") for e in extensions}
    out: list[str] = []

    def walk(folder: str, rules: list[tuple[str, list[str]]]) -> None:
        here = top / folder
        for name in (*IGNORE_FILES, ".git/info/exclude"):
            file = here / name
            if file.is_file():
                rules = [*rules, (folder, file.read_text("utf-8", "replace").split("\n"))]
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.name.startswith("."):
                continue
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in skip_dirs and not _ignored(rules, path, True):
                    walk(path, rules)
            elif entry.is_file() and not _ignored(rules, path, False):
                stem, dot, extension = entry.name.rpartition(".")
                if dot and stem and extension and (not wanted or extension.lower() in wanted):
                    out.append(path)

    walk("", [("", global_ignore_lines())])
    return sorted(out, key=lambda p: p.encode("utf-8", "surrogatepass"))


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, content (bytes), text (UTF-8, broken bytes replaced) of files on a file system all tasks see; unreadable ones give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    data = Path(root, path).read_bytes()
                except OSError:
                    continue
                rows.append((path, data, data.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["path", "content", "text"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    size = max(1, min(len(paths) // 64 + 1, 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(size).mapInPandas(run, "path string, content binary, text string")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), skip_dirs: tuple[str, ...] = ("node_modules",)) -> DataFrame:
    """path, hash, text of the files of a tree."""
    files = read_files(spark, root, list_files(root, extensions, skip_dirs))
    return files.select("path", F.sha2("content", 256).alias("hash"), "text")

"""Settings of an index."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class IndexConfig:
    root_dir: str = "."
    index_dir: str = ".cache/index"
    extensions: tuple[str, ...] = (".ts", ".tsx")
    collection: str = "codebase"
    model: str = "hash-64"
    dim: int = 64
    max_chunk_tokens: int = 512
    min_chunk_tokens: int = 64
    top_k: int = 10
    skip_dirs: tuple[str, ...] = ("node_modules",)

    @staticmethod
    def from_environment(env_file: str | None = ".env", **given: object) -> IndexConfig:
        """Values given win over SPARKSEEK_* variables, those over lines of env_file, those over the defaults.

        Every setting has a variable of its name; lists are separated by commas.
        """
        read = read_env(env_file) | os.environ
        found: dict[str, object] = {}
        for setting in fields(IndexConfig):
            value = read.get(f"SPARKSEEK_{setting.name.upper()}")
            if value:
                kind = type(setting.default)
                found[setting.name] = split_extensions(value) if setting.name == "extensions" else tuple(x.strip() for x in value.split(",") if x.strip()) if kind is tuple else kind(value)
        return replace(IndexConfig(), **(found | {k: v for k, v in given.items() if v is not None}))


def read_env(path: str | None) -> dict[str, str]:
    """NAME=value lines of a file, with or without `export` and quotes; comments and a missing file give nothing."""
    if not path or not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as lines:
        found = [re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line) for line in lines]
    out = {}
    for m in filter(None, found):
        value = m[2]
        quoted = re.match(r"""(["'])(.*?)\1""", value)
        out[m[1]] = quoted[2] if quoted else re.sub(r"\s+#.*$", "", value)
    return out


def split_extensions(text: str) -> tuple[str, ...]:
    """Comma-separated extensions, trimmed, in lower case, each with its dot."""
    return tuple("." + x.strip().lower().lstrip(".") for x in text.split(",") if x.strip())

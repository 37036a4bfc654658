"""Dimensions of known embedding models."""

from __future__ import annotations

# Vector length by model name.
KNOWN_DIMENSIONS = {
    "Xenova/bge-base-en-v1.5": 768, "BAAI/bge-base-en-v1.5": 768, "Xenova/bge-small-en-v1.5": 384, "BAAI/bge-small-en-v1.5": 384, "Xenova/bge-large-en-v1.5": 1024, "BAAI/bge-large-en-v1.5": 1024,
    "Xenova/bge-m3": 1024, "BAAI/bge-m3": 1024, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536,
}


def dimension(model: str) -> int:
    """The vector length of a model; hash-N models have N; an unknown one raises."""
    if model.startswith("hash-") and model[5:].isdigit():
        return int(model[5:])
    if model not in KNOWN_DIMENSIONS:
        raise ValueError(f"unknown model {model}: give its dimension")
    return KNOWN_DIMENSIONS[model]

"""Embedding providers with a model: local ONNX encoders, remote services, and the choice between them.

A provider has `model`, `dim`, `mode` and embed(rows, text), which returns the rows
with a column `vector`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _with_vector(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])


class OnnxProvider:
    """A local ONNX text encoder, loaded once a task; the user supplies the model and a tokenizer file."""

    def __init__(self, model_path: str, tokenizer_path: str, dim: int, name: str, batch: int = 8):
        self.model_path, self.tokenizer_path, self.dim, self.model, self.batch, self.mode = model_path, tokenizer_path, dim, name, batch, "onnx"

    def embed(self, rows: DataFrame, text: str = "content") -> DataFrame:
        model_path, tokenizer_path, size = self.model_path, self.tokenizer_path, self.batch

        def run(batches):
            import onnxruntime
            from tokenizers import Tokenizer

            session, tokenizer = onnxruntime.InferenceSession(model_path), Tokenizer.from_file(tokenizer_path)
            names = {i.name for i in session.get_inputs()}
            tokenizer.enable_padding()
            for pdf in batches:
                vectors = []
                for a in range(0, len(pdf), size):
                    coded = tokenizer.encode_batch([t or "" for t in pdf[text].iloc[a : a + size]])
                    feed = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": np.array([c.attention_mask for c in coded], np.int64), "token_type_ids": np.array([c.type_ids for c in coded], np.int64)}
                    first = session.run(None, {k: v for k, v in feed.items() if k in names})[0][:, 0]
                    vectors += list((first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-12)).astype(np.float32))
                yield pdf.assign(vector=vectors)

        return rows.mapInPandas(run, _with_vector(rows))


def budget_batches(texts: list[str], budget: int = 6000, most: int = 2048) -> Iterator[tuple[int, int]]:
    """Places of consecutive texts that go in one request: by estimated tokens (three characters each) and number; a text above the budget goes alone."""
    begin = used = 0
    for i, text in enumerate(texts):
        tokens = math.ceil(len(text) / 3)
        if i > begin and (used + tokens > budget or i - begin >= most):
            yield begin, i
            begin, used = i, 0
        used += tokens
    if begin < len(texts):
        yield begin, len(texts)


class RemoteProvider:
    """A service that embeds lists of texts, reached through `transport` from the tasks.

    transport(texts) returns a list of (index, vector) in any order and must be
    picklable; texts are cut to max_chars, which the service's window demands.
    """

    def __init__(self, transport: Callable[[list[str]], list[tuple[int, list[float]]]], model: str, dim: int, max_chars: int = 24_000, budget: int = 6000, most: int = 2048):
        self.transport, self.model, self.dim, self.mode = transport, model, dim, "remote"
        self.max_chars, self.budget, self.most = max_chars, budget, most

    def embed(self, rows: DataFrame, text: str = "content") -> DataFrame:
        transport, max_chars, budget, most, dim = self.transport, self.max_chars, self.budget, self.most, self.dim

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = [(t or "")[:max_chars] for t in pdf[text]]
                vectors: list = [None] * len(texts)
                for a, b in budget_batches(texts, budget, most):
                    for index, vector in transport(texts[a:b]):
                        if len(vector) != dim:
                            raise ValueError(f"the service returned {len(vector)} dimensions, not {dim}")
                        vectors[a + index] = np.asarray(vector, np.float32)
                if any(v is None for v in vectors):
                    raise ValueError("the service left a text out")
                yield pdf.assign(vector=vectors)

        return rows.mapInPandas(run, _with_vector(rows))


def choose_provider(remote: RemoteProvider | None, local: Callable[[], object], report: Callable[[str], None] = lambda text: None):
    """The remote provider if it answers a probe, else the local one; a probe's answer sets the dimension."""
    if remote is not None:
        try:
            remote.dim = len(remote.transport(["hello"])[0][1])
            return remote
        except Exception as e:  # noqa: BLE001 - whatever keeps the service from answering
            report(f"remote embedding failed: {e}; falling back to the local model")
    return local()

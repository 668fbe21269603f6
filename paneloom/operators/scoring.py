"""Scores and embeddings of texts by a model that is handed in, as Arrow maps.

The model is a factory without arguments, called once per task, in the worker. What it returns gets lists of texts of similar length, so that padding to the longest of a batch is cheap, and never an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paneloom.functions.columns import fresh

def _by_length(texts: list[str | None], batch: int) -> Iterator[np.ndarray]:
    """Places of the texts that have a character other than blanks, shortest first, ``batch`` at a time."""
    some = np.array([i for i, t in enumerate(texts) if t and not t.isspace()], int)
    some = some[np.argsort([len(texts[i]) for i in some], kind="stable")]
    for a in range(0, len(some), batch):
        yield some[a : a + batch]


def score_texts(df: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], np.ndarray]], classes: Sequence[str], batch: int = 256) -> DataFrame:
    """``df`` without the text, with a probability for each of ``classes``: the softmax of the model's scores (texts x classes).
    Null and blank texts have null probabilities. Whole texts go to the model; repeated rows are kept; a made column whose name is taken
    gets a leading underscore."""
    made = fresh(df, *classes)
    kept = [f for f in df.schema if f.name != text]
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = b.column(0).to_pylist()
            out = np.full((len(texts), len(made)), np.nan)
            for some in _by_length(texts, batch):
                score = np.asarray(model([texts[i] for i in some]), float)
                e = np.exp(score - score.max(1, keepdims=True))
                out[some] = e / e.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(c, pa.float64(), from_pandas=True) for c in out.T]], names=[f.name for f in schema])

    return df.select(text, *[f.name for f in kept]).mapInArrow(run, schema)


def embed_texts(df: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], into: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` without the text, with the array ``into`` (32-bit floats): the model gives hidden states (texts x tokens x dimensions) and a mask
    (texts x tokens, 1 for a token and 0 for padding), of which the mean over the tokens is taken. Null and blank texts, and those
    without a token, have null."""
    (into,) = fresh(df, into)
    kept = [f for f in df.schema if f.name != text]
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = b.column(0).to_pylist()
            out: list[list[float] | None] = [None] * len(texts)
            for some in _by_length(texts, batch):
                hidden, mask = (np.asarray(x, float) for x in model([texts[i] for i in some]))
                tokens = mask.sum(1)
                mean = (hidden * mask[:, :, None]).sum(1) / np.maximum(tokens, 1)[:, None]
                for i, n, v in zip(some, tokens, mean):
                    out[i] = v.tolist() if n else None
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.list_(pa.float32()))], names=[f.name for f in schema])

    return df.select(text, *[f.name for f in kept]).mapInArrow(run, schema)

"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paneloom.functions.columns import fresh

#: Ranks of a public byte-level BPE vocabulary; the path is a parameter wherever tokens are counted.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A vocabulary file is sent to the workers, so it must not be larger than this.
MOST_BYTES = 64 << 20

_loaded: dict[str, object] = {}


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is no vocabulary file: more than {MOST_BYTES} bytes")
    return data


def encoding(path: str = RANKS, data: bytes | None = None):
    """The tokenizer of a rank file (of its content ``data``, if that is given), loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in (data or _read(path)).splitlines() if line.strip())}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(df: DataFrame, text: str = "text", into: str = "n_tokens", path: str = RANKS, keep_text: bool = False) -> DataFrame:
    """``df`` with the number of tokens of the whole ``text`` as ``into`` (long; 0 for a null or empty text), without the
    text itself unless ``keep_text``. Special-token strings in a text are ordinary text. If ``into`` is taken by a column of
    ``df``, it gets a leading underscore. No shuffle. Only the driver needs the rank file: its content goes to the workers."""
    (into,) = fresh(df, into)
    kept = [f for f in df.schema if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField(into, T.LongType())])
    ordered = df.select(text, *[f.name for f in df.schema if f.name != text])
    names = ordered.columns
    places = [names.index(f.name) for f in kept]

    ranks = df.sparkSession.sparkContext.broadcast(_read(path))  # a vocabulary: its size is checked

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, ranks.value)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], pa.array(n, pa.int64())], names=[f.name for f in schema])

    return ordered.mapInArrow(count, schema)

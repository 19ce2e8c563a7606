"""Sizes of texts in tokens of a public tokenizer. Vocabulary files stay where they are; their path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level vocabulary as ranks, found at the same path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which byte-level vocabularies of this kind split text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, id: str, text: str, keep: list[str] = [], path: str = VOCABULARY) -> DataFrame:  # noqa: B006
    """(id, keep..., tokens): the size of every text; null and empty texts have none."""
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(out, pa.int64())], [*batch.schema.names[1:], "tokens"])

    rows = df.select(F.col(text).alias("_text"), id, *keep)
    return rows.mapInArrow(size, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", tokens long")

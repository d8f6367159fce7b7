"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The vocabulary file and the pattern that parts a text before merging; both are parameters.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_OPEN: dict[int, object] = {}


def _encoding(data: bytes, pattern: str):
    """One encoder a worker."""
    key = hash((len(data), pattern))
    if key not in _OPEN:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _OPEN[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[key]


def token_counts(df: DataFrame, row_id: str, text: str, keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``row_id``, ``keep`` and n_tokens of every row; whole texts, null and empty ones have 0 tokens.

    The vocabulary is read where the plan is made and broadcast (about 1 MB), so workers need no copy.
    """
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    columns = df.select(row_id, *keep, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.drop(text).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value, pattern).encode_ordinary
        for b in batches:
            texts = b.column(b.num_columns - 1)
            # One text at a time is decoded, so a batch of long texts costs no second copy.
            sizes = pa.array([len(encode(t)) if (t := x.as_py()) else 0 for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], sizes], names=[*b.schema.names[:-1], "n_tokens"])

    return columns.mapInArrow(run, f"{head}, n_tokens bigint")

"""The tokeniser slot: one column interface for white-space words and for subwords of a public vocabulary.

A subword vocabulary is a file of ranks (base64 token and rank a line, as byte-level pair merging writes them); its path is a
parameter and it is never trained here. The file is shipped to the executors, loaded once in each worker and applied to Arrow batches.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: how text is cut before merging, for vocabularies of this kind.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[tuple[str, str], object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoder(path: str, pieces: str = PIECES):
    """The encoder of a rank file, kept in the process."""
    if (path, pieces) not in _LOADED:
        import tiktoken

        _LOADED[path, pieces] = tiktoken.Encoding(os.path.basename(path), pat_str=pieces, mergeable_ranks=read_ranks(path), special_tokens={})
    return _LOADED[path, pieces]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Pair merging by definition: the adjacent pair of lowest rank first, leftmost of equals. For tests and short texts."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if rank == 1 << 62:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _slices(batch: pa.RecordBatch, columns: list[str], most: int = 1 << 20):
    """Slices of about `most` bytes of text, so that ids as Python numbers take some tens of MB whatever the batch holds; a longer text is alone."""
    sizes = [sum(n or 0 for n in row) for row in zip(*(pc.binary_length(batch.column(c)).to_pylist() for c in columns))]
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def with_subwords(df: DataFrame, columns: dict[str, str], path: str, pieces: str = PIECES) -> DataFrame:
    """df with an array<int> column of token ids for each (text column -> new column) of columns; null texts have null ids.

    path: a rank file that the driver can read. All of df's columns pass through the workers: select first."""
    df.sparkSession.sparkContext.addFile(path)
    file, schema = os.path.basename(path), T.StructType([*df.schema.fields, *(T.StructField(o, T.ArrayType(T.IntegerType())) for o in columns.values())])

    def run(batches):
        encode = encoder(SparkFiles.get(file), pieces).encode_ordinary
        for b in (part for batch in batches for part in _slices(batch, list(columns))):
            made = [pa.array([None if t is None else encode(t) for t in b.column(c).to_pylist()], pa.list_(pa.int32())) for c in columns]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *columns.values()])

    return df.mapInArrow(run, schema)


def with_words(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The same slot with white-space words, built in."""
    words: Callable[[str], Column] = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return df.withColumns({out: words(c) for c, out in columns.items()})

"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ sees it; bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode where that is unset a folder in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.split(":")[0] in ("file", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse + "/_stash"


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def map_batches(df: DataFrame, fn, schema: str, max_rows: int = 512, max_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow with small slices: fn(columns: list of Python lists) -> list of output columns (or None for no rows).

    Slices hold at most max_rows rows and about max_bytes of input, so one very long text is a slice by itself.
    """
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_rows, max_bytes):
                out = fn([c.to_pylist() for c in part.columns])
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, out_schema)


def slices(batch: pa.RecordBatch, max_rows: int, max_bytes: int):
    """Cut a record batch by rows and by the bytes of its first binary or string column."""
    wide = next((c for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_string(c.type)), None)
    if wide is None:
        yield from (batch.slice(i, max_rows) for i in range(0, batch.num_rows, max_rows))
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(wide), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= max_rows or total + n > max_bytes):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the white-space separated words in an array of bytes."""
    word = np.empty(len(data) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    word &= 1
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

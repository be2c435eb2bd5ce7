"""JSON arrays of objects, of any size, read by many tasks.

Spark's text reader cuts a file into byte ranges and, with "}" as line end, each range into segments. Whether a range begins
inside a string, and how deep, depends on all that stands before it. Both are sums: quotes that no backslash escapes, by their
parity, and brackets outside of strings, counted for either parity. A first pass counts them in each range; running sums over the ranges of
a file (a row a range) give every range its beginning state; the second pass then cuts whole objects out of its range. An object
that crosses ranges comes in fragments, which alone are collected, an object at a time.

A condition on columns is taken along: objects are first parsed for the condition's columns only, and the others are parsed where
it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import written

def _scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = spark.read.option("lineSep", "}").text(paths)
    return found.select("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", F.col("value").cast("binary").alias("value"))


def _runs(batches) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, range, size of the file, bytes) of segments that follow each other, each with its "}" again."""
    for batch in batches:
        files, blocks, sizes, values = batch.columns
        if not len(values):
            continue
        block = blocks.to_numpy()
        ends = (block[1:] != block[:-1]) | pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(ends) + 1).tolist(), len(values)]
        for a, data in zip(at, pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), b"}")):
            yield files[a].as_py(), int(block[a]), sizes[a].as_py(), data.as_py() + b"}"


_BRACKET = np.zeros(256, np.int8)
_BRACKET[[0x7B, 0x5B]], _BRACKET[[0x7D, 0x5D]] = 1, -1
_MARK = _BRACKET != 0
_MARK[0x22] = True


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the brackets and the quotes that no backslash escapes stand; for each the number of such quotes up to it, and +1 or -1 where a
    bracket opens or closes."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARK[raw])
    slash = np.flatnonzero(raw == 0x5C)
    if len(slash):
        # the run of backslashes that ends before a quote escapes it if it is odd
        first = np.append(True, np.diff(slash) > 1)
        run = slash - slash[np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))] + 1
        behind = slash[run % 2 == 1] + 1
        behind = behind[behind < len(raw)]
        escaped = np.zeros(len(raw), bool)
        escaped[behind[raw[behind] == 0x22]] = True
        at = at[~escaped[at]]
    return at, np.cumsum(raw[at] == 0x22), _BRACKET[raw[at]]


_COUNTS = ["file", "block", "size", "bytes", "quotes", "even", "odd"]


def _count(batches):
    now, sums = None, None
    for file, block, size, data in _runs(batches):
        if (file, block, size) != now:
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *sums)], _COUNTS)
            now, sums = (file, block, size), [0, 0, 0, 0]
        _, quotes, bracket = marks(data)
        inside = (quotes + sums[1]) % 2 == 1
        more = len(data), int(quotes[-1]) if len(quotes) else 0, int(bracket[~inside].sum()), int(bracket[inside].sum())
        sums = [x + y for x, y in zip(sums, more)]
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *sums)], _COUNTS)


def _states(counts: DataFrame) -> DataFrame:
    """file, block, size, at, inside, depth at the beginning of each range, and the file's depth at its end."""
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    s = counts.withColumn("inside", sofar("quotes") % 2)
    # brackets count outside of strings: those at odd quotes of the range if it begins inside one
    s = s.withColumn("delta", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
    return s.select("file", "block", "size", sofar("bytes").alias("at"), "inside", sofar("delta").alias("depth"), F.sum("delta").over(Window.partitionBy("file")).alias("end"))


#: Pieces of a range: a whole object, the end of one that began before the range, a range inside of one, the beginning of one that goes on.
WHOLE, END, MIDDLE, BEGIN = range(4)


_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.binary())


def _cut(batches, begin: dict):
    """(file, block, kind, value) pieces of the objects in each range, in batches."""
    rows: list[tuple] = []
    for piece in _pieces(_runs(batches), begin):
        rows.append(piece)
        if len(rows) == 2048 or len(piece[3]) > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], ["file", "block", "kind", "value"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], ["file", "block", "kind", "value"])


def _pieces(runs, begin: dict):
    now, held, kind = None, [], None  # held: the object that is open, in parts; kind: what it is if the range ends with it
    inside = depth = at = size = 0
    for file, block, _, data in runs:
        if (file, block) != now:
            if kind is not None:
                yield (*now, kind, b"".join(held))
            now, held = (file, block), []
            at, inside, depth, size = begin[now]
            kind = MIDDLE if depth >= 2 else None
        at += len(data)
        data = data[:-1] if at > size else data  # no "}" stands behind the last segment of a file
        if not data:
            continue
        places, quotes, bracket = marks(data)
        out = (quotes + inside) % 2 == 0
        deep = depth + np.cumsum(np.where(out, bracket, 0))
        char = np.frombuffer(data, np.uint8)[places]
        opens = (char == 0x7B) & out & (deep == 2)
        ends = opens | ((char == 0x7D) & out & (deep == 1))
        a = 0
        for e, opened in zip(places[ends].tolist(), opens[ends].tolist()):
            if opened:
                a, held, kind = e, [], BEGIN
            elif kind is not None:
                yield (*now, WHOLE if kind == BEGIN else END, b"".join([*held, data[a : e + 1]]))
                held, kind = [], None
        if kind is not None:
            held.append(data[a:])
        if len(places):
            inside, depth = (inside + int(quotes[-1])) % 2, int(deep[-1])
    if kind is not None:
        yield (*now, kind, b"".join(held))


def objects(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """file, value: the text of every object that stands directly in a file's array. strict: a file whose brackets do not close
    raises an error; without it the objects before the break are given. Other elements are passed over."""
    counts = _scan(spark, paths).mapInArrow(_count, "file string, block long, size long, bytes long, quotes long, even long, odd long")
    states = written(_states(written(counts)))
    # the "}" that is put behind a file's last segment takes one off the depth
    if strict and (bad := states.where("end <> -1").first()):
        raise ValueError(f"the array in {bad['file']} does not close: {bad['end'] + 1} brackets are open at its end")
    # one entry for each range of spark.sql.files.maxPartitionBytes: about 150 bytes for 128 MB
    begin = {(r["file"], r["block"]): (r["at"], r["inside"], r["depth"], r["size"]) for r in states.toLocalIterator()}
    shared = spark.sparkContext.broadcast(begin)
    pieces = written(_scan(spark, paths).mapInArrow(lambda batches: _cut(batches, shared.value), "file string, block long, kind int, value binary"))
    whole = pieces.where(F.col("kind") == WHOLE).select("file", F.col("value").cast("string").alias("value"))
    # an object over several ranges begins with a BEGIN and goes to the next END; at most one each of END, BEGIN or MIDDLE a range
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("o", F.col("block") * 4 + F.col("kind"))
    w = Window.partitionBy("file").orderBy("o")
    order = written(parts.select("file", "o", F.count_if(F.col("kind") == BEGIN).over(w).alias("g")))
    parts = parts.hint("merge").join(order.hint("merge"), ["file", "o"]).groupBy("file", "g")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("o", F.col("value").cast("string").alias("v")))).alias("p"), F.min(F.when(F.col("kind") == END, F.col("o"))).alias("last"), F.max((F.col("kind") == BEGIN).cast("int")).alias("begun"))
    parts = parts.where("begun = 1 and last is not null").select("file", F.array_join(F.transform(F.filter("p", lambda x: x["o"] <= F.col("last")), lambda x: x["v"]), "").alias("value"))
    return whole.unionByName(parts)


def read_json_array(spark: SparkSession, paths: list[str], schema: str, where: str | None = None, strict: bool = True) -> DataFrame:
    """The objects of files that hold one JSON array each, with the columns of schema; where: a condition on these columns, for
    which only the columns that it names are parsed of every object."""
    full = T.StructType.fromDDL(schema)
    found = objects(spark, paths, strict).select("value")
    if where is not None:
        spark.createDataFrame([], full).where(where)  # a condition that does not fit the schema fails before anything is read
        used = [f for f in full.fields if re.search(rf"(?<![\w`]){re.escape(f.name)}(?![\w`])|`{re.escape(f.name)}`", where)] or full.fields
        found = found.withColumn("k", F.from_json("value", T.StructType(used))).select("value", "k.*").where(where).select("value")
    return found.select(F.from_json("value", full).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str) -> None:
    """Each part file is one JSON array of the rows of its partition."""

    def run(batches):
        mark = "["
        for b in batches:
            if b.num_rows:
                marks = pa.array([mark] + [","] * (b.num_rows - 1), b.column(0).type)
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, b.column(0), "")], ["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"], pa.string())], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)

"""Batch protocol: tables of rows with a position (row_idx, from 0) as DataFrames.

Spark has no row order, so every operator takes and keeps an explicit position. Positions are dealt without a
single-partition window: rows fall into ranges of all order keys together (so a value that most rows share in the first
key is dealt over many ranges), are numbered inside their range, and the counts of the ranges before (one row a range) are
added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written


def with_position(df: DataFrame, *keys: str | Column, name: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """df with its position (long, from 0) in the order of keys, which must order the rows fully."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that every later read sees the same ranges
    dealt = written(df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*cols)) - 1)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range: its running sum is a window over as many rows as there are ranges
    offsets = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = inside.join(F.broadcast(offsets), inside["_part"] == offsets["_p"])
    return placed.withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_p", "_in", "_before")


def select_idxs(df: DataFrame, idxs: DataFrame) -> DataFrame:
    """Rows at the positions of idxs (columns pos, idx), repeats and order kept: the result's row_idx is pos."""
    return idxs.hint("merge").join(df.hint("merge"), idxs["idx"] == df["row_idx"]).drop("row_idx", "idx").withColumnRenamed("pos", "row_idx")


def slice_rows(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    i = F.col("row_idx")
    keep = (i >= start) & ((i - start) % step == 0)
    return df.where(keep & (i < stop) if stop is not None else keep)


def pop(df: DataFrame, columns: list[str], key: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """(the rest, the popped columns), both with the key; an absent column is an error."""
    if missing := set(columns) - set(df.columns):
        raise KeyError(f"no columns {sorted(missing)}")
    return df.drop(*columns), df.select(key, *columns)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(a: DataFrame, b: DataFrame, key: str = "row_idx") -> DataFrame:
    """Columns of both, row by row; a shared column must hold equal values, else the job fails with raise_error."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    other = b.withColumnsRenamed({c: f"_b_{c}" for c in shared})
    joined = a.hint("merge").join(other.hint("merge"), key)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        joined = joined.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType)))
    return joined.drop(*[f"_b_{c}" for c in shared])


def concat(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def combine_samples(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def repeat(df: DataFrame, k: int, interleave: bool = True) -> DataFrame:
    """Every row k times; row_idx follows AABB (interleaved) or ABAB order. The tiled order needs the row count."""
    if interleave:
        return df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("row_idx", F.col("row_idx") * k + F.col("_r")).drop("_r")
    n = df.count()
    return df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("row_idx", F.col("row_idx") + F.col("_r") * n).drop("_r")


def chunk(df: DataFrame, k: int) -> DataFrame:
    """df with chunk (from 0), k equal parts in order; a count that k does not divide is an error."""
    n = df.count()
    if n % k:
        raise ValueError(f"{n} rows do not divide into {k} parts")
    return df.withColumn("chunk", F.floor(F.col("row_idx") / max(1, n // k)))


def pad_to_divisor(df: DataFrame, divisor: int) -> DataFrame:
    """Rows from the start, repeated, are added behind until divisor divides the count; is_pad marks them."""
    n = df.count()
    pad = -n % divisor if n else 0
    rounds = F.sequence(F.lit(0), F.lit(max(0, -(-pad // max(1, n)) - 1)))
    more = df.withColumn("_r", F.explode(rounds)).withColumn("row_idx", F.col("row_idx") + F.col("_r") * n).where(F.col("row_idx") < pad)
    return df.withColumn("is_pad", F.lit(False)).unionByName(more.drop("_r").withColumn("row_idx", F.col("row_idx") + n).withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame, pad: int) -> DataFrame:
    return df.where(F.col("row_idx") < df.count() - pad)


def fold(df: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """One row for each k rows in order, with arrays of the columns."""
    items = F.array_sort(F.collect_list(F.struct("row_idx", *columns)))
    g = df.groupBy(F.floor(F.col("row_idx") / k).alias("fold")).agg(items.alias("_i"))
    return g.select("fold", *[F.col(f"_i.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """The rows of fold() again."""
    return df.select("fold", F.posexplode(F.arrays_zip(*columns)).alias("_p", "_z")).select((F.col("fold") * k + F.col("_p")).alias("row_idx"), *[F.col(f"_z.{c}").alias(c) for c in columns])


def minibatches(df: DataFrame, size: int, epochs: int, seed: int | None = None, key: str = "row_idx") -> DataFrame:
    """epoch and batch_id of every row in every epoch; with a seed each epoch has an order of its own, by hash."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), "epoch", key)) if seed is not None else F.lpad(F.col(key).cast("string"), 20, "0")
    placed = with_position(e.withColumn("_o", order), "epoch", "_o", key, name="_at").drop("_o")
    # every epoch has as many rows as df
    return placed.withColumn("batch_id", F.floor((F.col("_at") - F.col("epoch") * F.lit(df.count())) / size)).drop("_at")


def collate(df: DataFrame, by: str, columns: list[str], order: str = "row_idx") -> DataFrame:
    """One row a batch with a list of each column, in order."""
    g = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_i"))
    return g.select(by, *[F.col(f"_i.{c}").alias(c) for c in columns])


def loader(df: DataFrame, size: int, seed: int | None = None, key: str = "row_idx", drop_last: bool = True) -> DataFrame:
    """batch_id of every row, shuffled by hash of seed and key or in order of the key; training drops a short last batch."""
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), key)) if seed is not None else F.col(key)
    placed = with_position(df.withColumn("_o", order), "_o", key, name="_at").drop("_o").withColumn("batch_id", F.floor(F.col("_at") / size)).drop("_at")
    if not drop_last:
        return placed
    whole = df.count() // size
    return placed.where(F.col("batch_id") < whole)


def shard(df: DataFrame, n: int, seed: int, key: str = "row_idx", drop_last: bool = True) -> DataFrame:
    """shard of every row in hash order, dealt in turn; with drop_last the rest that does not go round is dropped."""
    placed = with_position(df.withColumn("_o", F.md5(F.concat_ws("-", F.lit(str(seed)), key))), "_o", key, name="_at").drop("_o")
    if drop_last:
        placed = placed.where(F.col("_at") < df.count() // n * n)
    return placed.withColumn("shard", F.pmod("_at", F.lit(n))).drop("_at")


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """Rows in the order of the permutation (pos, idx)."""
    return select_idxs(df, permutation)


def reverse_index(permutation: DataFrame) -> DataFrame:
    """The inverse permutation: where each row went."""
    return permutation.select(F.col("idx").alias("pos"), F.col("pos").alias("idx"))

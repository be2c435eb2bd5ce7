"""Balancing by largest differencing, in tasks of bounded size.

Rows of a batch are cut by falling weight into cells of at most `cell` rows. A task differences a cell: every row (with equal
counts: every run of `parts` rows) is a deal of sums over the parts, and the two deals that are least even are laid over each
other, largest on smallest, until one is left. What a cell leaves is itself such a deal, so the deals of up to `fan` cells are
laid over each other in the same way, level by level, and the rows follow their part's new numbers by a join.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import written
from .protocol import with_position


def lay_over(deals: list[list[tuple[float, list]]]) -> list[tuple[float, list]]:
    """One deal from many. A deal has a (sum, members) for each part; the result is ordered by falling sum."""
    heap = []
    for i, d in enumerate(deals):
        d = sorted(d, key=lambda p: -p[0])
        heap.append((d[-1][0] - d[0][0], i, d))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], i, both))
    return heap[0][2] if heap else []


def difference(weights: list[float], parts: int, equal: bool = True) -> list[int]:
    """The part of each weight, which must fall. equal: counts of the parts differ by one at most (by none if parts divides them)."""
    if equal:
        runs = [list(range(a, min(a + parts, len(weights)))) for a in range(0, len(weights), parts)]
    else:
        runs = [[i] for i in range(len(weights))]
    deals = [[(weights[i], [i]) for i in run] + [(0, [])] * (parts - len(run)) for run in runs]
    out = [0] * len(weights)
    for part, (_, members) in enumerate(lay_over(deals)):
        for i in members:
            out[i] = part
    return out


def _plus(df: DataFrame, name: str) -> T.StructType:
    """df's schema with one more int column (StructType.add would change df's own)."""
    return T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])


def _rows(t: pa.Table, parts: int, equal: bool) -> pa.Table:
    t = t.sort_by([("_pos", "ascending")])
    return t.append_column("_part", pa.array(difference(t["_w"].to_pylist(), parts, equal), pa.int32()))


def _cells(t: pa.Table, parts: int) -> pa.Table:
    """New part numbers for the parts of the cells in a table of (_cell, _part, _sum)."""
    t = t.sort_by([("_cell", "ascending"), ("_part", "ascending")])
    cells: dict[int, list] = {}
    for k, (cell, total) in enumerate(zip(t["_cell"].to_pylist(), t["_sum"].to_pylist())):
        cells.setdefault(cell, []).append((total, [k]))
    new = [0] * t.num_rows
    for part, (_, members) in enumerate(lay_over(list(cells.values()))):
        for k in members:
            new[k] = part
    return t.append_column("_new", pa.array(new, pa.int32()))


def placed_in_batch(df: DataFrame, batch: str, weight: str, key: str) -> DataFrame:
    """df with _pos (from 0, by falling weight inside the batch) and _n, the batch's rows; no task sorts a batch."""
    placed = with_position(df.withColumn("_w", F.col(weight).cast("double")), batch, -F.col("_w"), key, name="_at")
    first = written(placed.groupBy(F.col(batch).alias("_batch")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    return placed.join(first.hint("merge"), F.col(batch).eqNullSafe(F.col("_batch"))).withColumn("_pos", F.col("_at") - F.col("_first")).drop("_at", "_first", "_batch")


def balance_differencing(df: DataFrame, batch: str, weight: str, key: str, parts: int, equal: bool = True, cell: int = 4096, fan: int = 256) -> DataFrame:
    """df with part (0 has the largest sum of its batch): every batch dealt to `parts` parts of near-equal sums, with equal
    counts if asked (a short last run leaves counts one apart). Null weights count as 0; key orders equal weights."""
    size = max(parts, cell // parts * parts)
    placed = placed_in_batch(df.withColumn(weight, F.coalesce(weight, F.lit(0))), batch, weight, key)
    cells = F.ceil(F.col("_n") / size)
    # whole runs go to the cells in turn, so that cells are alike; only one cell has the short run
    placed = placed.withColumn("_cell", F.floor(F.col("_pos") / parts) % cells)
    slim = placed.select(F.col(batch).alias("_batch"), "_cell", "_w", "_pos")
    dealt = written(slim.groupBy("_batch", "_cell").applyInArrow(lambda t: _rows(t, parts, equal), _plus(slim, "_part")))
    count = dealt.agg(F.max("_cell")).first()[0] or 0
    while count > 0:
        sums = dealt.groupBy("_batch", "_cell", "_part").agg(F.sum("_w").alias("_sum"))
        # a part without rows in a cell is a sum of 0
        every = sums.select("_batch", "_cell").distinct().select("_batch", "_cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
        sums = written(every.withColumn("_sum", F.lit(0.0)).unionByName(sums).groupBy("_batch", "_cell", "_part").agg(F.sum("_sum").alias("_sum")))
        up = sums.withColumn("_up", F.floor(F.col("_cell") / fan))
        moved = written(up.groupBy("_batch", "_up").applyInArrow(lambda t: _cells(t, parts), _plus(up, "_new")))
        moved = moved.select(F.col("_batch").alias("_b"), F.col("_cell").alias("_c"), F.col("_part").alias("_p"), "_up", "_new")
        on = dealt["_batch"].eqNullSafe(moved["_b"]) & (dealt["_cell"] == moved["_c"]) & (dealt["_part"] == moved["_p"])
        dealt = written(dealt.hint("merge").join(moved.hint("merge"), on).select("_batch", F.col("_up").alias("_cell"), "_w", "_pos", F.col("_new").alias("_part")))
        count //= fan
    dealt = dealt.select(F.col("_batch").alias("_b"), F.col("_pos").alias("_p"), F.col("_part").alias("part"))
    out = placed.hint("merge").join(dealt.hint("merge"), placed[batch].eqNullSafe(dealt["_b"]) & (placed["_pos"] == dealt["_p"]))
    return out.select(*df.columns, "part")


def microbatches(df: DataFrame, batch: str, weight: str, key: str, most: int, rows: int = 4096) -> DataFrame:
    """df with chunk and part: every batch is cut, in the order of key, into chunks of at most `rows` rows, and each chunk is
    differenced into as many parts as its weights need at `most` each, without equal counts."""
    placed = with_position(df, batch, key, name="_at")
    first = written(placed.groupBy(F.col(batch).alias("_batch")).agg(F.min("_at").alias("_first")))
    placed = placed.join(first.hint("merge"), F.col(batch).eqNullSafe(F.col("_batch"))).withColumn("chunk", F.floor((F.col("_at") - F.col("_first")) / rows).cast("int")).drop("_first", "_batch")
    slim = placed.select(F.col(batch).alias("_batch"), "chunk", "_at", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w"))

    def deal(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_w", "descending"), ("_at", "ascending")])
        weights = t["_w"].to_pylist()
        parts = max(1, -int(-sum(weights) // most))
        return t.append_column("part", pa.array(difference(weights, parts, equal=False), pa.int32()))

    dealt = slim.groupBy("_batch", "chunk").applyInArrow(deal, _plus(slim, "part")).select(F.col("_at").alias("_p"), "part")
    return placed.hint("merge").join(dealt.hint("merge"), F.col("_at") == F.col("_p")).select(*df.columns, "chunk", "part")

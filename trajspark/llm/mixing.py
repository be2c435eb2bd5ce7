"""Mixing sources to target weights by cube-method balanced sampling.

A source with target t and size s takes every document floor(t/s) times and once more with probability t/s - floor(t/s).
The cube method turns these fractional inclusion probabilities into whole decisions: in the flight phase a vector of
three fractional probabilities moves along the null space of the two balancing constraints (words, documents) until one
of them reaches 0 or 1, so both totals stay exactly as they were; at most two fractional units are left. Flights run
in cells of about `cell` documents of one source; what each cell leaves over flies again with the leftovers of up to
`cell` others, level by level, until one cell a source is left, whose last one or two units land: the rounding that
misses the words by least. Large sources have many cells, so no task holds a source.

Directions come from a hash of the ids, so reruns agree. Sources are few by nature: one row for each is collected to set
the targets and broadcast. Cases: null and empty texts have size 0, are taken 0 words and
stay in the result; a source of size 0 has target 0; the null source is the last; repeated rows are documents of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stash, table

EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: a share of all sizes by weight, stopped at `most` times the source's size, the excess
    dealt again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {k: weights[i % len(weights)] for i, (k, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), list(size), {}
    while open_:
        total = sum(weight[k] for k in open_)
        full = [k for k in open_ if left * weight[k] / total > most * size[k]]
        if not full:
            out |= {k: left * weight[k] / total for k in open_}
            break
        for k in full:
            out[k] = most * size[k]
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in out]
    return out


def flight(p: np.ndarray, x: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Move probabilities p along the null space of (x, 1) until at most two are fractional; coin: a number in [0, 1)
    for each unit that chooses the direction of the move it enters by."""
    p, live = p.copy(), []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = round(p[k])
            continue
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # the cross product of the two constraint rows
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(live, u) if v)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(live, u) if v)
        step = up if coin[k] * (up + down) < down else -down
        for i, v in zip(live, u):
            p[i] += step * v
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        live = [i for i in live if 0.0 < p[i] < 1.0]
    return p


def land(p: np.ndarray, x: np.ndarray, due: float) -> np.ndarray:
    """Round the fractional units so that their words come nearest to `due`, the words that their probabilities stood for; few units."""
    open_ = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(x[i] for k, i in enumerate(open_) if m >> k & 1) - due), m))
    out = np.round(p)
    for k, i in enumerate(open_):
        out[i] = best >> k & 1
    return out


_STATE = "uid string, source string, size long, p double, coin double, block long"


def _fly(units: DataFrame, last: bool) -> DataFrame:
    """One flight in each (source, block); in the last one the rest lands."""

    def run(t: pa.Table) -> pa.Table:
        d = t.sort_by([("coin", "ascending"), ("uid", "ascending")])
        p0, x = np.asarray(d["p"]), np.asarray(d["size"]).astype(float)
        p = flight(p0, x, np.asarray(d["coin"]))
        if last:
            rest = (p > EPS) & (p < 1 - EPS)
            p = land(p, x, float((p[rest] * x[rest]).sum()))
        return d.set_column(d.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return units.groupBy("source", "block").applyInArrow(run, _STATE)


def balanced(units: DataFrame, counts: dict, cell: int = 2048) -> DataFrame:
    """uid, extra (0 or 1) of every unit with a fractional p; counts: how many such units each source has."""
    level, whole = units, []
    blocks = {k: -(-n // cell) for k, n in counts.items()}
    while True:
        last = max(blocks.values(), default=1) <= 1
        flown = stash(_fly(level, last))
        whole.append(flown.where("p = 0 or p = 1").select("uid", F.col("p").cast("int").alias("extra")))
        if last:
            break
        level = flown.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / (cell // 2)))
        blocks = {k: -(-b // (cell // 2)) for k, b in blocks.items()}
    out = whole[0]
    for w in whole[1:]:
        out = out.unionByName(w)
    return out


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, cell: int = 2048, seed: int = 8) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, copies for every row of docs. uid tells repeated rows apart."""
    spark = docs.sparkSession
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"), F.xxhash64("text").alias("body"))
    # equal rows get a number each, so that every row is a unit of its own
    same = rows.groupBy("doc_id", "source", "size", "body").agg(F.count(F.lit(1)).alias("n"))
    rows = same.select("doc_id", "source", "size", F.posexplode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy", "_"), "body").drop("_")
    uid = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("body"), F.xxhash64("source", "size"), "copy")
    rows = stash(rows.withColumn("uid", uid))
    totals = [(r["source"], r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n")).collect()]
    aim = targets([(k, s) for k, s, _ in totals], weights, share, most)
    cells = {k: max(1, -(-n // cell)) for k, _, n in totals}
    plan = [(k, s, float(aim[k]), min(int(aim[k] // s), int(most)) if s else 0, float(aim[k] / s - aim[k] // s) if s else 0.0, cells[k]) for k, s, _ in totals]
    plan = spark.createDataFrame(plan, "src string, source_size long, target double, base int, frac double, cells long")
    # one row for each source, as many as a mix has weights to set
    unit = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["src"])).drop("src")
    coin = F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "uid"), F.col("cells"))
    drawn = unit.where((F.col("size") > 0) & (F.col("frac") > EPS) & (F.col("frac") < 1 - EPS)).select("uid", "source", "size", F.col("frac").alias("p"), coin.alias("coin"), block.alias("block"))
    taken = balanced(drawn, {k: n for k, _, n in totals}, cell)
    full = unit.hint("merge").join(taken.hint("merge"), "uid", "left")
    extra = F.coalesce("extra", F.round("frac").cast("int"))
    return full.select("uid", "doc_id", "source", "body", "copy", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base") + extra).otherwise(0).alias("copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mix."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with mix_copy numbering the copies from 1 (a
    column of that name is replaced). Rows of equal doc_id, source and text that differ in another column are units of their
    own, numbered by a hash of the whole row; rows equal in all columns are taken together."""
    choice = mix(docs, **how).where("copies > 0").select(F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), F.col("body").alias("mix_body"), (F.col("copy") + 1).alias("mix_unit"), "copies")
    # nulls have no part in a hash, so where they stand is hashed too
    whole = F.xxhash64(*[F.col(c) for c in docs.columns], *[F.col(c).isNull() for c in docs.columns])
    rows = docs.select(F.struct(*docs.columns).alias("mix_row"), F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("origin"), F.xxhash64("text").alias("body"), whole.alias("mix_whole"))
    last = F.sum("n").over(Window.partitionBy("doc", "origin", "body").orderBy("mix_whole"))
    kinds = rows.groupBy("doc", "origin", "body", "mix_whole").agg(F.count(F.lit(1)).alias("n")).withColumn("last", last)
    units = kinds.select("doc", "origin", "body", "mix_whole", F.explode(F.sequence(F.col("last") - F.col("n") + 1, "last")).alias("unit"))
    on = units["doc"].eqNullSafe(choice["mix_doc"]) & units["origin"].eqNullSafe(choice["mix_source"]) & (units["body"] == choice["mix_body"]) & (units["unit"] == choice["mix_unit"])
    taken = units.hint("merge").join(choice.hint("merge"), on).groupBy("mix_doc", "mix_source", "mix_body", "mix_whole").agg(F.sum("copies").cast("int").alias("mix_copies")).withColumnRenamed("mix_whole", "mix_hash")
    on = rows["doc"].eqNullSafe(taken["mix_doc"]) & rows["origin"].eqNullSafe(taken["mix_source"]) & (rows["body"] == taken["mix_body"]) & (rows["mix_whole"] == taken["mix_hash"])
    out = rows.hint("merge").join(taken.hint("merge"), on).groupBy("doc", "origin", "body", "mix_whole").agg(F.first("mix_row").alias("mix_row"), F.first("mix_copies").alias("mix_copies"))
    own = [F.col("mix_row")[c].alias(c) for c in docs.columns if c != "mix_copy"]
    return out.select(*own, F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))

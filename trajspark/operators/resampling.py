"""Bootstrap forms of best, worst and majority over the attempts of a prompt, with draws that any engine can repeat.

Pick j of draw b for k of n attempts is 1 + (the first 32 bits of md5("seed-k-b-j") mod n): it depends on n and k only, so
prompts with equally many attempts share their draws, as they would with one seed.

Best and worst need no exploded table: the best of a draw is the attempt of its highest picked rank, so the share of draws whose
highest (lowest) rank is r is a weight table of at most `draws` rows for each (n, k), and the metric is a weighted sum over the
ranked attempts, in one join. A majority depends on the answers themselves: prompts of up to `group_rows` attempts are drawn
with numpy, those of as many attempts together, larger ones by a join of picks and attempts, whose rows Spark deals out; both are the same draws.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written


def sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e)), lambda k: k < n)
    return F.array_append(powers, n)


def picks(counts: DataFrame, draws: int, seed: int) -> DataFrame:
    """n, k, b, j, i for each distinct n: the i-th of n attempts is pick j of draw b. Dealt out by draw."""
    wide = counts.select("n", F.explode(sizes(F.col("n"))).alias("k")).select("n", "k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b"))
    wide = wide.repartition(F.col("n"), F.col("k"), F.col("b")).select("n", "k", "b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("j"))
    name = F.concat_ws("-", F.lit(str(seed)), "k", "b", "j")
    return wide.withColumn("i", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % F.col("n") + 1)


def _ranked(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("_i", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))


def bootstrap_best_worst(df: DataFrame, by: list[str], value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """by, n, k, best, best_std, worst, worst_std: mean and (population) std over the draws, for k = 2, 4, 8, ... n."""
    ranked = written(_ranked(df, by, value).select(*by, "_i", "_n", F.col(value).cast("double").alias("_v")))
    ends = picks(ranked.select(F.col("_n").alias("n")).distinct(), draws, seed).groupBy("n", "k", "b").agg(F.max("i").alias("hi"), F.min("i").alias("lo"))
    sides = ends.select("n", "k", F.explode(F.array(F.struct("hi", F.lit(1).alias("up")), F.struct(F.col("lo").alias("hi"), F.lit(0).alias("up")))).alias("s"))
    # written: its size is then known, and a frequent n can be split
    weights = written(sides.groupBy("n", "k", F.col("s.hi").alias("r")).agg(F.count_if(F.col("s.up") == 1).alias("up"), F.count_if(F.col("s.up") == 0).alias("down")))
    joined = ranked.join(weights.hint("merge"), (F.col("_n") == F.col("n")) & (F.col("_i") == F.col("r")))
    v, out = F.col("_v"), []
    for name, w in (("best", F.col("up")), ("worst", F.col("down"))):
        mean = F.sum(v * w) / draws  # whole counts of draws: sums of whole values are exact
        out += [mean.alias(name), F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v * w) / draws - mean * mean)).alias(f"{name}_std")]
    return joined.groupBy(*by, "n", "k").agg(*out)


def draw_matrix(n: int, k: int, draws: int, seed: int) -> np.ndarray:
    """The picks of all draws, from 0: the same as picks()."""
    text = (f"{seed}-{k}-{b}-{j}" for b in range(1, draws + 1) for j in range(1, k + 1))
    return np.fromiter((int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % n for t in text), np.int64, draws * k).reshape(draws, k)


def majority_values(codes: np.ndarray, values: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """For each prompt (a row of codes and values) and each draw the value of its first pick of the most frequent answer; ties go to
    the answer picked first. Codes count from 0 in each row."""
    got = codes[:, drawn]
    prompts, draws, k = got.shape
    width = int(codes.max()) + 1
    at = got.reshape(-1, k) + np.arange(prompts * draws)[:, None] * width
    votes = np.bincount(at.ravel(), minlength=prompts * draws * width).reshape(prompts, draws, width)
    first = np.full(prompts * draws * width, k)
    first[at[:, ::-1].ravel()] = np.tile(np.arange(k)[::-1], prompts * draws)  # the last one written is the first pick
    winner = np.where(votes == votes.max(axis=2, keepdims=True), first.reshape(votes.shape), k).min(axis=2)
    return np.take_along_axis(values, drawn[np.arange(draws), winner], axis=1)


def own_codes(answers: np.ndarray) -> np.ndarray:
    """Codes that count from 0 in each row, in place of codes of the whole table."""
    rows = np.arange(len(answers))[:, None] * (int(answers.max()) + 1)
    codes = np.unique(answers + rows, return_inverse=True)[1].reshape(answers.shape)
    return codes - codes.min(axis=1, keepdims=True)


def _whole_prompts(batches):
    """(n, rows): runs of whole prompts of n rows each, from batches sorted by n and prompt."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        sizes, at = t["_n"].to_numpy(), 0
        while at < len(sizes):
            n = int(sizes[at])
            whole = (int(np.searchsorted(sizes, n, "right")) - at) // n * n
            if not whole:
                break
            yield n, t.slice(at, whole)
            at += whole
        held = t.slice(at)


def bootstrap_majority(df: DataFrame, by: list[str], answer: str, value: str, order: str, draws: int = 1000, seed: int = 42, group_rows: int = 20_000) -> DataFrame:
    """by, n, k, majority, majority_std over the draws, for k = 2, 4, 8, ... n. order numbers a prompt's attempts."""
    ranked = written(_ranked(df, by, order).select(*by, "_i", "_n", F.col(answer).cast("string").alias("_a"), F.col(value).cast("double").alias("_v")))
    small = ranked.where(F.col("_n") <= group_rows)
    schema = ranked.select(*by).schema
    for name, kind in (("n", "long"), ("k", "long"), ("majority", "double"), ("majority_std", "double")):
        schema = schema.add(name, kind)

    def draw(batches):
        cache: dict = {}
        for n, t in _whole_prompts(batches):
            t = t.combine_chunks()
            answers = np.asarray(t["_a"].combine_chunks().dictionary_encode(null_encoding="encode").indices).reshape(-1, n)
            codes, values = own_codes(answers), np.asarray(t["_v"]).reshape(-1, n)
            heads = t.select(by).take(pa.array(np.arange(0, t.num_rows, n)))
            for k in [1 << e for e in range(1, 30) if 1 << e < n] + [n]:
                # drawn once a task for prompts of common size; large ones are not kept
                drawn = cache.get((n, k))
                if drawn is None:
                    drawn = draw_matrix(n, k, draws, seed)
                    if drawn.size <= 100_000 and len(cache) < 500:
                        cache[n, k] = drawn
                step = max(1, 500_000 // (draws * n))
                for i in range(0, len(codes), step):
                    got = majority_values(codes[i : i + step], values[i : i + step], drawn)
                    m = len(got)
                    cols = [*heads.slice(i, m).combine_chunks().columns, np.full(m, n), np.full(m, k), got.mean(axis=1), got.std(axis=1)]
                    yield from pa.table(cols, names=[*by, "n", "k", "majority", "majority_std"]).to_batches()

    # prompts of as many attempts stand together and are drawn together
    out = small.repartition(*by).sortWithinPartitions("_n", *by, "_i").mapInArrow(draw, schema)
    large = ranked.where(F.col("_n") > group_rows)
    if large.isEmpty():
        return out
    drawn = written(picks(large.select(F.col("_n").alias("n")).distinct(), draws, seed))
    got = large.hint("merge").join(drawn.hint("merge"), (F.col("_n") == F.col("n")) & (F.col("_i") == F.col("i")))
    votes = got.groupBy(*by, "n", "k", "b", "_a").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("j", "_v")).alias("f"))
    won = votes.groupBy(*by, "n", "k", "b").agg(F.max(F.struct("c", (-F.col("f.j")).alias("first"), F.col("f._v").alias("v"))).alias("w"))
    return out.unionByName(won.groupBy(*by, "n", "k").agg(F.avg("w.v").alias("majority"), F.stddev_pop("w.v").alias("majority_std")))

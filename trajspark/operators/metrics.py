"""Aggregations over attempts, as long metric tables (scope, metric, value) where there are many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written


def long_metrics(df: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """One aggregation for all metrics, then one row a metric."""
    wide = df.groupBy(*by).agg(*[v.cast("double").alias(k) for k, v in metrics.items()])
    return wide.unpivot(by, list(metrics), "metric", "value")


def spread(name: str, c: Column | str) -> dict[str, Column]:
    return {f"{name}/mean": F.avg(c), f"{name}/max": F.max(c), f"{name}/min": F.min(c)}


def scoped(df: DataFrame, source: str, metrics: dict[str, Column], scope: str = "all") -> DataFrame:
    """The metrics over everything and for each source, in one pass with grouping sets; the scope column tells them apart."""
    wide = df.rollup(source).agg(F.grouping(source).alias("_g"), *[v.cast("double").alias(k) for k, v in metrics.items()])
    wide = wide.withColumn("scope", F.when(F.col("_g") == 1, F.lit(scope)).otherwise(F.concat(F.lit(f"{scope}/"), F.coalesce(F.col(source), F.lit("null"))))).drop("_g", source)
    return wide.unpivot(["scope"], list(metrics), "metric", "value")


def best_worst(df: DataFrame, by: list[str], value: str, ks: list[int]) -> DataFrame:
    """Expected best@k and worst@k of k draws with replacement, exactly: the i-th smallest of n is the best with
    probability (i/n)^k - ((i-1)/n)^k. Also the std of the best."""
    w = Window.partitionBy(*by)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    i, n, v = F.col("_i"), F.col("_n"), F.col(value)
    out = []
    for k in ks:
        up = F.pow(i / n, F.lit(k)) - F.pow((i - 1) / n, F.lit(k))
        down = F.pow((n - i + 1) / n, F.lit(k)) - F.pow((n - i) / n, F.lit(k))
        out += [F.sum(v * up).alias(f"best@{k}"), F.sum(v * down).alias(f"worst@{k}"), F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v * up) - F.pow(F.sum(v * up), F.lit(2)))).alias(f"best@{k}/std")]
    return r.groupBy(*by).agg(*out)


def majority(df: DataFrame, by: list[str], answer: str, value: str, order: str) -> DataFrame:
    """The value of the most frequent answer's first row; ties go to the answer seen first."""
    votes = df.groupBy(*by, answer).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), F.min_by(value, order).alias("_v"))
    return votes.groupBy(*by).agg(F.max_by("_v", F.struct("_n", -F.col("_first"))).alias("majority"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with average ranks over the whole table. Ranks come from the counts of the distinct values (one row a value),
    which are summed in order range by range, so no task sorts the table."""
    from .protocol import with_position

    counts = with_position(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), column, name="_at")
    blocks = counts.withColumn("_b", F.floor(F.col("_at") / 4096))
    inside = F.sum("_n").over(Window.partitionBy("_b").orderBy("_at"))
    totals = blocks.groupBy("_b").agg(F.sum("_n").alias("_t")).select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
    ranked = blocks.withColumn("_in", inside).join(F.broadcast(totals), "_b").select(F.col(column).alias("_c"), (F.col("_before") + F.col("_in") - (F.col("_n") - 1) / 2.0).alias(out))
    # written, so that a value with very many rows can be split
    ranked = written(ranked)
    return df.hint("merge").join(ranked.hint("merge"), df[column].eqNullSafe(ranked["_c"])).drop("_c")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the average ranks, 0 where it is undefined."""
    r = average_ranks(average_ranks(df.select(a, b), a, "_ra"), b, "_rb")
    return r.agg(F.coalesce(F.nanvl(F.corr("_ra", "_rb"), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), parts)

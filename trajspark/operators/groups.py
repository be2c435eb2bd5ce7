"""Statistics and advantages over the attempts at one prompt (uid), as windows: one shuffle by uid serves them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def by_uid():
    return Window.partitionBy("uid")


def adv_grpo(score: str, by=None, divide: bool = True) -> Column:
    """(score - mean) / (sample std + 1e-6); a group of one has mean 0 and std 1."""
    by = by or by_uid()
    s, one = F.col(score), F.count(F.lit(1)).over(by) == 1
    centred = s - F.when(one, 0.0).otherwise(F.avg(s).over(by))
    return centred / (F.when(one, 1.0).otherwise(F.stddev_samp(s).over(by)) + EPS) if divide else centred


def adv_grpo_anb(score: str, by=None) -> Column:
    """As adv_grpo, with mean and std of the 0/1 indicator of a score that is not 0."""
    by = by or by_uid()
    hit, one = F.when(F.col(score) == 0, 0.0).otherwise(1.0), F.count(F.lit(1)).over(by) == 1
    return (F.col(score) - F.when(one, 0.0).otherwise(F.avg(hit).over(by))) / (F.when(one, 1.0).otherwise(F.stddev_samp(hit).over(by)) + EPS)


def adv_rloo(score: str, by=None) -> Column:
    """n/(n-1) * (score - mean); a group of one keeps its score."""
    by = by or by_uid()
    s, n = F.col(score), F.count(F.lit(1)).over(by)
    return F.when(n == 1, s).otherwise(n / (n - 1) * (s - F.avg(s).over(by)))


def centred(score: str, by=None) -> Column:
    """score - group mean, the mean of a group of one being 0."""
    by = by or by_uid()
    s = F.col(score)
    return s - F.when(F.count(F.lit(1)).over(by) == 1, 0.0).otherwise(F.avg(s).over(by))


ADVANTAGES: dict[str, Callable[[str], Column]] = {"grpo": adv_grpo, "grpo_no_std": lambda s: adv_grpo(s, divide=False), "grpo_anb": adv_grpo_anb, "rloo": adv_rloo, "centred": centred}


def advantage(name: str, score: str) -> Column:
    """Sequence-level estimator by name."""
    if name not in ADVANTAGES:
        raise ValueError(f"unknown estimator {name!r}; there are {sorted(ADVANTAGES)}")
    return ADVANTAGES[name](score)


def dynamic_sampling(df: DataFrame, score: str, by=None) -> DataFrame:
    """df with reason: kept for groups whose score varies (population std) or of one row, else std_0_mean_0 or std_0_mean_1
    (any mean but 0)."""
    by = by or by_uid()
    s = F.col(score)
    varies = (F.stddev_pop(s).over(by) > 0) | (F.count(F.lit(1)).over(by) == 1)
    return df.withColumn("reason", F.when(varies, "kept").when(F.avg(s).over(by) == 0, "std_0_mean_0").otherwise("std_0_mean_1"))


def group_accuracy(df: DataFrame, score: str, uid: str = "uid") -> DataFrame:
    """One row: max, min of the groups' share of score > 0, and the shares of groups at 1 and at 0."""
    g = df.groupBy(uid).agg(F.avg(F.when(F.col(score) > 0, 1.0).otherwise(0.0)).alias("acc"))
    share = lambda v: F.avg(F.when(F.col("acc") == v, 1.0).otherwise(0.0))
    return g.agg(F.max("acc").alias("max_acc"), F.min("acc").alias("min_acc"), share(1.0).alias("all_right"), share(0.0).alias("all_wrong"))


def paired_modes(df: DataFrame, uid: str, mode: str, value: str) -> DataFrame:
    """uid with the mean value in either mode, as columns true and false (pivot with fixed values: no extra pass)."""
    return df.withColumn("_mode", F.col(mode).cast("string")).groupBy(uid).pivot("_mode", ["true", "false"]).agg(F.avg(value))


def silent_death(df: DataFrame, by: str, components: list[str]) -> DataFrame:
    """by, component, n, unique_values, dead (at most one distinct value), min_value, max_value; groups of one are left out."""
    long = df.select(by, F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.round(c, 9).alias("v")) for c in components])))
    g = long.groupBy(by, "component").agg(F.count("v").alias("n"), F.countDistinct("v").alias("unique_values"), F.round(F.min("v"), 6).alias("min_value"), F.round(F.max("v"), 6).alias("max_value"))
    return g.where("n >= 2").withColumn("dead", F.col("unique_values") <= 1).select(by, "component", "n", "unique_values", "dead", "min_value", "max_value")

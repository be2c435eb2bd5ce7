"""Queries on group advantages and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..operators import groups as G
from ..registry import query

_W = "w AS (SELECT *, count(*) OVER g AS n, avg(accuracy) OVER g AS m, stddev_samp(accuracy) OVER g AS sd, stddev_pop(accuracy) OVER g AS psd, avg(CASE WHEN accuracy = 0 THEN 0.0 ELSE 1.0 END) OVER g AS hm, stddev_samp(CASE WHEN accuracy = 0 THEN 0.0 ELSE 1.0 END) OVER g AS hsd FROM fx_traj WINDOW g AS (PARTITION BY uid))"


def _estimator(name, expr):
    @query(f"adv_{name}", oracle(f"WITH {_W} SELECT traj_id, round({expr}, 6) AS adv FROM w"))
    def run(spark, d):
        return view(spark, d, "fx_traj").withColumn("adv", G.advantage(name, "accuracy")).select("traj_id", F.round("adv", 6).alias("adv"))

    return run


_estimator("grpo", "CASE WHEN n = 1 THEN accuracy / (1 + 1e-6) ELSE (accuracy - m) / (sd + 1e-6) END")
_estimator("grpo_no_std", "CASE WHEN n = 1 THEN accuracy ELSE accuracy - m END")
_estimator("grpo_anb", "CASE WHEN n = 1 THEN accuracy / (1 + 1e-6) ELSE (accuracy - hm) / (hsd + 1e-6) END")
_estimator("rloo", "CASE WHEN n = 1 THEN accuracy ELSE CAST(n AS DOUBLE) / (n - 1) * (accuracy - m) END")


@query("group_std", oracle(f"WITH {_W} SELECT traj_id, round(CASE WHEN n = 1 THEN 1.0 ELSE sd END, 6) AS group_std FROM w"))
def group_std(spark, d):
    n = F.count(F.lit(1)).over(G.by_uid())
    return view(spark, d, "fx_traj").withColumn("s", F.when(n == 1, 1.0).otherwise(F.stddev_samp("accuracy").over(G.by_uid()))).select("traj_id", F.round("s", 6).alias("group_std"))


@query("group_acc", oracle("WITH g AS (SELECT uid, avg(CASE WHEN accuracy > 0 THEN 1.0 ELSE 0.0 END) AS acc FROM fx_traj GROUP BY 1) SELECT max(acc) AS max_acc, min(acc) AS min_acc, round(avg(CASE WHEN acc = 1 THEN 1.0 ELSE 0.0 END), 6) AS all_right, round(avg(CASE WHEN acc = 0 THEN 1.0 ELSE 0.0 END), 6) AS all_wrong FROM g"))
def group_acc(spark, d):
    g = G.group_accuracy(view(spark, d, "fx_traj"), "accuracy")
    return g.select("max_acc", "min_acc", F.round("all_right", 6).alias("all_right"), F.round("all_wrong", 6).alias("all_wrong"))


@query("flt_dynamic_sampling", oracle(f"WITH {_W} SELECT CASE WHEN psd > 0 OR n = 1 THEN 'kept' WHEN m = 0 THEN 'std_0_mean_0' ELSE 'std_0_mean_1' END AS reason, count(*) AS n, min(traj_id) AS first FROM w GROUP BY 1"))
def flt_dynamic_sampling(spark, d):
    t = G.dynamic_sampling(view(spark, d, "fx_traj"), "accuracy")
    return t.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("traj_id").alias("first"))


_ALL = {"grpo": "CASE WHEN n = 1 THEN accuracy / (1 + 1e-6) ELSE (accuracy - m) / (sd + 1e-6) END", "rloo": "CASE WHEN n = 1 THEN accuracy ELSE CAST(n AS DOUBLE) / (n - 1) * (accuracy - m) END", "centred": "CASE WHEN n = 1 THEN accuracy ELSE accuracy - m END"}


@query("adv_dispatch", oracle(f"WITH {_W} SELECT data_source, " + ", ".join(f"round(avg(abs({e})), 5) AS {k}" for k, e in _ALL.items()) + " FROM w GROUP BY 1"))
def adv_dispatch(spark, d):
    """Estimators by name; all of them share one shuffle by uid."""
    t = view(spark, d, "fx_traj").withColumns({k: G.advantage(k, "accuracy") for k in _ALL})
    return t.groupBy("data_source").agg(*[F.round(F.avg(F.abs(k)), 5).alias(k) for k in _ALL])

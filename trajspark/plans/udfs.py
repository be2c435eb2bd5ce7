"""Queries on user-supplied functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import udf as U
from ..fixtures import oracle, view
from ..registry import query
from .text import _BLOCKS


@query("udf_score", oracle("SELECT id, CASE WHEN regexp_extract(response, '#### ([0-9]+)', 1) = ground_truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM fx_numeric"))
def udf_score(spark, d):
    """A function of a file beside the package, shipped to the executors and called from SQL by its registered name."""
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "examples", "number_scorer.py")
    U.shipped_scorer(spark, path, "score", "number_score", mark="#### ", points=1.0)
    view(spark, d, "fx_numeric").createOrReplaceTempView("fx_numeric")
    return spark.sql("SELECT id, number_score(data_source, response, ground_truth, '').score AS score FROM fx_numeric")


@query("udf_score_batch", oracle("SELECT id, CASE WHEN regexp_extract(response, '#### ([0-9]+)', 1) = ground_truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM fx_numeric"))
def udf_score_batch(spark, d):
    n = view(spark, d, "fx_numeric").select("id", "data_source", F.col("response").alias("solution"), "ground_truth")
    return U.batch_scorer(n, lambda s, x, g: [a.rsplit("#### ", 1)[1] == b for a, b in zip(x, g)]).select("id", "score")


@query("udaf_reducers", oracle("SELECT uid, max(accuracy) AS best, min(accuracy) AS worst FROM fx_traj GROUP BY 1"))
def udaf_reducers(spark, d):
    return U.reducers(view(spark, d, "fx_traj"), "uid", "accuracy", {"best": lambda v: v.max(), "worst": lambda v: v.min()})


@query("udtf_parse_sql", oracle(f"WITH {_BLOCKS} SELECT raw_name AS tool_name, count(*) AS n FROM pc GROUP BY 1"))
def udtf_parse_sql(spark, d):
    U.register_all(spark)
    view(spark, d, "fx_responses").createOrReplaceTempView("fx_responses")
    return spark.sql("SELECT c.tool_name, count(*) AS n FROM fx_responses, LATERAL parse_calls(response) c GROUP BY 1")


@query("dataset_plugin", "SELECT count(*) AS n, count(DISTINCT o_orderkey // 4) AS prompts, sum(o_orderkey) AS ids FROM orders")
def dataset_plugin(spark, d):
    """The table's rows, read by the custom source."""
    U.register_all(spark)
    rows = spark.read.format("trajectory_rows").option("id", "o_orderkey").load(f"{d}/orders.parquet")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("prompts"), F.sum("id").alias("ids"))

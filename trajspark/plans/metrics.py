"""Queries on batch, source, validation and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table, trajectories, view
from ..operators import metrics as M
from ..operators import reward as R
from ..registry import query
from .rewards import TOTAL_CTE



def _unpivot(frm, exprs, by="", where=""):
    """UNION ALL of one SELECT a metric."""
    cols = f"{by}, " if by else ""
    group = f" GROUP BY {by.split(' AS ')[0]}" if by else ""
    return " UNION ALL ".join(f"SELECT {cols}'{k}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM {frm}{where}{group}" for k, e in exprs.items())


_SPREAD = lambda name, c: {f"{name}/mean": f"avg({c})", f"{name}/max": f"max({c})", f"{name}/min": f"min({c})"}
_BATCH_SQL = {"acc": "avg(accuracy)", **_SPREAD("score", "accuracy"), **_SPREAD("length", "trajlength"), "length/clip_ratio": "avg(CASE WHEN trajlength >= 128000 THEN 1.0 ELSE 0.0 END)", "positive/count": "sum(CASE WHEN accuracy > 0 THEN 1 ELSE 0 END)", "count": "count(*)"}


def _batch():
    clip = F.avg(F.when(F.col("trajlength") >= 128_000, 1.0).otherwise(0.0))
    return {"acc": F.avg("accuracy"), **M.spread("score", "accuracy"), **M.spread("length", "trajlength"), "length/clip_ratio": clip, "positive/count": F.count_if(F.col("accuracy") > 0), "count": F.count(F.lit(1))}


@query("agg_batch", oracle(_unpivot("fx_traj", _BATCH_SQL, "step")))
def agg_batch(spark, d):
    return M.long_metrics(view(spark, d, "fx_traj"), ["step"], _batch()).withColumn("value", F.round("value", 6))


@query("agg_by_source", oracle(_unpivot("fx_traj", _BATCH_SQL, "data_source")))
def agg_by_source(spark, d):
    return M.long_metrics(view(spark, d, "fx_traj"), ["data_source"], _batch()).withColumn("value", F.round("value", 6))


@query("agg_pool", oracle(_unpivot("fx_traj", _BATCH_SQL, "'pool' AS scope").replace(" GROUP BY 'pool'", "") + " UNION ALL " + _unpivot("fx_traj", _BATCH_SQL, "concat('pool/', data_source) AS scope")))
def agg_pool(spark, d):
    return M.scoped(view(spark, d, "fx_traj"), "data_source", _batch(), "pool").withColumn("value", F.round("value", 6))


@query("agg_ratios", oracle("SELECT 'data_source' AS kind, data_source AS name, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fx_traj), 6) AS share FROM fx_traj GROUP BY 2 UNION ALL SELECT 'ability', ability, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fx_traj), 6) FROM fx_traj GROUP BY 2"))
def agg_ratios(spark, d):
    """Both shares in one aggregation; the total is the sum of one kind's few counts."""
    from pyspark.sql import Window

    t = view(spark, d, "fx_traj").select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("data_source", "ability")])))
    g = t.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return g.select("kind", "name", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6).alias("share"))


_TOOLS = "k AS (SELECT t.traj_id, data_source, coalesce(n, 0) AS n FROM fx_traj t LEFT JOIN (SELECT traj_id, count(*) AS n FROM fx_calls GROUP BY 1) c ON t.traj_id = c.traj_id), x AS (SELECT max(n) AS top FROM k)"


@query("agg_tool", oracle(f"WITH {_TOOLS} SELECT data_source, round(avg(n), 6) AS mean, max(n) AS most, min(n) AS least, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS none, round(avg(CASE WHEN n = top THEN 1.0 ELSE 0.0 END), 6) AS at_max FROM k, x GROUP BY 1"))
def agg_tool(spark, d):
    t = trajectories(spark, d).select("data_source", F.size("tool_calls").cast("long").alias("n"))
    t = t.crossJoin(F.broadcast(t.agg(F.max("n").alias("top"))))  # one row
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return t.groupBy("data_source").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"), share(F.col("n") == 0).alias("none"), share(F.col("n") == F.col("top")).alias("at_max"))


@query("agg_end_reason", oracle("SELECT coalesce(end_reason, 'reserved') AS end_reason, count(*) AS n, CAST(sum(accuracy) AS BIGINT) AS n_right, round(avg(accuracy), 6) AS acc FROM fx_traj GROUP BY 1 UNION ALL SELECT 'reserved', count(*), CAST(sum(accuracy) AS BIGINT), round(avg(accuracy), 6) FROM fx_traj WHERE end_reason IN ('DONE', 'EXCEED_MAX_TURNS')"))
def agg_end_reason(spark, d):
    t = view(spark, d, "fx_traj")
    keys = F.when(F.col("end_reason").isin("DONE", "EXCEED_MAX_TURNS"), F.array(F.col("end_reason"), F.lit("reserved"))).otherwise(F.array("end_reason"))
    t = t.withColumn("end_reason", F.explode(keys))
    return t.groupBy("end_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("accuracy").cast("long").alias("n_right"), F.round(F.avg("accuracy"), 6).alias("acc"))


@query("agg_timing", oracle("WITH s AS (SELECT step, count(*) * 0.5 AS gen, count(*) * 0.25 AS reward, sum(trajlength) AS tokens FROM fx_traj GROUP BY 1) SELECT step, 'gen' AS section, round(CAST(gen AS DOUBLE), 6) AS seconds, round(CAST(gen AS DOUBLE) * 1000 / tokens, 6) AS ms_per_token FROM s UNION ALL SELECT step, 'reward', round(CAST(reward AS DOUBLE), 6), round(CAST(reward AS DOUBLE) * 1000 / tokens, 6) FROM s"))
def agg_timing(spark, d):
    """Timing rows (here: derived from the counts) against the step's tokens."""
    s = view(spark, d, "fx_traj").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("trajlength").alias("tokens"))
    rows = s.select("step", "tokens", F.inline(F.array(*[F.struct(F.lit(k).alias("section"), (F.col("n") * x).alias("seconds")) for k, x in (("gen", 0.5), ("reward", 0.25))])))
    return rows.select("step", "section", F.round("seconds", 6).alias("seconds"), F.round(F.col("seconds") * 1000 / F.col("tokens"), 6).alias("ms_per_token"))


@query("agg_throughput", oracle("SELECT step, sum(trajlength) AS tokens, CAST(count(*) * 0.5 AS DOUBLE) AS seconds, round(sum(trajlength) / (count(*) * 0.5 * 4), 6) AS tokens_per_gpu_second FROM fx_traj GROUP BY 1"))
def agg_throughput(spark, d):
    s = view(spark, d, "fx_traj").groupBy("step").agg(F.sum("trajlength").alias("tokens"), (F.count(F.lit(1)) * 0.5).alias("seconds"))
    return s.withColumn("tokens_per_gpu_second", F.round(F.col("tokens") / (F.col("seconds") * 4), 6))


@query("val_mean_std", oracle("WITH p AS (SELECT data_source, uid, avg(accuracy) AS m, stddev_pop(accuracy) AS s FROM fx_traj GROUP BY 1, 2) SELECT data_source, round(avg(m), 6) AS mean_n, round(avg(s), 6) AS std_n FROM p GROUP BY 1"))
def val_mean_std(spark, d):
    p = view(spark, d, "fx_traj").groupBy("data_source", "uid").agg(F.avg("accuracy").alias("m"), F.stddev_pop("accuracy").alias("s"))
    return p.groupBy("data_source").agg(F.round(F.avg("m"), 6).alias("mean_n"), F.round(F.avg("s"), 6).alias("std_n"))


_BW = """r AS (SELECT uid, CAST(trajlength AS DOUBLE) AS v, row_number() OVER (PARTITION BY uid ORDER BY trajlength) AS i, count(*) OVER (PARTITION BY uid) AS n FROM fx_traj)"""


@query("val_best_worst", oracle(f"WITH {_BW} SELECT uid, " + ", ".join(f"round(sum(v * (pow(CAST(i AS DOUBLE) / n, {k}) - pow((i - 1.0) / n, {k}))), 4) AS best_{k}, round(sum(v * (pow((n - i + 1.0) / n, {k}) - pow((n - i) / CAST(n AS DOUBLE), {k}))), 4) AS worst_{k}" for k in (2, 4)) + " FROM r GROUP BY 1"))
def val_best_worst(spark, d):
    b = M.best_worst(view(spark, d, "fx_traj").withColumn("v", F.col("trajlength").cast("double")), ["uid"], "v", [2, 4])
    return b.select("uid", *[F.round(f"`{w}@{k}`", 4).alias(f"{w}_{k}") for k in (2, 4) for w in ("best", "worst")])


@query("val_majority", oracle("WITH v AS (SELECT uid, pred, count(*) AS n, min(traj_id) AS first, arg_min(accuracy, traj_id) AS acc FROM fx_traj GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) AS r FROM v) SELECT uid, acc AS majority FROM r WHERE r = 1"))
def val_majority(spark, d):
    return M.majority(view(spark, d, "fx_traj"), ["uid"], "pred", "accuracy", "traj_id")


def _draws(draws):
    """DuckDB: the attempts of each prompt numbered, and the hashed picks for every number of attempts."""
    return f"""cnt AS (SELECT DISTINCT count(*) AS n FROM fx_traj GROUP BY uid),
ks AS (SELECT n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], lambda x: x < n), n)) AS k FROM cnt),
bs AS (SELECT n, k, unnest(range(1, {draws + 1})) AS b FROM ks), js AS (SELECT n, k, b, unnest(range(1, k + 1)) AS j FROM bs),
picks AS (SELECT n, k, b, j, CAST(concat('0x', substr(md5(concat('42-', k, '-', b, '-', j)), 1, 8)) AS BIGINT) % n + 1 AS i FROM js)"""


_BOOT = f"""{_draws(1000)}, r AS (SELECT uid, data_source, CAST(trajlength AS DOUBLE) AS v, row_number() OVER (PARTITION BY uid ORDER BY trajlength) AS i, count(*) OVER (PARTITION BY uid) AS n FROM fx_traj),
ends AS (SELECT n, k, b, max(i) AS hi, min(i) AS lo FROM picks GROUP BY 1, 2, 3),
up AS (SELECT n, k, hi AS i, count(*) AS w FROM ends GROUP BY 1, 2, 3), down AS (SELECT n, k, lo AS i, count(*) AS w FROM ends GROUP BY 1, 2, 3),
best AS (SELECT uid, k, sum(v * w) / 1000 AS m, sqrt(greatest(0.0, sum(v * v * w) / 1000 - pow(sum(v * w) / 1000, 2))) AS s FROM r JOIN up ON r.n = up.n AND r.i = up.i GROUP BY 1, 2),
worst AS (SELECT uid, k, sum(v * w) / 1000 AS m, sqrt(greatest(0.0, sum(v * v * w) / 1000 - pow(sum(v * w) / 1000, 2))) AS s FROM r JOIN down ON r.n = down.n AND r.i = down.i GROUP BY 1, 2)"""


@query("val_bootstrap", oracle(f"WITH {_BOOT} SELECT b.uid, CAST(b.k AS BIGINT) AS k, round(b.m, 4) AS best, round(b.s, 3) AS best_std, round(w.m, 4) AS worst, round(w.s, 3) AS worst_std FROM best b JOIN worst w ON b.uid = w.uid AND b.k = w.k"))
def val_bootstrap(spark, d):
    """Best and worst of k of a prompt's attempts over 1,000 draws with replacement, k = 2, 4, 8, ... n."""
    from ..operators.resampling import bootstrap_best_worst

    t = view(spark, d, "fx_traj").withColumn("v", F.col("trajlength").cast("double"))
    b = bootstrap_best_worst(t, ["uid"], "v")
    return b.select("uid", "k", F.round("best", 4).alias("best"), F.round("best_std", 3).alias("best_std"), F.round("worst", 4).alias("worst"), F.round("worst_std", 3).alias("worst_std"))


_MAJ = f"""{_draws(200)}, r AS (SELECT uid, data_source, pred, accuracy, row_number() OVER (PARTITION BY uid ORDER BY traj_id) AS i, count(*) OVER (PARTITION BY uid) AS n FROM fx_traj),
votes AS (SELECT uid, k, b, pred, count(*) AS c, min(j) AS j, arg_min(accuracy, j) AS v FROM r JOIN picks p ON r.n = p.n AND r.i = p.i GROUP BY 1, 2, 3, 4),
won AS (SELECT uid, k, b, arg_max(v, c * 100000 - j) AS v FROM votes GROUP BY 1, 2, 3)"""


@query("val_majority_draws", oracle(f"WITH {_MAJ} SELECT uid, CAST(k AS BIGINT) AS k, round(avg(v), 6) AS majority, round(stddev_pop(v), 6) AS majority_std FROM won GROUP BY 1, 2"))
def val_majority_draws(spark, d):
    """The value of the most frequent answer among k of a prompt's attempts over 200 draws, k = 2, 4, 8, ... n."""
    from ..operators.resampling import bootstrap_majority

    b = bootstrap_majority(view(spark, d, "fx_traj"), ["uid"], "pred", "accuracy", "traj_id", draws=200)
    return b.select("uid", "k", F.round("majority", 6).alias("majority"), F.round("majority_std", 6).alias("majority_std"))


@query("val_acc_by_source", oracle("SELECT data_source, round(avg(accuracy), 6) AS acc FROM fx_traj GROUP BY 1"))
def val_acc_by_source(spark, d):
    return view(spark, d, "fx_traj").groupBy("data_source").agg(F.round(F.avg("accuracy"), 6).alias("acc"))


@query("eval_by_source", oracle("WITH p AS (SELECT data_source, uid, avg(accuracy) AS m FROM fx_traj GROUP BY 1, 2) SELECT data_source, round(avg(m), 6) AS score FROM p GROUP BY 1"))
def eval_by_source(spark, d):
    """Rows with a list of responses each: the mean of the rows' means."""
    rows = view(spark, d, "fx_traj").groupBy("data_source", "uid").agg(F.collect_list("accuracy").alias("responses"))
    each = rows.select("data_source", "uid", F.explode("responses").alias("score")).groupBy("data_source", "uid").agg(F.avg("score").alias("m"))
    return each.groupBy("data_source").agg(F.round(F.avg("m"), 6).alias("score"))


_EVAL = "e AS (SELECT *, CASE WHEN pred_ans = 'ERROR' THEN 0.0 WHEN length(pred_ans) = 1 THEN CASE WHEN pred_ans = left(answer, 1) THEN 1.0 ELSE 0.0 END WHEN length(pred_ans) = 2 THEN CASE WHEN contains(pred_ans, left(answer, 1)) THEN 1.0 ELSE 0.0 END WHEN contains(pred_ans, answer) THEN 1.0 ELSE 0.0 END AS acc FROM fx_eval)"


def _evaluated(spark, d):
    from ..functions.scorers import judge_rules

    e = view(spark, d, "fx_eval")
    return e.withColumn("acc", F.when(F.col("pred_ans") == "ERROR", 0.0).otherwise(F.coalesce(judge_rules(F.col("pred_ans"), F.col("answer")), F.lit(0)).cast("double")))


@query("eval_micro", oracle(f"WITH {_EVAL} SELECT test_type, count(*) AS n, round(avg(acc), 6) AS acc, count(*) FILTER (WHERE pred_ans = 'ERROR') AS errors FROM e GROUP BY 1 UNION ALL SELECT NULL, count(*), round(avg(acc), 6), count(*) FILTER (WHERE pred_ans = 'ERROR') FROM e"))
def eval_micro(spark, d):
    return _evaluated(spark, d).rollup("test_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("acc"), 6).alias("acc"), F.count_if(F.col("pred_ans") == "ERROR").alias("errors"))


@query("eval_macro", oracle(f"WITH {_EVAL}, g AS (SELECT test_type, category, avg(acc) AS acc FROM e GROUP BY 1, 2) SELECT test_type, round(avg(acc), 6) AS macro FROM g GROUP BY 1"))
def eval_macro(spark, d):
    g = _evaluated(spark, d).groupBy("test_type", "category").agg(F.avg("acc").alias("acc"))
    return g.groupBy("test_type").agg(F.round(F.avg("acc"), 6).alias("macro"))


_STATS = {"full_reward": "accuracy + u - 0.5 * c + 0.3 * s", "baseline": "CASE WHEN accuracy > 0 THEN accuracy + 0.1 * n ELSE 0 END"}


@query("analysis_stats", oracle(f"WITH {TOTAL_CTE} SELECT count(*) AS n, CAST(sum(accuracy) AS BIGINT) AS n_right, " + ", ".join(f"round(avg({e}), 6) AS {k}_mean, round(stddev_pop({e}), 6) AS {k}_std" for k, e in _STATS.items()) + " FROM r WHERE status <> 'error'"))
def analysis_stats(spark, d):
    t = R.with_scores(trajectories(spark, d).where("status <> 'error'"))
    t = t.select("accuracy", R.reward_column(R.PRESETS["full"]).alias("full_reward"), R.reward_baseline(F.col("accuracy"), F.size("tool_calls")).alias("baseline"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum("accuracy").cast("long").alias("n_right"), *[f(c) for c in _STATS for f in (lambda c: F.round(F.avg(c), 6).alias(f"{c}_mean"), lambda c: F.round(F.stddev_pop(c), 6).alias(f"{c}_std"))])


@query("spearman", oracle("WITH a AS (SELECT rank() OVER (ORDER BY trajlength) + (count(*) OVER (PARTITION BY trajlength) - 1) / 2.0 AS ra, rank() OVER (ORDER BY accuracy) + (count(*) OVER (PARTITION BY accuracy) - 1) / 2.0 AS rb FROM fx_traj) SELECT round(corr(ra, rb), 6) AS rho FROM a"))
def spearman(spark, d):
    return M.spearman(view(spark, d, "fx_traj"), "trajlength", "accuracy").select(F.round("rho", 6).alias("rho"))


@query("redundancy_rate", oracle(f"WITH {TOTAL_CTE} SELECT round(avg(least(1.0, 2 * c / n)), 6) AS rate FROM r WHERE n > 0"))
def redundancy_rate(spark, d):
    t = R.with_costs(trajectories(spark, d)).where(F.size("tool_calls") > 0)
    return t.agg(F.round(F.avg(F.least(F.lit(1.0), 2 * F.col("cost") / F.size("tool_calls"))), 6).alias("rate"))


@query("tool_histogram", oracle("SELECT tool_name, count(*) AS n FROM fx_calls GROUP BY 1"))
def tool_histogram(spark, d):
    return view(spark, d, "fx_calls").groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"))


@query("build_stats", "WITH t AS (SELECT len(string_split(text, ' ')) AS n FROM documents) SELECT count(*) AS n_rows, count(*) FILTER (WHERE n > 500) AS truncated, min(n) AS least, CAST(median(n) AS DOUBLE) AS middle, max(n) AS most FROM t")
def build_stats(spark, d):
    t = table(spark, d, "documents").select(F.size(F.split("text", " ")).cast("long").alias("n"))
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") > 500).alias("truncated"), F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"))


@query("subset_stats", oracle("SELECT count(*) AS candidates, count(*) FILTER (WHERE status = 'success') AS kept, count(*) FILTER (WHERE status = 'error') AS failed, count(m.uid) AS score_hits FROM fx_traj t LEFT JOIN fx_score_map m ON t.uid = m.uid"))
def subset_stats(spark, d):
    t = view(spark, d, "fx_traj").join(view(spark, d, "fx_score_map"), "uid", "left")
    return t.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("status") == "success").alias("kept"), F.count_if(F.col("status") == "error").alias("failed"), F.count("delta_s").alias("score_hits"))


@query("reduce_metrics", oracle("SELECT metric, round(avg(value), 6) AS value FROM (SELECT 'acc' AS metric, accuracy AS value FROM fx_traj UNION ALL SELECT 'length', CAST(trajlength AS DOUBLE) FROM fx_traj) m GROUP BY 1"))
def reduce_metrics(spark, d):
    t = view(spark, d, "fx_traj").select(F.inline(F.array(F.struct(F.lit("acc").alias("metric"), F.col("accuracy").alias("value")), F.struct(F.lit("length").alias("metric"), F.col("trajlength").cast("double").alias("value")))))
    return t.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"))

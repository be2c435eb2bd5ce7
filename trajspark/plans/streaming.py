"""Queries on streaming jobs: tables are written as files, streamed with availableNow, and the sink is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table, trajectories, view
from ..registry import query
from ..sources.io import written
from ..streaming import jobs as J
from ..streaming import state
from .io import scratch
from .rewards import TOTAL_CTE


def streamed(spark, df, files=4):
    """df as a stream of files, and a folder for sinks."""
    path = scratch(spark)
    df.repartition(files, df.columns[0]).write.parquet(f"{path}/in")
    return J.read_stream(spark, f"{path}/in", df.schema, 1), path


@query("stream_score", oracle(f"WITH {TOTAL_CTE} SELECT traj_id, round(accuracy + u - 0.5 * c + 0.3 * s, 6) AS reward FROM r"))
def stream_score(spark, d):
    """Eight files in one trigger: the nested plan is made once for each micro-batch."""
    t = trajectories(spark, d)
    path = scratch(spark)
    t.repartition(8, "traj_id").write.parquet(f"{path}/in")
    s = J.read_stream(spark, f"{path}/in", t.schema, 8)
    J.run_once(J.score(s).select("traj_id", F.round("reward", 6).alias("reward")), f"{path}/out", f"{path}/ck")
    return spark.read.parquet(f"{path}/out")


@query("stream_dedupe", oracle("SELECT DISTINCT uid FROM fx_traj"))
def stream_dedupe(spark, d):
    """A key's state goes when the watermark passes it; the delay is the time that the table spans, so every copy meets it."""
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    s, path = streamed(spark, t)
    J.run_once(J.dedupe(s, "uid", "ts", _span(t)).select("uid"), f"{path}/out", f"{path}/ck")
    return spark.read.parquet(f"{path}/out")


@query("stream_step_metrics", oracle("SELECT step, count(*) AS n, round(avg(accuracy), 6) AS acc FROM fx_traj GROUP BY 1"))
def stream_step_metrics(spark, d):
    """Complete mode through foreachBatch: the last batch's table holds all steps."""
    s, path = streamed(spark, view(spark, d, "fx_traj").select("traj_id", "step", "accuracy"), 2)
    m = J.step_metrics(s, {"n": F.count(F.lit(1)), "acc": F.round(F.avg("accuracy"), 6)})
    write = lambda b, i: b.withColumn("b", F.lit(i)).write.mode("append").parquet(f"{path}/out")
    m.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.join(F.broadcast(out.agg(F.max("b").alias("b"))), "b").drop("b")


@query("stream_windows", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Tumbling event-time windows over files of no order: the watermark waits for the time that the table spans. The batch that
    closes all windows is a last row far ahead."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path = scratch(spark)
    e.repartition(4, "event_id").write.parquet(f"{path}/in")
    _far_ahead(e, {"event_id": -1, "event_type": "end"}).write.mode("append").parquet(f"{path}/in")
    s = J.read_stream(spark, f"{path}/in", e.schema, 2)
    w = J.windowed_metrics(s, "ts", "1 hour", _span(e), ["event_type"], {"n": F.count(F.lit(1))})
    J.run_once(w, f"{path}/out", f"{path}/ck")
    out = spark.read.parquet(f"{path}/out").where("event_type <> 'end'")
    return out.select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n")


_WAITED = """WITH RECURSIVE o AS (SELECT o_custkey AS uid, o_orderkey AS traj_id, accuracy AS score, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders JOIN fx_traj f ON f.traj_id = o_orderkey),
g AS (SELECT uid, r, traj_id, score, 1 AS gid, 1 AS c, t AS begun FROM o WHERE r = 1
  UNION ALL SELECT o.uid, o.r, o.traj_id, o.score, CASE WHEN g.c = 4 OR o.t > g.begun + 17280000000 THEN g.gid + 1 ELSE g.gid END, CASE WHEN g.c = 4 OR o.t > g.begun + 17280000000 THEN 1 ELSE g.c + 1 END, CASE WHEN g.c = 4 OR o.t > g.begun + 17280000000 THEN o.t ELSE g.begun END FROM g JOIN o ON o.uid = g.uid AND o.r = g.r + 1),
w AS (SELECT uid, traj_id, score, count(*) OVER k AS n, avg(score) OVER k AS m, stddev_samp(score) OVER k AS sd FROM g WINDOW k AS (PARTITION BY uid, gid))
SELECT uid, traj_id, CAST(n AS INTEGER) AS n, n = 4 AS complete, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (sd + 1e-6) END, 5) AS advantage FROM w"""


@query("stream_group", oracle(_WAITED).replace("WITH fx_traj AS", "WITH RECURSIVE fx_traj AS").replace(", RECURSIVE o AS", ", o AS"))
def stream_group(spark, d):
    """Groups of four attempts of a customer within 200 days, each year's orders in files of their own; a timer gives out groups that stay
    short. A last row far ahead moves the watermark past all timers. Buckets of about 8,000 rows, files of at most some 4 million."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    t = view(spark, d, "fx_traj").select("uid", "traj_id", F.col("accuracy").alias("score"))
    t = written(t.hint("merge").join(o.hint("merge"), F.col("traj_id") == F.col("k")).select("uid", "traj_id", "score", "ts"))
    path, rows = scratch(spark), t.count()
    files = 2 + rows // 28_000_000
    years = [r[0] for r in t.select(F.year("ts")).distinct().orderBy(F.year("ts")).collect()]
    for y in years:  # a customer's orders of a year are in one file, and years come in order
        t.where(F.year("ts") == y).repartition(files, "uid").write.mode("append").parquet(f"{path}/in")
    _far_ahead(t, {"uid": -1, "traj_id": -1, "score": 0.0}).write.mode("append").parquet(f"{path}/in")
    state.use_rocksdb(spark)
    s = J.read_stream(spark, f"{path}/in", t.schema, 4 * files)
    J.run_once(state.wait_for_groups(s, 4, 200 * 86_400_000, "366 days", 16 + rows // 8_000), f"{path}/out", f"{path}/ck")
    return spark.read.parquet(f"{path}/out").where("uid >= 0").withColumn("advantage", F.round("advantage", 5))


_ENDS = """t AS (SELECT *, sum(n_tokens) OVER w AS tok, sum(n_images) OVER w AS img FROM fx_turns WINDOW w AS (PARTITION BY traj_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
r AS (SELECT traj_id, turn, CASE WHEN tok > 4000 THEN 'OVER_LENGTH' WHEN is_error THEN 'ERROR_IN_ACTION' WHEN done THEN 'DONE' WHEN turn + 1 >= 50 THEN 'EXCEED_MAX_TURNS' WHEN img >= 32 THEN 'EXCEED_MAX_IMAGE_NUM_32' END AS r FROM t),
f AS (SELECT traj_id, min(turn) FILTER (WHERE r IS NOT NULL) AS e, arg_min(r, turn) FILTER (WHERE r IS NOT NULL) AS reason, count(*) AS n FROM r GROUP BY 1)"""


@query("end_reason_batch", oracle(f"WITH {_ENDS} SELECT traj_id, coalesce(reason, 'ON_GOING') AS end_reason, coalesce(e + 1, n) AS turns, coalesce(e, n) AS tool_calls FROM f"))
def end_reason_batch(spark, d):
    return J.end_reasons(view(spark, d, "fx_turns"))


@query("stream_end_reason", oracle(f"WITH {_ENDS} SELECT traj_id, reason AS end_reason, e AS tool_calls FROM f WHERE reason IS NOT NULL"))
def stream_end_reason(spark, d):
    """Turns in files dealt by a hash, so that none comes in order."""
    t = view(spark, d, "fx_turns").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark)
    t.repartition(4, F.md5(F.concat_ws("-", "traj_id", "turn"))).write.parquet(f"{path}/in")
    _far_ahead(t, {"traj_id": -1, "turn": 0, "is_error": False, "done": True, "n_tokens": 0, "n_images": 0}).write.mode("append").parquet(f"{path}/in")
    state.use_rocksdb(spark)
    s = J.read_stream(spark, f"{path}/in", t.schema, 2)
    J.run_once(state.fold_turns(s, 86_400_000, _span(t)), f"{path}/out", f"{path}/ck")
    return spark.read.parquet(f"{path}/out").where("traj_id >= 0")


def _span(t):
    """The time that ts spans, and a day, as a delay."""
    days = t.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    return f"{days + 2} days"


def _far_ahead(t, values):
    """One row of t's columns, 100 years after its last."""
    last = t.agg((F.max("ts") + F.expr("interval 100 years")).alias("ts"))
    return last.select(*[F.col("ts") if f.name == "ts" else F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in t.schema])


_KEPT = "p AS (SELECT step, count(*) FILTER (WHERE accuracy > 0) AS k FROM fx_traj GROUP BY 1), u AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS batch, coalesce(sum(k) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)"


@query("stream_accumulate", oracle(f"WITH {_KEPT} SELECT t.traj_id, t.step, accuracy, batch FROM fx_traj t JOIN u ON t.step = u.step WHERE accuracy > 0 AND before < (SELECT count(*) / 3 FROM fx_traj WHERE accuracy > 0)"))
def stream_accumulate(spark, d):
    """Right answers, a step a batch, until a third of all are there."""
    t = view(spark, d, "fx_traj").select("traj_id", "step", "accuracy")
    path = scratch(spark)
    steps = [r[0] for r in t.select("step").distinct().orderBy("step").collect()]
    for step in steps:  # files come in the order of their times
        t.where(F.col("step") == step).coalesce(1).write.mode("append").parquet(f"{path}/in")
    target = -(-t.where("accuracy > 0").count() // 3)
    s = J.read_stream(spark, f"{path}/in", t.schema, 1)
    state.accumulate(s, lambda b: b.where("accuracy > 0"), target, f"{path}/out", f"{path}/ck")
    return spark.read.schema("traj_id long, step long, accuracy double, batch long").parquet(f"{path}/out/rows")


_SKETCHED = """s AS (SELECT step, count(*) AS n, min(accuracy) = max(accuracy) AS dead_accuracy, true AS dead_constant FROM fx_traj GROUP BY 1)"""


@query("stream_step_sketches", oracle(f"WITH {_SKETCHED} SELECT step, n, dead_accuracy, dead_constant, true AS distinct_close, true AS median_close, true AS q90_close FROM s"))
def stream_step_sketches(spark, d):
    """Partial sketches of each step in each batch, merged: the alarm for components that never change, and whether the
    estimates keep their bounds (distinct prompts within 5 %, quantiles within 0.02 in rank) against the exact batch form."""
    t = view(spark, d, "fx_traj").select("traj_id", "uid", "step", "accuracy", "trajlength").withColumn("constant", F.lit(0.6))
    s, path = streamed(spark, t)
    state.step_sketches(s, ["accuracy", "constant"], "uid", "trajlength", f"{path}/out", f"{path}/ck")
    m = written(state.merged_steps(spark, f"{path}/out", ["accuracy", "constant"]))
    both = t.hint("merge").join(m.select(F.col("step").alias("s"), "q50", "q90").hint("merge"), F.col("step") == F.col("s"))
    rank = lambda q: F.count_if(F.col("trajlength") <= F.col(q)) / F.count(F.lit(1))
    exact = both.groupBy("s").agg(F.countDistinct("uid").alias("u"), rank("q50").alias("r50"), rank("q90").alias("r90"))
    out = m.hint("merge").join(exact.hint("merge"), F.col("step") == F.col("s"))
    near = lambda c, q: F.abs(F.col(c) - q) <= 0.02 + 1 / F.col("n")
    return out.select("step", "n", "dead_accuracy", "dead_constant", (F.abs(F.col("distinct") - F.col("u")) <= 0.05 * F.col("u") + 1).alias("distinct_close"), near("r50", 0.5).alias("median_close"), near("r90", 0.9).alias("q90_close"))

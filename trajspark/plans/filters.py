"""Queries on rollout and trajectory filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table, trajectories, view
from ..operators import filters as FL
from ..operators import groups
from ..registry import query
from .geometry import _OVER


def _simple(name, where, condition):
    @query(name, oracle(f"SELECT traj_id FROM fx_traj WHERE {where}"))
    def run(spark, d):
        return FL.split_by_reason(FL.tagged(view(spark, d, "fx_traj"), [(name, condition())]))[0].select("traj_id")

    return run


_simple("flt_has_image", "has_image", lambda: FL.conditions()["hasimage"])
_simple("flt_traj_length", "trajlength <= 128000", lambda: FL.conditions()["trajlength"])
_simple("flt_vision_consistent", "vision_consistent", lambda: FL.conditions()["vtoken"])
_simple("flt_not_error", "status <> 'error'", lambda: F.col("status") != "error")
_simple("flt_overlong_prompt", "length(question) <= 25", lambda: F.length("question") <= 25)


@query("flt_end_reason", oracle("SELECT end_reason, count(*) AS n, end_reason IN ('DONE', 'EXCEED_MAX_TURNS') AS reserved FROM fx_traj GROUP BY 1"))
def flt_end_reason(spark, d):
    t = FL.tagged(view(spark, d, "fx_traj"), [("end_reason", FL.conditions(reserve=("DONE", "EXCEED_MAX_TURNS"))["end_reason"])])
    return t.groupBy("end_reason").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("reason") == "kept").alias("reserved"))


_G = """w AS (SELECT *, count(*) OVER g AS n, avg(accuracy) OVER g AS m, stddev_samp(accuracy) OVER g AS sd, stddev_pop(accuracy) OVER g AS psd FROM fx_traj WINDOW g AS (PARTITION BY uid)),
a AS (SELECT *, CASE WHEN n = 1 THEN accuracy / (1 + 1e-6) ELSE (accuracy - m) / (sd + 1e-6) END - CASE WHEN traj_id % 3 = 0 THEN 1 ELSE 0 END AS mean_adv, psd > 0 OR n = 1 AS varies FROM w)"""


def _with_group_columns(spark, d):
    """Group statistics first, then the filters: a third of the advantages is shifted so that the sign filter has work."""
    t = groups.dynamic_sampling(view(spark, d, "fx_traj"), "accuracy").withColumnRenamed("reason", "group_reason")
    return t.withColumn("mean_adv", groups.adv_grpo("accuracy") - F.when(F.col("traj_id") % 3 == 0, 1).otherwise(0))


@query("flt_pos_neg_adv", oracle(f"WITH {_G} SELECT traj_id FROM a WHERE NOT (accuracy > 0 AND mean_adv < 0)"))
def flt_pos_neg_adv(spark, d):
    return _with_group_columns(spark, d).where(FL.conditions()["pos_neg_adv"]).select("traj_id")


@query("flt_chain_train", oracle(f"WITH {_G} SELECT CASE WHEN NOT varies THEN 'seq_reward' WHEN NOT has_image THEN 'hasimage' WHEN NOT vision_consistent THEN 'vtoken' WHEN trajlength > 128000 THEN 'trajlength' WHEN end_reason <> 'DONE' THEN 'end_reason' WHEN accuracy > 0 AND mean_adv < 0 THEN 'pos_neg_adv' ELSE 'kept' END AS reason, count(*) AS n, sum(traj_id) AS ids FROM a GROUP BY 1"))
def flt_chain_train(spark, d):
    t = FL.chain_train(_with_group_columns(spark, d), ["pos_neg_adv", "end_reason", "trajlength", "vtoken", "hasimage", "seq_reward"])
    return t.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("traj_id").alias("ids"))


@query("flt_chain_validation", oracle("SELECT traj_id, CASE WHEN end_reason <> 'DONE' THEN 'end_reason' WHEN trajlength > 100000 THEN 'trajlength' ELSE 'kept' END AS reason FROM fx_traj"))
def flt_chain_validation(spark, d):
    return FL.chain_validation(view(spark, d, "fx_traj"), ["end_reason", "trajlength", "hasimage"], max_length=100_000).select("traj_id", "reason")


@query("flt_video_cap", oracle("WITH v AS (SELECT *, ability IN ('q0', 'q1') AS video FROM fx_traj), r AS (SELECT *, row_number() OVER (PARTITION BY step, video ORDER BY traj_id) AS r FROM v) SELECT traj_id, step FROM r WHERE NOT video OR r <= 5"))
def flt_video_cap(spark, d):
    return FL.video_cap(view(spark, d, "fx_traj"), "step", F.col("ability").isin("q0", "q1"), "traj_id", 5).select("traj_id", "step")


_REAL = "CASE WHEN tool_name = 'select' THEN false WHEN tool_name IN ('crop', 'zoom') THEN coalesce(x2 > x1 AND y2 > y1, false) WHEN tool_name = 'rotate' THEN output LIKE '%Rotated%' AND x1 IS NULL ELSE output LIKE '%OCR result%' END"


@query("flt_real_call", oracle(f"SELECT tool_name, count(*) AS calls, count(*) FILTER (WHERE {_REAL}) AS real FROM fx_calls GROUP BY 1"))
def flt_real_call(spark, d):
    c = view(spark, d, "fx_calls")
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    return c.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"), F.count_if(FL.real_call(F.col("tool_name"), F.col("output"), box)).alias("real"))


_COVER = f"""first AS (SELECT traj_id, min(step) AS s FROM fx_calls WHERE tool_name IN ('zoom', 'rotate') GROUP BY 1),
early AS (SELECT c.* FROM fx_calls c LEFT JOIN first f ON c.traj_id = f.traj_id WHERE (s IS NULL OR c.step <= s) AND x1 IS NOT NULL AND NOT (x1 <= 0 AND y1 <= 0 AND x2 >= 1 AND y2 >= 1)),
p AS (SELECT e.*, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2 FROM early e JOIN fx_gt g ON e.traj_id = g.traj_id),
cov AS (SELECT traj_id, max({_OVER} / ((gx2-gx1)*(gy2-gy1))) AS coverage FROM p GROUP BY 1)"""


def _with_coverage(spark, d):
    """trajectories with all ground-truth boxes as an array and the best early coverage."""
    boxes = view(spark, d, "fx_gt").groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("box_idx", F.array("x1", "y1", "x2", "y2").alias("box")))).alias("_b"))
    t = trajectories(spark, d).join(boxes, "traj_id", "left").withColumn("gt_boxes", F.transform("_b", lambda b: b["box"]))
    return t.withColumn("coverage", FL.max_gt_coverage(F.col("tool_calls"), F.col("gt_boxes"))).drop("_b")


@query("max_gt_coverage", oracle(f"WITH {_COVER} SELECT t.traj_id, round(coalesce(coverage, 0), 6) AS coverage FROM fx_traj t LEFT JOIN cov ON t.traj_id = cov.traj_id"))
def max_gt_coverage(spark, d):
    return _with_coverage(spark, d).select("traj_id", F.round("coverage", 6).alias("coverage"))


_SFT = f"""{_COVER}, q AS (SELECT traj_id, count(*) AS n, bool_and({_REAL}) AS real FROM fx_calls GROUP BY 1),
s AS (SELECT t.traj_id, t.data_source, CASE WHEN status <> 'success' THEN 'status' WHEN accuracy <> 1 THEN 'accuracy' WHEN coalesce(n, 0) = 0 THEN 'no_tool_calls' WHEN NOT real THEN 'unreal_call' WHEN coalesce(coverage, 0) < 0.3 THEN 'gt_coverage' ELSE 'kept' END AS reason,
  CASE WHEN status <> 'success' THEN 'status' WHEN accuracy <> 1 THEN 'accuracy' WHEN coalesce(n, 0) > 2 THEN 'has_tool_calls' ELSE 'kept' END AS direct FROM fx_traj t LEFT JOIN q ON t.traj_id = q.traj_id LEFT JOIN cov ON t.traj_id = cov.traj_id)"""


@query("flt_sft_tool", oracle(f"WITH {_SFT} SELECT traj_id, reason FROM s"))
def flt_sft_tool(spark, d):
    return FL.sft_tool(_with_coverage(spark, d), 0.3).select("traj_id", "reason")


@query("flt_sft_answer_first", oracle(f"WITH {_SFT} SELECT direct AS reason, count(*) AS n FROM s GROUP BY 1"))
def flt_sft_answer_first(spark, d):
    """The views have no trajectory without calls: the calls are cut to those after the second."""
    t = trajectories(spark, d).withColumn("tool_calls", F.expr("slice(tool_calls, 3, 1000)"))
    return FL.sft_answer_first(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("flt_sft_pipeline", oracle(f"WITH {_SFT} SELECT data_source AS source_file, reason, count(*) AS n FROM (SELECT data_source, CASE WHEN data_source LIKE '%LOW%' THEN direct ELSE reason END AS reason FROM s) r GROUP BY 1, 2"))
def flt_sft_pipeline(spark, d):
    """Rows are routed by the kind of file that they came from (here: the source), then counted by reason."""
    t = _with_coverage(spark, d)
    direct = FL.sft_answer_first(t.where("data_source like '%LOW%'").withColumn("tool_calls", F.expr("slice(tool_calls, 3, 1000)")))
    tools = FL.sft_tool(t.where("data_source not like '%LOW%'"), 0.3)
    both = tools.select("data_source", "reason").unionByName(direct.select("data_source", "reason"))
    return both.groupBy(F.col("data_source").alias("source_file"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("flt_label_present", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def flt_label_present(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels").where("quality is not null").select("doc_id"), "doc_id")


@query("flt_subset", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_partkey % 3 IN (0, 1) AND p_size IN (12, 15, 20, 25, 30) ORDER BY p_partkey LIMIT 50")
def flt_subset(spark, d):
    p = table(spark, d, "part").where((F.col("p_size") > 10) & (F.col("p_partkey") % 3).isin(0, 1) & F.col("p_size").isin(12, 15, 20, 25, 30))
    return p.orderBy("p_partkey").limit(50).select("p_partkey")

"""Queries on boxes: calls against ground truth, pixel annotations, image sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import geometry as G
from ..registry import query
from .rewards import iou_sql

_PAIRS = "p AS (SELECT c.traj_id, c.step, c.tool_name, g.box_idx, c.x1, c.y1, c.x2, c.y2, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2 FROM fx_calls c JOIN fx_gt g ON c.traj_id = g.traj_id WHERE c.x1 IS NOT NULL), gt AS (SELECT traj_id, step, box_idx, gx1 AS x1, gy1 AS y1, gx2 AS x2, gy2 AS y2 FROM p)"
_OVER = "greatest(0.0, least(x2,gx2)-greatest(x1,gx1))*greatest(0.0, least(y2,gy2)-greatest(y1,gy1))"


def pairs(spark, d):
    """Every call with a box against every box of its trajectory: an equi join."""
    c = view(spark, d, "fx_calls").where("x1 is not null").select("traj_id", "step", "tool_name", F.array("x1", "y1", "x2", "y2").alias("box"))
    g = view(spark, d, "fx_gt").select("traj_id", "box_idx", F.array("x1", "y1", "x2", "y2").alias("gt"))
    return c.join(g, "traj_id")


@query("iou", oracle(f"SELECT c.traj_id, c.step, g.box_idx, round(CAST({iou_sql('c', 'g')} AS DOUBLE), 6) AS value FROM fx_calls c JOIN fx_gt g ON c.traj_id = g.traj_id WHERE c.x1 IS NOT NULL"))
def iou(spark, d):
    return pairs(spark, d).select("traj_id", "step", "box_idx", F.round(G.iou(F.col("box"), F.col("gt")), 6).alias("value"))


@query("iou_demo", oracle(f"SELECT c.traj_id, round(max(CAST({iou_sql('c', 'g')} AS DOUBLE)), 6) AS value FROM fx_calls c JOIN fx_gt g ON c.traj_id = g.traj_id WHERE c.x1 IS NOT NULL GROUP BY 1"))
def iou_demo(spark, d):
    """The demo's variant is the same as iou on valid boxes."""
    return pairs(spark, d).groupBy("traj_id").agg(F.round(F.max(G.iou(F.col("box"), F.col("gt"))), 6).alias("value"))


@query("iou_strict", oracle(f"WITH {_PAIRS} SELECT traj_id, step, box_idx, round(CASE WHEN {_OVER} <= 0 THEN 0 ELSE {_OVER} / ((x2-x1)*(y2-y1) + (gx2-gx1)*(gy2-gy1) - {_OVER}) END, 6) AS value FROM p"))
def iou_strict(spark, d):
    return pairs(spark, d).select("traj_id", "step", "box_idx", F.round(G.iou_strict(F.col("box"), F.col("gt")), 6).alias("value"))


@query("gt_coverage", oracle(f"WITH {_PAIRS} SELECT traj_id, step, box_idx, round(CASE WHEN (gx2-gx1)*(gy2-gy1) > 0 THEN {_OVER} / ((gx2-gx1)*(gy2-gy1)) ELSE 0 END, 6) AS value FROM p"))
def gt_coverage(spark, d):
    return pairs(spark, d).select("traj_id", "step", "box_idx", F.round(G.gt_coverage(F.col("box"), F.col("gt")), 6).alias("value"))


_BEST = f"b AS (SELECT traj_id, step, max(CASE WHEN {_OVER} > 0 THEN {_OVER} / ((x2-x1)*(y2-y1) + (gx2-gx1)*(gy2-gy1) - {_OVER}) ELSE 0 END) AS best_iou, max({_OVER} / ((gx2-gx1)*(gy2-gy1))) AS best_cover FROM p GROUP BY 1, 2)"


@query("job_locate", oracle(f"WITH {_PAIRS}, {_BEST} SELECT traj_id, round(max(best_iou), 6) AS best_iou, round(max(best_cover), 6) AS best_cover, arg_min(best_iou, step) > 0.1 AS first_hit, count(*) FILTER (WHERE best_iou > 0.1) AS calls_hit FROM b GROUP BY 1"))
def job_locate(spark, d):
    per_call = pairs(spark, d).groupBy("traj_id", "step").agg(F.max(G.iou(F.col("box"), F.col("gt"))).alias("best_iou"), F.max(G.gt_coverage(F.col("box"), F.col("gt"))).alias("best_cover"))
    return per_call.groupBy("traj_id").agg(F.round(F.max("best_iou"), 6).alias("best_iou"), F.round(F.max("best_cover"), 6).alias("best_cover"), (F.min_by("best_iou", "step") > 0.1).alias("first_hit"), F.count_if(F.col("best_iou") > 0.1).alias("calls_hit"))


@query("gt_iou_stats", oracle(f"WITH {_PAIRS}, {_BEST}, t AS (SELECT traj_id, max(best_iou) AS best, arg_min(best_iou, step) AS first, count(*) AS calls, count(*) FILTER (WHERE best_iou > 0.1) AS hits FROM b GROUP BY 1) SELECT data_source, count(*) AS samples, round(avg(CASE WHEN best > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS samples_hit, round(CAST(sum(hits) AS DOUBLE) / sum(calls), 6) AS calls_hit, round(avg(coalesce(best, 0)), 6) AS mean_best, round(avg(CASE WHEN first > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS first_hit FROM fx_traj f LEFT JOIN t ON f.traj_id = t.traj_id GROUP BY 1"))
def gt_iou_stats(spark, d):
    per_call = pairs(spark, d).groupBy("traj_id", "step").agg(F.max(G.iou(F.col("box"), F.col("gt"))).alias("v"))
    t = per_call.groupBy("traj_id").agg(F.max("v").alias("best"), F.min_by("v", "step").alias("first"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("v") > 0.1).alias("hits"))
    share = lambda c: F.round(F.avg(F.when(F.col(c) > 0.1, 1.0).otherwise(0.0)), 6)
    j = view(spark, d, "fx_traj").join(t, "traj_id", "left").groupBy("data_source")
    return j.agg(F.count(F.lit(1)).alias("samples"), share("best").alias("samples_hit"), F.round(F.sum("hits") / F.sum("calls"), 6).alias("calls_hit"), F.round(F.avg(F.coalesce("best", F.lit(0.0))), 6).alias("mean_best"), share("first").alias("first_hit"))


def annotations(spark, d):
    return view(spark, d, "fx_annotations").withColumn("xywh", F.array("x", "y", "bw", "bh"))


@query("xywh_to_xyxy", oracle("SELECT id, [x, y, x + bw, y + bh] AS box FROM fx_annotations"))
def xywh_to_xyxy(spark, d):
    return annotations(spark, d).select("id", G.xywh_to_xyxy(F.col("xywh")).alias("box"))


_CLAMP = "cl AS (SELECT *, greatest(0, least(x, w)) AS cx1, greatest(0, least(y, h)) AS cy1, greatest(0, least(x + bw, w)) AS cx2, greatest(0, least(y + bh, h)) AS cy2 FROM fx_annotations)"


@query("clamp_box", oracle(f"WITH {_CLAMP} SELECT id, [cx1, cy1, cx2, cy2] AS box, cx2 <= cx1 OR cy2 <= cy1 AS empty FROM cl"))
def clamp_box(spark, d):
    a = annotations(spark, d).withColumn("box", G.clamp_box(G.xywh_to_xyxy(F.col("xywh")), F.col("w"), F.col("h")))
    return a.select("id", "box", G.empty_box(F.col("box")).alias("empty"))


@query("norm_box", oracle("SELECT id, round(CAST(x AS DOUBLE) / w, 6) AS x1, round(CAST(y AS DOUBLE) / h, 6) AS y1, round(CAST(x + bw AS DOUBLE) / w, 6) AS x2, round(CAST(y + bh AS DOUBLE) / h, 6) AS y2 FROM fx_annotations"))
def norm_box(spark, d):
    n = G.norm_box(G.xywh_to_xyxy(F.col("xywh")), F.col("w"), F.col("h"))
    return annotations(spark, d).select("id", *[F.round(n[i], 6).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])


@query("denorm_box", oracle("SELECT traj_id, step, x1 * 1690 AS x1, y1 * 1500 AS y1, x2 * 1690 AS x2, y2 * 1500 AS y2 FROM fx_calls WHERE x1 IS NOT NULL"))
def denorm_box(spark, d):
    c = view(spark, d, "fx_calls").where("x1 is not null")
    n = G.denorm_box(F.array("x1", "y1", "x2", "y2"), F.lit(1690.0), F.lit(1500.0))
    return c.select("traj_id", "step", *[n[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])


_MIX = "m AS (SELECT traj_id, step, CASE WHEN step % 2 = 0 THEN 1690.0 ELSE 1.0 END AS sx, CASE WHEN step % 2 = 0 THEN 1500.0 ELSE 1.0 END AS sy, x1, y1, x2, y2 FROM fx_calls WHERE x1 IS NOT NULL)"


@query("norm_if_pixel", oracle(f"WITH {_MIX} SELECT traj_id, step, round(CASE WHEN x2 * sx > 1 OR y2 * sy > 1 THEN x1 * sx / 1690 ELSE x1 * sx END, 6) AS x1, round(CASE WHEN x2 * sx > 1 OR y2 * sy > 1 THEN y2 * sy / 1500 ELSE y2 * sy END, 6) AS y2 FROM m"))
def norm_if_pixel(spark, d):
    """Every other call's box is given in pixels."""
    c = view(spark, d, "fx_calls").where("x1 is not null")
    by = lambda k: F.when(F.col("step") % 2 == 0, float(k)).otherwise(1.0)
    box = G.denorm_box(F.array("x1", "y1", "x2", "y2"), by(1690), by(1500))
    n = G.norm_if_pixel(box, F.lit(1690.0), F.lit(1500.0))
    return c.select("traj_id", "step", F.round(n[0], 6).alias("x1"), F.round(n[3], 6).alias("y2"))


@query("job_normalise_boxes", oracle(f"WITH {_CLAMP} SELECT test_type, count(*) AS boxes, count(*) FILTER (WHERE cx2 > cx1 AND cy2 > cy1) AS valid, count(*) FILTER (WHERE NOT (cx2 > cx1 AND cy2 > cy1)) AS empty, round(avg(CAST(cx2 - cx1 AS DOUBLE) / w), 6) AS mean_width FROM cl GROUP BY 1"))
def job_normalise_boxes(spark, d):
    a = annotations(spark, d).withColumn("box", G.clamp_box(G.xywh_to_xyxy(F.col("xywh")), F.col("w"), F.col("h")))
    empty = G.empty_box(F.col("box"))
    width = G.norm_box(F.col("box"), F.col("w"), F.col("h"))
    return a.groupBy("test_type").agg(F.count(F.lit(1)).alias("boxes"), F.count_if(~empty).alias("valid"), F.count_if(empty).alias("empty"), F.round(F.avg(width[2] - width[0]), 6).alias("mean_width"))


@query("full_image", oracle("SELECT id FROM fx_annotations WHERE x <= 0 AND y <= 0 AND x + bw * 40 >= w - 1 AND y + bh * 40 >= h - 1"))
def full_image(spark, d):
    box = F.array("x", "y", F.col("x") + F.col("bw") * 40, F.col("y") + F.col("bh") * 40)
    return view(spark, d, "fx_annotations").where(G.full_image(box, F.col("w"), F.col("h"))).select("id")


@query("map_box", oracle("SELECT id, [greatest(0, least(CAST(trunc(x * 0.5) AS BIGINT), 845)), greatest(0, least(CAST(trunc(y * 0.5) AS BIGINT), 750)), greatest(0, least(CAST(trunc((x + bw) * 0.5) AS BIGINT), 845)), greatest(0, least(CAST(trunc((y + bh) * 0.5) AS BIGINT), 750))] AS box FROM fx_annotations"))
def map_box(spark, d):
    return annotations(spark, d).select("id", G.map_box(G.xywh_to_xyxy(F.col("xywh")), F.lit(0.5), F.lit(0.5), F.lit(845), F.lit(750)).alias("box"))


@query("smart_resize", oracle("""WITH r AS (SELECT id, CAST(bw AS DOUBLE) AS w, CAST(bh AS DOUBLE) AS h, greatest(28.0, round_even(bw / 28.0, 0) * 28) AS rw, greatest(28.0, round_even(bh / 28.0, 0) * 28) AS rh FROM fx_annotations)
SELECT id, CAST(CASE WHEN rw * rh > 50000 THEN greatest(28, floor(w / sqrt(w * h / 50000) / 28) * 28) WHEN rw * rh < 3136 THEN ceil(w * sqrt(3136 / (w * h)) / 28) * 28 ELSE rw END AS BIGINT) AS w,
 CAST(CASE WHEN rw * rh > 50000 THEN greatest(28, floor(h / sqrt(w * h / 50000) / 28) * 28) WHEN rw * rh < 3136 THEN ceil(h * sqrt(3136 / (w * h)) / 28) * 28 ELSE rh END AS BIGINT) AS h FROM r"""))
def smart_resize(spark, d):
    s = G.smart_resize(F.col("bw").cast("double"), F.col("bh").cast("double"), most=50_000)
    return view(spark, d, "fx_annotations").select("id", s.alias("s")).select("id", "s.w", "s.h")


@query("display_size", oracle("SELECT id, greatest(1, CAST(trunc(bw * 9 * least(1.0, 1024.0 / greatest(bw * 9, bh * 9))) AS BIGINT)) AS w, greatest(1, CAST(trunc(bh * 9 * least(1.0, 1024.0 / greatest(bw * 9, bh * 9))) AS BIGINT)) AS h FROM (SELECT id, CAST(bw AS DOUBLE) AS bw, CAST(bh AS DOUBLE) AS bh FROM fx_annotations) a"))
def display_size(spark, d):
    s = G.display_size(F.col("bw") * 9.0, F.col("bh") * 9.0)
    return view(spark, d, "fx_annotations").select("id", s.alias("s")).select("id", "s.w", "s.h")


@query("view_chain_map", oracle("WITH RECURSIVE z AS (SELECT traj_id, step, x1, y1, x2, y2, row_number() OVER (PARTITION BY traj_id ORDER BY step) AS k FROM fx_calls WHERE tool_name = 'zoom'), m AS (SELECT traj_id, step, k AS k0, k, x1, y1, x2, y2 FROM z UNION ALL SELECT m.traj_id, m.step, k0, z.k, z.x1 + m.x1 * (z.x2 - z.x1), z.y1 + m.y1 * (z.y2 - z.y1), z.x1 + m.x2 * (z.x2 - z.x1), z.y1 + m.y2 * (z.y2 - z.y1) FROM m JOIN z ON z.traj_id = m.traj_id AND z.k = m.k - 1) SELECT traj_id, step, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM m WHERE k = 1").replace("WITH fx_calls", "WITH RECURSIVE fx_calls").replace(", RECURSIVE z", ", z"))
def view_chain_map(spark, d):
    """Each zoom's box through the zooms before it, back to the whole image."""
    z = view(spark, d, "fx_calls").where("tool_name = 'zoom'").withColumn("box", F.array("x1", "y1", "x2", "y2"))
    t = z.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("step", "box"))).alias("z"))
    each = t.select("traj_id", "z", F.posexplode("z").alias("i", "c"))
    m = G.view_chain_map(F.col("c.box"), F.transform(F.slice("z", F.lit(1), F.col("i")), lambda v: v["box"]))
    return each.select("traj_id", F.col("c.step").alias("step"), *[F.round(m[i], 6).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])

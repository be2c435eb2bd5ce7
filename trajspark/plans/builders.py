"""Queries on training-table builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table, trajectories, view
from ..functions import geometry as G
from ..functions import scorers as S
from ..functions import text as X
from ..operators import batching as B
from ..operators import builders as U
from ..registry import query
from .geometry import _CLAMP


@query("build_rl_mcq", oracle("WITH r AS (SELECT id, test_type, round(CAST(x AS DOUBLE) / w, 6) AS x1, row_number() OVER (ORDER BY md5(concat('42-', id)), id) AS r FROM fx_annotations) SELECT id, test_type, x1, CASE WHEN r <= 20 THEN 'val' ELSE 'train' END AS split FROM r"))
def build_rl_mcq(spark, d):
    """Annotations as prompt rows, normalised first box, the first 20 in hash order as val."""
    a = view(spark, d, "fx_annotations").withColumn("box", G.norm_box(G.xywh_to_xyxy(F.array("x", "y", "bw", "bh")), F.col("w"), F.col("h")))
    p = U.rl_prompt(a, "annotations", "mcq", F.concat(F.lit("Which part is at "), F.array_join(F.col("box").cast("array<string>"), ", "), F.lit("?")), F.lit("A"), {"id": F.col("id"), "test_type": F.col("test_type"), "gt_bbox": F.col("box")})
    flat = p.select(F.col("extra_info.id").alias("id"), F.col("extra_info.test_type").alias("test_type"), F.round(F.col("extra_info.gt_bbox")[0], 6).alias("x1"))
    return B.split_first(flat, 20, B.seeded(42, "id"), F.col("id"))


@query("build_rl_math", oracle("SELECT id, concat(response, ' Think step by step.') AS prompt, regexp_extract(response, '#### ([0-9]+)', 1) AS ground_truth FROM fx_numeric"))
def build_rl_math(spark, d):
    n = view(spark, d, "fx_numeric")
    p = U.rl_prompt(n, "gsm8k", "math", F.concat(F.col("response"), F.lit(" Think step by step.")), S.gsm8k_strict(F.col("response")), {"id": F.col("id")})
    return p.select(F.col("extra_info.id").alias("id"), F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("ground_truth"))


@query("build_rl_boxed", oracle("SELECT id, ground_truth FROM fx_numeric"))
def build_rl_boxed(spark, d):
    n = view(spark, d, "fx_numeric")
    p = U.rl_prompt(n, "math", "math", F.col("response"), S.last_boxed(F.concat(F.col("response"), F.lit(" \\boxed{"), F.col("ground_truth"), F.lit("}."))), {"id": F.col("id")})
    return p.select(F.col("extra_info.id").alias("id"), F.col("reward_model.ground_truth").alias("ground_truth"))


@query("build_rl_image_math", oracle("SELECT id, concat('<image>', 'Find the area of ', test_type, '.') AS prompt, 1 AS images FROM fx_annotations"))
def build_rl_image_math(spark, d):
    a = view(spark, d, "fx_annotations")
    p = U.rl_prompt(a, "geometry", "math", F.concat(F.lit("<image>Find the area of "), F.col("test_type"), F.lit(".")), F.lit(""), {"id": F.col("id"), "images": F.array(F.concat(F.col("id").cast("string"), F.lit(".png")))})
    return p.select(F.col("extra_info.id").alias("id"), F.col("prompt")[0]["content"].alias("prompt"), F.size("extra_info.images").alias("images"))


@query("build_rl_choice", oracle("SELECT traj_id, concat(question, chr(10), 'it ends. fast', chr(10), 'B') AS prompt, traj_id % 2 AS gold FROM fx_traj WHERE status <> 'error'"))
def build_rl_choice(spark, d):
    """Context with cleaned endings; rows without a label are dropped first."""
    t = view(spark, d, "fx_traj").where("status <> 'error'")
    endings = F.transform(F.array(F.lit("it ends [title] fast[x]"), F.lit(" B ")), X.wikihow_clean)
    fixed = F.transform(endings, lambda e: F.replace(e, F.lit(".  "), F.lit(". ")))
    return t.select("traj_id", F.concat_ws("\n", F.col("question"), F.array_join(fixed, "\n")).alias("prompt"), (F.col("traj_id") % 2).alias("gold"))


@query("build_pref_sft", oracle("SELECT id, 0 AS rank, prompt, md5(chosen) AS response FROM fx_pairs UNION ALL SELECT id, 1, prompt, md5(rejected) FROM fx_pairs"))
def build_pref_sft(spark, d):
    return U.pref_sft(view(spark, d, "fx_pairs")).withColumn("response", F.md5("response"))


@query("build_pref_rm", oracle("SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= floor(count(*) OVER () * 0.75) THEN 'train' ELSE 'test' END AS split FROM fx_pairs"))
def build_pref_rm(spark, d):
    return U.pref_rm(view(spark, d, "fx_pairs").select("id", "prompt"), "id").select("id", "split")


@query("build_pref_rl", oracle("SELECT id, prompt, 'model' AS style, md5(chosen) AS response FROM fx_pairs"))
def build_pref_rl(spark, d):
    p = view(spark, d, "fx_pairs")
    r = U.rl_prompt(p, "pairs", "alignment", F.col("prompt"), F.md5("chosen"), {"id": F.col("id")}, style="model")
    return r.select(F.col("extra_info.id").alias("id"), F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.style").alias("style"), F.col("reward_model.ground_truth").alias("response"))


@query("build_multiturn", "SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first_role, md5(string_agg(text, '|' ORDER BY turn)) AS body, CASE WHEN conv_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM conversations GROUP BY 1")
def build_multiturn(spark, d):
    c = U.conversations(table(spark, d, "conversations"))
    split = F.when(F.col("conv_id") % 10 == 0, "test").otherwise("train")
    body = F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|"))
    return c.select("conv_id", F.size("messages").cast("long").alias("n"), F.col("messages")[0]["role"].alias("first_role"), body.alias("body"), split.alias("split"))


@query("build_rl_hint", oracle("SELECT traj_id, concat('<image> 1690x1500. ', question) AS prompt, concat('img/', traj_id, '.jpg') AS hint FROM fx_traj"))
def build_rl_hint(spark, d):
    t = view(spark, d, "fx_traj")
    template = F.replace(F.lit("<image> {w}x{h}. {q}"), F.lit("{w}x{h}"), F.lit("1690x1500"))
    return t.select("traj_id", F.replace(template, F.lit("{q}"), F.col("question")).alias("prompt"), F.concat(F.lit("img/"), F.col("traj_id"), F.lit(".jpg")).alias("hint"))


@query("build_rl_no_hint", oracle("SELECT traj_id, concat('[image 1690x1500] ', question) AS prompt FROM fx_traj"))
def build_rl_no_hint(spark, d):
    return view(spark, d, "fx_traj").select("traj_id", F.concat(F.lit("[image 1690x1500] "), F.col("question")).alias("prompt"))


@query("build_search_train", oracle("WITH r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY stage, ordinal) AS r FROM fx_stage) SELECT ordinal, stage, md5(question) AS question, answer AS ground_truth FROM r WHERE r = 1"))
def build_search_train(spark, d):
    t = U.search_train(view(spark, d, "fx_stage"), "Search, then answer.")
    return t.select("ordinal", "stage", F.md5(F.col("prompt")[1]["content"]).alias("question"), "ground_truth")


@query("build_search_test", "SELECT 'documents' AS src_file, source AS answer, count(*) AS n FROM documents GROUP BY 2")
def build_search_test(spark, d):
    """No dedupe; each row keeps the file that it came from."""
    t = table(spark, d, "documents").select("source", F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]+)\.parquet(?:/[^/]*)?$", 1).alias("src_file"))
    return t.groupBy("src_file", F.col("source").alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("build_tool_subset", oracle("WITH s AS (SELECT traj_id, uid, question FROM fx_traj WHERE ability IN ('q1', 'q2', 'q3') AND has_image ORDER BY md5(concat('42-', traj_id)), traj_id LIMIT 200), v AS (SELECT s.*, m.delta_s, row_number() OVER (ORDER BY traj_id DESC) AS r FROM s LEFT JOIN fx_score_map m ON s.uid = m.uid) SELECT traj_id, concat(question, ' Use tools.') AS prompt, coalesce(delta_s, 1.0) AS delta_s, CASE WHEN r <= 20 THEN 'val' ELSE 'train' END AS split FROM v"))
def build_tool_subset(spark, d):
    """Filter, sample, join scores, build the prompt, the last 20 are val."""
    t = view(spark, d, "fx_traj").where(F.col("ability").isin("q1", "q2", "q3") & F.col("has_image"))
    s = B.sample_k(t, 200, 42, "traj_id").join(view(spark, d, "fx_score_map"), "uid", "left")
    p = s.select("traj_id", F.concat("question", F.lit(" Use tools.")).alias("prompt"), F.coalesce("delta_s", F.lit(1.0)).alias("delta_s"))
    return B.split_first(p, 20, F.col("traj_id").desc())


@query("build_sft_messages", oracle("SELECT t.traj_id, CAST(3 + 2 * count(c.step) AS BIGINT) AS n, concat('<answer>', max(pred), '</answer>') AS last FROM fx_traj t LEFT JOIN fx_calls c ON t.traj_id = c.traj_id GROUP BY 1"))
def build_sft_messages(spark, d):
    m = U.sft_messages(trajectories(spark, d), "Use tools.")
    return m.select("traj_id", F.size("messages").cast("long").alias("n"), F.element_at("messages", -1)["parts"][0]["text"].alias("last"))


@query("build_sft_split", oracle("WITH r AS (SELECT traj_id, data_source, row_number() OVER (ORDER BY md5(concat('5-', traj_id)), traj_id) AS r, count(*) OVER () AS n FROM fx_traj) SELECT data_source, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM r GROUP BY 1, 2"))
def build_sft_split(spark, d):
    t = U.sft_split(view(spark, d, "fx_traj").select("traj_id", "data_source"), "traj_id", 5)
    return t.groupBy("data_source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("build_crop_index", oracle(f"WITH {_CLAMP} SELECT id, concat(test_type, '/', id, '_0.jpg') AS crop_path, cx2 - cx1 AS crop_w, cy2 - cy1 AS crop_h FROM cl WHERE cx2 > cx1 AND cy2 > cy1"))
def build_crop_index(spark, d):
    """One row for each box that is not empty after clamping."""
    a = view(spark, d, "fx_annotations").select("id", "test_type", "w", "h", F.posexplode(F.array(F.array("x", "y", "bw", "bh"))).alias("k", "xywh"))
    a = a.withColumn("box", G.clamp_box(G.xywh_to_xyxy(F.col("xywh")), F.col("w"), F.col("h"))).where(~G.empty_box(F.col("box")))
    path = F.concat(F.col("test_type"), F.lit("/"), F.col("id"), F.lit("_"), F.col("k"), F.lit(".jpg"))
    return a.select("id", path.alias("crop_path"), (F.col("box")[2] - F.col("box")[0]).alias("crop_w"), (F.col("box")[3] - F.col("box")[1]).alias("crop_h"))


@query("pivot_samples", oracle("SELECT uid, list(pred ORDER BY traj_id) AS responses FROM fx_traj GROUP BY 1"))
def pivot_samples(spark, d):
    return U.pivot_samples(view(spark, d, "fx_traj"), "uid", "traj_id", "pred")

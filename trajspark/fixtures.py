"""The test views of FIXTURES.md: one SQL text each for Spark and DuckDB, and the nested trajectory table built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels"]

VIEWS = {
    "fx_calls": """
SELECT traj_id, CAST(step AS BIGINT) AS step,
  CASE k % 6 WHEN 0 THEN 'crop' WHEN 1 THEN 'zoom' WHEN 2 THEN 'ocr' WHEN 3 THEN 'rotate' WHEN 4 THEN 'zoom_in' ELSE 'select' END AS raw_tool,
  CASE k % 6 WHEN 0 THEN 'crop' WHEN 1 THEN 'zoom' WHEN 2 THEN 'ocr' WHEN 3 THEN 'rotate' WHEN 4 THEN 'zoom' ELSE 'select' END AS tool_name,
  CASE WHEN k % 6 IN (0,1,2,4) THEN CAST(s % 32 AS DOUBLE)/64 END AS x1,
  CASE WHEN k % 6 IN (0,1,2,4) THEN CAST(k % 32 AS DOUBLE)/64 END AS y1,
  CASE WHEN k % 6 IN (0,1,2,4) THEN CAST(s % 32 + 1 + q % 32 AS DOUBLE)/64 END AS x2,
  CASE WHEN k % 6 IN (0,1,2,4) THEN CAST(k % 32 + 1 + (q * 7) % 32 AS DOUBLE)/64 END AS y2,
  CASE k % 6 WHEN 2 THEN concat('[OCR result: "', CAST(q AS VARCHAR(20)), ' mm ', f, '"]')
             WHEN 3 THEN '[Rotated by 90 degrees]' WHEN 5 THEN '[Unknown tool: select]'
             ELSE concat('[Zoomed into region ', g, ' ', CAST(s AS VARCHAR(20)), ']') END AS output
FROM (SELECT l_orderkey AS traj_id, l_partkey AS k, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f, l_linestatus AS g,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS step
      FROM lineitem) t
""",
    "fx_traj": """
SELECT o_orderkey AS traj_id, o_custkey AS uid, o_orderpriority AS data_source, concat('q', CAST(o_custkey % 7 AS VARCHAR(20))) AS ability,
  CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'EXCEED_MAX_TURNS' ELSE 'OVER_LENGTH' END AS end_reason,
  CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'success' ELSE 'max_turns_exceeded' END AS status,
  CASE WHEN (o_custkey % 10 = 0) THEN CAST(0 AS DOUBLE) WHEN (o_custkey % 10 = 1) THEN CAST(1 AS DOUBLE)
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 2 AS DOUBLE) END AS accuracy,
  CASE CAST(floor(o_totalprice) AS BIGINT) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS pred,
  CAST(floor(o_totalprice) AS BIGINT) % 160000 AS trajlength, o_orderkey % 5 <> 0 AS has_image,
  o_orderkey % 13 <> 0 AS vision_consistent, CAST(month(o_orderdate) AS BIGINT) AS step,
  CASE o_custkey % 3 WHEN 0 THEN 'How many mm wide is region O?' WHEN 1 THEN 'What color is the flag?' ELSE 'Where is the text located?' END AS question
FROM orders
""",
    "fx_gt": """
SELECT o_orderkey AS traj_id, CAST(b.i AS BIGINT) AS box_idx,
  CAST((o_custkey + b.i * 5) % 32 AS DOUBLE)/64 AS x1, CAST((o_orderkey + b.i * 3) % 32 AS DOUBLE)/64 AS y1,
  CAST((o_custkey + b.i * 5) % 32 + 12 AS DOUBLE)/64 AS x2, CAST((o_orderkey + b.i * 3) % 32 + 12 AS DOUBLE)/64 AS y2
FROM orders CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i) b
WHERE b.i = 0 OR o_custkey % 2 = 0
""",
    "fx_tokens": """
SELECT user_id AS traj_id, user_id % 30 AS uid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
  CASE WHEN event_type = 'view' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS mask,
  CASE WHEN event_type = 'purchase' THEN floor(value)/64 ELSE CAST(0 AS DOUBLE) END AS reward,
  floor(value)/128 AS value_pred,
  -floor(value)/64 AS old_logp, -CAST(event_id % 64 AS DOUBLE)/64 AS ref_logp, -(floor(value) + CAST(event_id % 3 AS DOUBLE) - 1)/64 AS logp
FROM events
""",
    "fx_turns": """
SELECT user_id AS traj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS turn, ts,
  event_type = 'error' AS is_error, event_type = 'purchase' AS done, CAST(floor(value) AS BIGINT) AS n_tokens,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS n_images
FROM events
""",
    "fx_responses": """
SELECT conv_id, turn, concat(
  '<tool_call>', chr(10), '{"name": "', CASE turn % 3 WHEN 0 THEN 'zoom_in' WHEN 1 THEN 'crop' ELSE 'mystery' END,
  '", "arguments": {"bbox_2d": [0.125, 0.25, 0.5, 0.75], "label": "c', CAST(conv_id AS VARCHAR(20)), '"}}', chr(10), '</tool_call>', chr(10),
  text, chr(10),
  CASE WHEN conv_id % 4 = 0 THEN concat('<tool_call>', chr(10), '{"name": broken', chr(10), '</tool_call>', chr(10)) ELSE '' END,
  CASE WHEN conv_id % 9 = 8 THEN '' ELSE concat('<answer> ', CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'the flag is red.' END, ' </answer>') END) AS response,
  'The flag is red.' AS ground_truth
FROM conversations WHERE role = 'assistant'
""",
    "fx_numeric": """
SELECT o_orderkey AS id, o_orderpriority AS data_source,
  concat('work ', CAST(o_custkey AS VARCHAR(20)), ' then #### ', CAST(CAST(floor(o_totalprice) AS BIGINT) % 50 AS VARCHAR(20))) AS response,
  CAST(o_custkey % 50 AS VARCHAR(20)) AS ground_truth
FROM orders
""",
    "fx_annotations": """
SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'direct_attributes' ELSE 'relative_position' END AS test_type,
  1690 AS w, 1500 AS h, CAST(p_partkey * 37 % 1900 - 50 AS BIGINT) AS x, CAST(p_partkey * 53 % 1700 - 50 AS BIGINT) AS y,
  CAST(p_size * 9 AS BIGINT) AS bw, CAST(p_size * 7 AS BIGINT) AS bh
FROM part
""",
    "fx_eval": """
SELECT o_orderkey AS id, o_orderpriority AS test_type, CASE WHEN o_custkey % 2 = 0 THEN 'single' ELSE 'cross' END AS category, 'A. red flag' AS answer,
  CASE CAST(floor(o_totalprice) AS BIGINT) % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'A.' WHEN 3 THEN 'it is A. red flag indeed' ELSE 'ERROR' END AS pred_ans
FROM orders
""",
    "fx_stage": """
SELECT doc_id AS ordinal, CASE WHEN doc_id % 2 = 0 THEN 'stage1' ELSE 'stage2' END AS stage, text AS question, source AS answer FROM documents
""",
    "fx_pairs": """
SELECT a.doc_id AS id, a.lang AS prompt, a.text AS chosen, b.text AS rejected
FROM (SELECT d.doc_id, d.lang, d.text, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1) a
JOIN (SELECT d.lang, d.text, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0) b
ON a.lang = b.lang AND a.r = b.r
""",
    "fx_score_map": """
SELECT c_custkey AS uid, CAST(c_custkey % 3 AS DOUBLE) - 1 AS delta_s FROM customer WHERE c_custkey % 4 <> 0
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of sf_dir."""
    if name == "fx_pairs":
        return pairs(spark, sf_dir)
    text = VIEWS[name]
    for t in TABLES:
        if t in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_pairs with its rows numbered by key alone: the view's windows take a language's texts through one task. A text comes back by
    its doc_id and hash, dealt to four tasks for each split of the files: what one task reads does not grow with the input."""
    source = table(spark, sf_dir, "documents")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * source.rdd.getNumPartitions())
    docs = source.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    good = table(spark, sf_dir, "labels").select("doc_id", "quality")
    at = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    rows = docs.select("doc_id", "lang", "h").hint("merge").join(good.hint("merge"), "doc_id")
    side = lambda q, p: rows.where(F.col("quality") == q).select("lang", at.alias("r"), F.col("doc_id").alias(f"{p}_doc"), F.col("h").alias(f"{p}_h"))
    met = side(1, "a").hint("merge").join(side(0, "b").hint("merge"), ["lang", "r"])
    texts = docs.select("doc_id", "h", "text").repartition(tasks, "doc_id", "h").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    text = lambda p, name: texts.select(F.col("doc_id").alias(f"{p}_doc"), F.col("h").alias(f"{p}_h"), F.col("text").alias(name))
    found = met.join(text("a", "chosen").hint("merge"), ["a_doc", "a_h"]).join(text("b", "rejected").hint("merge"), ["b_doc", "b_h"])
    return found.select(F.col("a_doc").alias("id"), F.col("lang").alias("prompt"), "chosen", "rejected")


def oracle(sql: str) -> str:
    """sql for DuckDB with the views that it names as common table expressions."""
    used = [n for n in VIEWS if n in sql]
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + (", " + sql[5:] if sql.lstrip().startswith("WITH ") else " " + sql)) if used else sql


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_traj with tool_calls (ordered array of structs) and gt_box (the first ground-truth box): the canonical layout."""
    c = view(spark, sf_dir, "fx_calls")
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    call = F.struct("step", F.col("raw_tool").alias("raw_name"), "tool_name", box.alias("bbox"), "output")
    calls = c.groupBy("traj_id").agg(F.sort_array(F.collect_list(call)).alias("tool_calls"))
    gt = view(spark, sf_dir, "fx_gt").where("box_idx = 0").select("traj_id", F.array("x1", "y1", "x2", "y2").alias("gt_box"))
    # by key: broadcasting a side would leave the scores to as many tasks as orders has file splits
    t = view(spark, sf_dir, "fx_traj").hint("merge").join(calls.hint("merge"), "traj_id", "left").join(gt.hint("merge"), "traj_id", "left")
    return t.withColumn("tool_calls", F.coalesce("tool_calls", F.expr("cast(array() as array<struct<step:bigint,raw_name:string,tool_name:string,bbox:array<double>,output:string>>)")))

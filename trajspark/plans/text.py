"""Queries on parsing and text building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table, view
from ..functions import scorers as S
from ..functions import text as X
from ..registry import query

_BLOCKS = """bl AS (SELECT conv_id, turn, response, regexp_extract_all(response, '(?s)<tool_call>\\s*(\\{.*?\\})\\s*</tool_call>', 1) AS b FROM fx_responses),
ca AS (SELECT conv_id, turn, i, b[i] AS j FROM bl, range(1, 9) t(i) WHERE i <= len(b) AND json_valid(b[i])),
pc AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS step, json_extract_string(j, '$.name') AS raw_name,
 CASE json_extract_string(j, '$.name') WHEN 'zoom_in' THEN 'zoom' ELSE json_extract_string(j, '$.name') END AS tool_name, json_extract_string(j, '$.arguments.label') AS label FROM ca)"""


def calls(spark, d):
    r = X.parse_responses(view(spark, d, "fx_responses"))
    return r.select("conv_id", "turn", F.posexplode("calls").alias("step", "c"))


@query("parse_tool_calls", oracle(f"WITH {_BLOCKS} SELECT conv_id, turn, step, raw_name, tool_name, label FROM pc"))
def parse_tool_calls(spark, d):
    return calls(spark, d).select("conv_id", "turn", F.col("step").cast("long").alias("step"), "c.raw_name", "c.tool_name", "c.label")


@query("udtf_parse", oracle(f"WITH {_BLOCKS} SELECT tool_name, count(*) AS n FROM pc GROUP BY 1"))
def udtf_parse(spark, d):
    """The SQL generator form: one row a call with inline()."""
    r = view(spark, d, "fx_responses").withColumn("calls", X.parse_tool_calls(F.col("response")))
    return r.selectExpr("conv_id", "inline(calls)").groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"))


@query("attach_outputs", oracle("WITH o AS (SELECT conv_id, turn, regexp_split_to_array(response, '(?s)<tool_call>.*?</tool_call>') AS parts FROM fx_responses) SELECT conv_id, turn, trim(replace(parts[len(parts)], chr(10), ' ')) AS output FROM o"))
def attach_outputs(spark, d):
    """The output of the only call that can be read: all text after the last block, be that broken or not."""
    r = view(spark, d, "fx_responses").withColumn("c", X.parse_tool_calls(F.col("response"))[0])
    return r.select("conv_id", "turn", F.trim(F.replace("c.output", F.lit("\n"), F.lit(" "))).alias("output"))


@query("job_parse_responses", oracle(f"WITH {_BLOCKS}, n AS (SELECT conv_id, turn, count(*) AS n FROM pc GROUP BY 1, 2) SELECT r.conv_id % 10 AS source, count(*) AS responses, CAST(sum(coalesce(n, 0)) AS BIGINT) AS calls, CAST(sum(len(regexp_extract_all(r.response, '(?s)<tool_call>.*?</tool_call>')) - coalesce(n, 0)) AS BIGINT) AS unparsed, count(*) FILTER (WHERE regexp_matches(r.response, '<answer>')) AS answered FROM fx_responses r LEFT JOIN n ON r.conv_id = n.conv_id AND r.turn = n.turn GROUP BY 1"))
def job_parse_responses(spark, d):
    r = X.parse_responses(view(spark, d, "fx_responses")).withColumn("answer", S.answer_tag(F.col("response")))
    return r.groupBy((F.col("conv_id") % 10).alias("source")).agg(F.count(F.lit(1)).alias("responses"), F.sum(F.size("calls")).cast("long").alias("calls"), F.sum("n_unparsed").cast("long").alias("unparsed"), F.count("answer").alias("answered"))


@query("parse_first_call", oracle(f"WITH {_BLOCKS}, f AS (SELECT conv_id, turn, arg_min(raw_name, step) AS name FROM pc GROUP BY 1, 2) SELECT r.conv_id, r.turn, name FROM fx_responses r LEFT JOIN f ON r.conv_id = f.conv_id AND r.turn = f.turn"))
def parse_first_call(spark, d):
    return view(spark, d, "fx_responses").select("conv_id", "turn", X.parse_first_call(F.col("response"))["name"].alias("name"))


_TAG = "nullif(regexp_extract(response, '(?s)<answer>\\s*(.*?)\\s*</answer>', 1), '')"


@query("extract_answer_tag", oracle(f"SELECT conv_id, turn, {_TAG} AS answer FROM fx_responses"))
def extract_answer_tag(spark, d):
    return view(spark, d, "fx_responses").select("conv_id", "turn", S.answer_tag(F.col("response")).alias("answer"))


@query("extract_answer_or_text", oracle(f"SELECT conv_id, turn, length(coalesce({_TAG}, response)) AS n FROM fx_responses"))
def extract_answer_or_text(spark, d):
    return view(spark, d, "fx_responses").select("conv_id", "turn", F.length(S.answer_or_text(F.col("response"))).cast("long").alias("n"))


@query("extract_letter", oracle(f"SELECT conv_id, turn, CASE WHEN regexp_matches(upper({_TAG}), '^[A-E]$') THEN upper({_TAG}) ELSE nullif(regexp_extract(response, '\\b([A-E])\\b', 1), '') END AS letter FROM fx_responses"))
def extract_letter(spark, d):
    return view(spark, d, "fx_responses").select("conv_id", "turn", S.letter(F.col("response")).alias("letter"))


@query("extract_boxed_answer", "SELECT doc_id, concat('x', CAST(doc_id % 17 AS VARCHAR)) AS answer FROM documents")
def extract_boxed_answer(spark, d):
    t = table(spark, d, "documents")
    text = F.concat(F.lit("<answer>\n\\boxed{x"), (F.col("doc_id") % 17).cast("string"), F.lit("}\n</answer>"))
    return t.select("doc_id", X.boxed_answer(F.concat("text", text)).alias("answer"))


@query("canonical_tool", oracle("SELECT raw_tool, CASE raw_tool WHEN 'zoom_in' THEN 'zoom' WHEN 'select' THEN NULL ELSE raw_tool END AS tool, count(*) AS n FROM fx_calls GROUP BY 1, 2"))
def canonical_tool(spark, d):
    c = view(spark, d, "fx_calls").withColumn("tool", X.canonical_tool(F.col("raw_tool")))
    return c.groupBy("raw_tool", "tool").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_args", oracle("SELECT traj_id, step, CAST(x1 AS VARCHAR) AS bbox_2d FROM fx_calls WHERE x1 IS NOT NULL"))
def normalize_args(spark, d):
    args = F.create_map(F.lit("bbox"), F.col("x1").cast("string"), F.lit("mode"), F.lit("fast"))
    c = view(spark, d, "fx_calls").where("x1 is not null")
    return c.select("traj_id", "step", X.normalize_args(args, {"bbox": "bbox_2d"}, ["bbox_2d"])["bbox_2d"].alias("bbox_2d"))


_MEDIA = "md AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('<image>', text, '<video>') WHEN 1 THEN concat(text, '<image> and <image>') ELSE text END AS t FROM documents)"


def _media(spark, d):
    s = F.col("text")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<image>"), s, F.lit("<video>"))).when(F.col("doc_id") % 3 == 1, F.concat(s, F.lit("<image> and <image>"))).otherwise(s)
    return table(spark, d, "documents").select("doc_id", t.alias("t"))


@query("split_media", f"WITH {_MEDIA} SELECT doc_id, len(regexp_extract_all(t, '<image>')) AS images, len(regexp_extract_all(t, '<video>')) AS videos FROM md")
def split_media(spark, d):
    parts = X.split_media(F.col("t"))
    n = lambda k: F.size(F.filter(parts, lambda p: p["type"] == k)).cast("long")
    return _media(spark, d).select("doc_id", n("image").alias("images"), n("video").alias("videos"))


@query("split_media_clues", f"WITH {_MEDIA} SELECT doc_id, 3 * len(regexp_extract_all(t, '<image>')) AS marks, len(regexp_extract_all(t, '<video>')) AS video_texts FROM md")
def split_media_clues(spark, d):
    parts = X.split_media_clues(F.col("t"))
    marks = F.size(F.filter(parts, lambda p: (p["type"] == "image") | p["text"].contains("image_clue_0")))
    videos = F.size(F.filter(parts, lambda p: (p["type"] == "text") & (p["text"] == "<video>")))
    return _media(spark, d).select("doc_id", marks.cast("long").alias("marks"), videos.cast("long").alias("video_texts"))


@query("media_token_check", f"WITH {_MEDIA} SELECT doc_id, len(regexp_extract_all(t, '<image>')) = 1 AS ok FROM md")
def media_token_check(spark, d):
    return _media(spark, d).select("doc_id", X.media_token_check(F.col("t"), F.array(F.lit("one.png"))).alias("ok"))


@query("user_prompt", oracle("SELECT traj_id, concat('Question: ', question, chr(10), 'A. red', chr(10), 'B. ', pred, chr(10), 'Answer with a letter.') AS prompt FROM fx_traj"))
def user_prompt(spark, d):
    return view(spark, d, "fx_traj").select("traj_id", X.user_prompt(F.col("question"), F.array(F.lit("red"), F.col("pred")), "Answer with a letter.").alias("prompt"))


_BOX = '{"type": "array", "items": {"type": "number"}, "minItems": 4, "maxItems": 4, '
_PROMPT = f"""WITH s(i, name, about, param, kind, meaning, required) AS (VALUES
  (1, 'crop', 'Crop a region of the image to examine details.', 'bbox_2d', '{_BOX}', 'The region as NORMALIZED [x1, y1, x2, y2]: each value in [0,1], 0,0 = top-left corner of the image, 1,1 = bottom-right.', '"bbox_2d"'),
  (2, 'zoom', 'Zoom into a region to see fine details.', 'bbox_2d', '{_BOX}', 'The region to zoom into as NORMALIZED [x1, y1, x2, y2]: each value in [0,1], 0,0 = top-left, 1,1 = bottom-right.', '"bbox_2d"'),
  (3, 'rotate', 'Rotate the image by a specified angle.', 'angle', '{{"type": "integer", ', 'Rotation angle in degrees (e.g., 90, 180, 270). Positive values rotate counter-clockwise.', '"angle"'),
  (4, 'ocr', 'Extract text from a region of the image.', 'bbox_2d', '{_BOX}', 'The region to read as NORMALIZED [x1, y1, x2, y2]: each value in [0,1], 0,0 = top-left, 1,1 = bottom-right. Omit to OCR the whole image.', '')),
lines AS (SELECT string_agg('{{"type": "function", "function": {{"name": "' || name || '", "description": "' || about || '", "parameters": {{"type": "object", "properties": {{"' || param || '": ' || kind || '"description": "' || meaning || '"}}}}, "required": [' || required || ']}}}}}}', chr(10) ORDER BY i) AS tools FROM s)
SELECT traj_id, length(p) AS characters, sha256(p) AS digest, len(regexp_extract_all(p, '"type": "function"')) AS tools FROM (
SELECT traj_id, 'You are a helpful assistant.

# Tools
You may call one or more functions to assist with the user query.
You are provided with function signatures within <tools></tools> XML tags:
<tools>
' || tools || '
</tools>

# How to call a tool
Return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{{"name": <function-name>, "arguments": <args-json-object>}}
</tool_call>

# Coordinate system (IMPORTANT)
All bbox_2d values MUST be NORMALIZED coordinates: each value is a fraction
of the image size in [0, 1], where (0,0) = top-left corner and (1,1) = bottom-right
corner of the image you are currently viewing. Do NOT use pixel values.
Your coordinates are scaled automatically by the tool executor.

# Answer policy (IMPORTANT)
' || CASE WHEN has_image THEN '1. BEFORE answering, you MUST call a tool to verify the target object:
   zoom into the relevant region (or crop it) and inspect the returned image.
2. Call ONE tool per turn; you may call several tools in sequence.
' ELSE '1. FIRST, answer directly from the full image: <answer>your answer</answer>
2. ONLY if you cannot determine the answer from the full image
   (object too small, text unreadable, details unclear) may you call a tool
   to inspect. Call ONE tool per turn, inspect the returned image, then answer.
' END || '3. After inspecting tool results, give your final answer in <answer> tags.

Tools available:
<tool_call>
{{"name": "zoom", "arguments": {{"bbox_2d": [0.15, 0.25, 0.28, 0.38]}}}}
</tool_call>
Use ocr to read text, rotate only if the image orientation is wrong.

When you have enough evidence, provide your answer inside <answer> tags:
<answer>your answer</answer>' AS p FROM fx_traj, lines)"""


@query("system_prompt", oracle(_PROMPT))
def system_prompt(spark, d):
    """The prompt of every trajectory: tools first where it has an image, else the answer first; compared by digest."""
    mode = F.when(F.col("has_image"), "tool_first").otherwise("answer_first")
    t = view(spark, d, "fx_traj").select("traj_id", X.system_prompt(["crop", "zoom", "rotate", "ocr"], mode).alias("p"))
    tools = F.regexp_count("p", F.lit('"type": "function"')).cast("long")
    return t.select("traj_id", F.length("p").cast("long").alias("characters"), F.sha2("p", 256).alias("digest"), tools.alias("tools"))


@query("build_question", oracle("SELECT traj_id, concat(question, chr(10), 'x', chr(10), pred, chr(10), 'Think first.', CASE ability WHEN 'q1' THEN ' Give a number.' ELSE '' END) AS question FROM fx_traj"))
def build_question(spark, d):
    q = X.build_question(F.col("question"), F.array(F.lit("x"), F.col("pred")), "Think first.", {"q1": " Give a number."}, F.col("ability"))
    return view(spark, d, "fx_traj").select("traj_id", q.alias("question"))


@query("rebuild_call_text", oracle("SELECT id, round(CAST(x AS DOUBLE) / w, 6) AS x1, round(CAST(y + bh AS DOUBLE) / h, 6) AS y2 FROM fx_annotations"))
def rebuild_call_text(spark, d):
    """The text is built, then parsed again."""
    a = view(spark, d, "fx_annotations")
    box = F.array(F.col("x"), F.col("y"), F.col("x") + F.col("bw"), F.col("y") + F.col("bh")).cast("array<double>")
    t = a.withColumn("t", X.rebuild_call_text(F.lit("crop"), box, F.col("w").cast("double"), F.col("h").cast("double")))
    b = X.parse_tool_calls(F.col("t"))[0]["bbox"]
    return t.select("id", b[0].alias("x1"), b[3].alias("y2"))


@query("tag_balance", oracle("SELECT conv_id, turn, len(regexp_extract_all(response, '<tool_call>')) = len(regexp_extract_all(response, '</tool_call>')) AND len(regexp_extract_all(response, '<answer>')) = len(regexp_extract_all(response, '</answer>')) AS ok FROM fx_responses"))
def tag_balance(spark, d):
    return view(spark, d, "fx_responses").select("conv_id", "turn", X.tag_balance(F.col("response")).alias("ok"))


@query("strip_system_block", oracle("SELECT traj_id, concat(question, ' ', pred) AS text FROM fx_traj"))
def strip_system_block(spark, d):
    t = F.concat(F.col("question"), F.lit("<system>be\nbrief</system> "), F.col("pred"))
    return view(spark, d, "fx_traj").select("traj_id", X.strip_system_block(t).alias("text"))


@query("wikihow_clean", oracle("SELECT traj_id, concat(question, '.  now', ' ', pred) AS text FROM fx_traj"))
def wikihow_clean(spark, d):
    t = F.concat(F.lit("  "), F.col("question"), F.lit(" [title]  now [step 3] "), F.col("pred"), F.lit(" "))
    return view(spark, d, "fx_traj").select("traj_id", X.wikihow_clean(t).alias("text"))


@query("job_build_messages", "SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def job_build_messages(spark, d):
    """Conversations as typed message arrays, in turn order."""
    t = table(spark, d, "conversations")
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    m = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("parts")))).alias("messages"))
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.col("messages.role").alias("roles"))


@query("gsm8k_extract", oracle("SELECT id, regexp_extract(response, '#### ([0-9]+)', 1) AS strict, regexp_extract(response, '#### ([0-9]+)', 1) AS flexible FROM fx_numeric"))
def gsm8k_extract(spark, d):
    return view(spark, d, "fx_numeric").select("id", S.gsm8k_strict(F.col("response")).alias("strict"), S.gsm8k_flexible(F.col("response")).alias("flexible"))


@query("last_boxed", oracle("SELECT id, concat('\\frac{a}{', ground_truth, '}') AS boxed FROM fx_numeric"))
def last_boxed(spark, d):
    t = F.concat(F.col("response"), F.lit(" so \\boxed{1} or \\boxed{\\frac{a}{"), F.col("ground_truth"), F.lit("}} end"))
    return view(spark, d, "fx_numeric").select("id", S.last_boxed(t).alias("boxed"))

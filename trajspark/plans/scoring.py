"""Queries on answer scorers and judge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import scorers as S
from ..registry import query

_TAG = "nullif(regexp_extract(response, '(?s)<answer>\\s*(.*?)\\s*</answer>', 1), '')"


def responses(spark, d):
    return view(spark, d, "fx_responses").withColumn("pred", F.coalesce(S.answer_tag(F.col("response")), F.lit("")))


@query("score_mcq_text", oracle(f"WITH p AS (SELECT conv_id, turn, coalesce({_TAG}, '') AS pred, lower(ground_truth) AS gt FROM fx_responses) SELECT conv_id, turn, CASE WHEN lower(pred) = gt OR contains(lower(pred), gt) OR pred = 'B' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM p"))
def score_mcq_text(spark, d):
    options = F.array(F.lit("It is blue."), F.col("ground_truth"), F.lit("Neither."))
    return responses(spark, d).select("conv_id", "turn", S.score_mcq_text(F.col("pred"), F.col("ground_truth"), options).alias("score"))


@query("score_choices", oracle("SELECT traj_id, CASE WHEN pred <> 'D' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM fx_traj"))
def score_choices(spark, d):
    return view(spark, d, "fx_traj").select("traj_id", S.score_choices(F.concat(F.col("pred"), F.lit(", C")), F.when(F.col("pred") == "A", "C,A").otherwise("B,C")).alias("score"))


@query("score_gsm8k", oracle("SELECT id, CASE WHEN regexp_extract(response, '#### ([0-9]+)', 1) = ground_truth THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM fx_numeric"))
def score_gsm8k(spark, d):
    return view(spark, d, "fx_numeric").select("id", S.score_gsm8k(F.col("response"), F.col("ground_truth"), form=0.1).alias("score"))


@query("parse_number", oracle("SELECT id, CAST(regexp_extract(response, '[0-9]+', 0) AS DOUBLE) AS value FROM fx_numeric"))
def parse_number(spark, d):
    return view(spark, d, "fx_numeric").select("id", S.parse_number(F.col("response")).alias("value"))


_NUM = "nm AS (SELECT id, CAST(regexp_extract(response, '#### ([0-9]+)', 1) AS DOUBLE) AS p, CAST(ground_truth AS DOUBLE) AS g FROM fx_numeric)"
_MRA = "CASE WHEN g = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE (" + " + ".join(f"CASE WHEN abs(p - g) / abs(g) < CAST({round(1 - t, 2)} AS DOUBLE) THEN 1 ELSE 0 END" for t in S.THETAS) + ") / 10.0 END"


def numbers(spark, d):
    n = view(spark, d, "fx_numeric")
    return n.withColumns({"p": S.gsm8k_strict(F.col("response")).cast("double"), "g": F.col("ground_truth").cast("double")})


@query("score_mra", oracle(f"WITH {_NUM} SELECT id, CAST({_MRA} AS DOUBLE) AS score FROM nm"))
def score_mra(spark, d):
    return numbers(spark, d).select("id", S.score_mra(F.col("p"), F.col("g")).alias("score"))


@query("score_rule", oracle(f"WITH {_NUM} SELECT id, CASE WHEN p = g OR {_MRA} >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM nm"))
def score_rule(spark, d):
    n = numbers(spark, d)
    return n.select("id", S.score_rule(S.gsm8k_strict(F.col("response")), F.col("ground_truth"), F.lit(True)).alias("score"))


@query("score_numeric_close", oracle(f"WITH {_NUM} SELECT id, CASE WHEN p = g OR abs(p - g * 100) <= 1e-4 * greatest(abs(p), abs(g * 100)) OR abs(p - g / 100) <= 1e-4 * greatest(abs(p), abs(g / 100)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM nm"))
def score_numeric_close(spark, d):
    n = view(spark, d, "fx_numeric")
    return n.select("id", S.score_numeric_close(S.gsm8k_strict(F.col("response")), F.col("ground_truth")).alias("score"))


_LISTS = """p AS (SELECT id, id % 7 AS k, ground_truth AS x, regexp_extract(response, '#### ([0-9]+)', 1) AS y FROM fx_numeric),
l AS (SELECT id, k, x, y,
  CASE WHEN k = 0 THEN concat('(', x, ', ', y, ')') WHEN k = 1 THEN concat('[', x, ', (', y, ', 1)]') WHEN k = 2 THEN concat('(', x, ', ', y, ')') WHEN k = 3 THEN concat(x, ', ', y)
    WHEN k = 4 THEN concat(chr(92), 'begin{pmatrix} ', x, ' & ', y, ' ', chr(92), chr(92), ' 1 & 2 ', chr(92), 'end{pmatrix}') WHEN k = 5 THEN concat('(', x, ', [', y, ', 2])') ELSE concat('(', x, ', ', y, ')') END AS pred,
  CASE WHEN k = 0 THEN concat('(', y, ', ', x, ')') WHEN k = 1 THEN concat('[ ', x, '.0 , ( ', y, ' , 1 ) ]') WHEN k = 2 THEN concat('[', x, ', ', y, ']') WHEN k = 3 THEN concat(x, ', ', y, ', 0')
    WHEN k = 4 THEN concat('[[', x, ', ', y, '.00], [1, 2]]') WHEN k = 5 THEN concat('(', x, ', [', x, ', 2])') ELSE concat('(', x, '00, ', y, ')') END AS gt FROM p)"""


@query("score_lists", oracle(f"WITH {_LISTS} SELECT id, pred, gt, CASE WHEN k IN (1, 4, 6) OR (k IN (0, 5) AND x = y) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM l"))
def score_lists(spark, d):
    """Tuples, nested lists, differing brackets and lengths, a matrix, and hundredfold elements, made of the table's numbers."""
    view(spark, d, "fx_numeric").createOrReplaceTempView("fx_numeric")
    lists = spark.sql(f"WITH {_LISTS} SELECT id, pred, gt FROM l")
    return lists.select("id", "pred", "gt", S.score_numeric_close(F.col("pred"), F.col("gt")).alias("score"))


_QA = "trim(regexp_replace(regexp_replace(regexp_replace(lower(replace({c}, '_', ' ')), '[^a-z0-9\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("qa_normalize", oracle(f"SELECT traj_id, {_QA.format(c='question')} AS text FROM fx_traj"))
def qa_normalize(spark, d):
    return view(spark, d, "fx_traj").select("traj_id", S.qa_normalize(F.col("question")).alias("text"))


@query(
    "qa_f1",
    oracle(f"""WITH n AS (SELECT traj_id, step, {_QA.format(c='output')} AS p, {_QA.format(c="'the region O is mm mm'")} AS g FROM fx_calls),
pt AS (SELECT traj_id, step, w, count(*) AS k FROM (SELECT traj_id, step, unnest(string_split(p, ' ')) AS w FROM n) x WHERE w <> '' GROUP BY 1, 2, 3), gt AS (SELECT w, count(*) AS k FROM (SELECT unnest(string_split((SELECT g FROM n LIMIT 1), ' ')) AS w) x GROUP BY 1),
sh AS (SELECT traj_id, step, sum(least(pt.k, gt.k)) AS s FROM pt JOIN gt ON pt.w = gt.w GROUP BY 1, 2)
SELECT n.traj_id, n.step, round(coalesce(2.0 * s / (len(string_split(p, ' ')) + len(string_split(g, ' '))), 0), 6)::DOUBLE AS f1 FROM n LEFT JOIN sh ON n.traj_id = sh.traj_id AND n.step = sh.step"""),
)
def qa_f1(spark, d):
    return view(spark, d, "fx_calls").select("traj_id", "step", F.round(S.qa_f1(F.col("output"), F.lit("the region O is mm mm")), 6).alias("f1"))


@query("score_rag", oracle(f"SELECT conv_id, turn, CAST(CASE WHEN regexp_matches(response, 'zoom_in') THEN 1 ELSE -1 END + CASE WHEN conv_id % 9 = 8 THEN -1 ELSE 0 END + CASE WHEN conv_id % 9 <> 8 AND conv_id % 3 = 2 THEN 2 ELSE 0 END AS DOUBLE) AS score FROM fx_responses"))
def score_rag(spark, d):
    """2 F1 + 1 for a retrieval (here: a zoom call) or -1 without, -1 for a wrong format."""
    r = responses(spark, d)
    f1 = S.qa_f1(F.col("pred"), F.col("ground_truth"))
    call = F.when(F.regexp_count("response", F.lit("zoom_in")) > 0, 1).otherwise(-1)
    form = F.when(F.regexp_count("response", F.lit("<answer>")) == 1, 0).otherwise(-1)
    return r.select("conv_id", "turn", (2.0 * f1 + call + form).alias("score"))


@query("score_exact", oracle("SELECT traj_id, CASE WHEN pred = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM fx_traj"))
def score_exact(spark, d):
    text = F.concat(F.lit("<think>maybe "), F.col("question"), F.lit("</think> "), F.col("pred"), F.lit("."))
    return view(spark, d, "fx_traj").select("traj_id", S.score_exact(text, F.lit("a")).alias("score"))


# answers as they are written, by id, with # for the number, and their normal forms
_ANSWERS = [
    ("x = $#\\$ units", "#"),
    ("\\boxed{#}", "#"),
    ("\\frac12 + #", "\\frac{1}{2}+#"),
    ("\\sqrt3 \\cdot #", "\\sqrt{3}\\cdot#"),
    ("#,000", "#000"),
    ("# \\text{ and } 8", "#8"),
    ("x,# \\text{ and } 8", "x,#,8"),
    ("#^{\\circ}", "#"),
    ("\\textbf{#} miles", "#miles"),
    ("AB = \\overline{#}", "#"),
    ("so $#$, which is it", "#"),
    ("about $\\mbox{# cm}$", "#"),
    ("# \\text{m}^2", "#"),
    ("a box of #\\,\\mathrm{th}", "boxof#\\,"),
]
_WRITTEN = " ".join(f"WHEN {k} THEN replace('{normal}', '#', ground_truth)" for k, (_, normal) in enumerate(_ANSWERS))


@query("final_answer_normalize", oracle(f"SELECT id, CASE id % {len(_ANSWERS)} {_WRITTEN} END AS answer FROM fx_numeric"))
def final_answer_normalize(spark, d):
    """Every row's number, written in one of the ways above."""
    way = F.get(F.array(*[F.lit(a) for a, _ in _ANSWERS]), (F.col("id") % len(_ANSWERS)).cast("int"))
    return view(spark, d, "fx_numeric").select("id", S.final_answer_normalize(F.replace(way, F.lit("#"), F.col("ground_truth"))).alias("answer"))


@query("score_minerva", oracle("SELECT id, CASE WHEN regexp_extract(response, '#### ([0-9]+)', 1) = ground_truth THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM fx_numeric"))
def score_minerva(spark, d):
    text = F.concat(F.col("response"), F.lit("\nAnswer: 7\nAnswer: x = "), S.gsm8k_strict(F.col("response")))
    return view(spark, d, "fx_numeric").select("id", S.score_minerva(text, F.col("ground_truth")).alias("score"))


@query("score_strict_box", oracle("SELECT id, CASE WHEN regexp_extract(response, '#### ([0-9]+)', 1) = ground_truth THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM fx_numeric"))
def score_strict_box(spark, d):
    text = F.concat(F.col("response"), F.lit(" \\boxed{"), S.gsm8k_strict(F.col("response")), F.lit("}"))
    return view(spark, d, "fx_numeric").select("id", S.score_strict_box(text, F.col("ground_truth")).alias("score"))


@query("score_math", oracle("SELECT id, CASE WHEN regexp_extract(response, '#### ([0-9]+)', 1) = ground_truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM fx_numeric"))
def score_math(spark, d):
    text = F.concat(F.col("response"), F.lit(" \\boxed{\\dfrac{"), S.gsm8k_strict(F.col("response")), F.lit("}{2}}"))
    gt = F.concat(F.lit("\\frac{"), F.col("ground_truth"), F.lit("}{2}"))
    return view(spark, d, "fx_numeric").select("id", S.score_math(text, gt).alias("score"))


@query("math_normalize", oracle("SELECT id, concat('\\frac{', ground_truth, '}{7}') AS text FROM fx_numeric"))
def math_normalize(spark, d):
    return view(spark, d, "fx_numeric").select("id", S.math_normalize(F.concat(F.lit(" k = "), F.col("ground_truth"), F.lit("/7 \\%"))).alias("text"))


@query("score_geo", oracle("SELECT id, CASE WHEN regexp_extract(response, '#### ([0-9]+)', 1) = ground_truth THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM fx_numeric"))
def score_geo(spark, d):
    text = F.concat(F.lit("<think>a</think> \\boxed{"), S.gsm8k_strict(F.col("response")), F.lit("}"))
    form = S.flag(text.rlike(r"(?s)<think>.*</think>.*\\boxed\{.*\}"))
    return view(spark, d, "fx_numeric").select("id", F.round(0.9 * S.flag(S.last_boxed(text) == F.col("ground_truth")) + 0.1 * form, 6).alias("score"))


_RULES = "CASE WHEN length(pred_ans) = 1 THEN CAST(pred_ans = left(answer, 1) AS INTEGER) WHEN length(pred_ans) = 2 AND contains(pred_ans, '.') THEN CAST(contains(pred_ans, left(answer, 1)) AS INTEGER) WHEN contains(pred_ans, answer) THEN 1 END"


@query("judge_rules", oracle(f"SELECT id, {_RULES} AS verdict FROM fx_eval"))
def judge_rules(spark, d):
    return view(spark, d, "fx_eval").select("id", S.judge_rules(F.col("pred_ans"), F.col("answer")).alias("verdict"))


@query("judge_parse", oracle("SELECT id, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS verdict FROM fx_eval"))
def judge_parse(spark, d):
    reply = F.when(F.col("id") % 3 == 0, "Judgement: 1").when(F.col("id") % 3 == 1, " 0 ").otherwise("cannot tell")
    return view(spark, d, "fx_eval").select("id", S.judge_parse(reply).alias("verdict"))


@query("job_judge_requests", oracle(f"SELECT id, concat('[', test_type, '] Is \"', pred_ans, '\" the same as \"', answer, '\"?') AS request FROM fx_eval WHERE {_RULES} IS NULL"))
def job_judge_requests(spark, d):
    e = view(spark, d, "fx_eval").where(S.judge_rules(F.col("pred_ans"), F.col("answer")).isNull())
    return e.select("id", F.format_string('[%s] Is "%s" the same as "%s"?', "test_type", "pred_ans", "answer").alias("request"))


@query("job_judge_merge", oracle(f"WITH e AS (SELECT id, test_type, {_RULES} AS rule, CASE WHEN id % 2 = 0 THEN CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END END AS judged FROM fx_eval) SELECT test_type, count(*) AS n, CAST(sum(coalesce(rule, judged, 0)) AS BIGINT) AS n_right, count(*) FILTER (WHERE rule IS NULL AND judged IS NULL) AS unparsed FROM e GROUP BY 1"))
def job_judge_merge(spark, d):
    """Stored replies (here: for even ids) joined back to the rows that the rules left open."""
    e = view(spark, d, "fx_eval").withColumn("rule", S.judge_rules(F.col("pred_ans"), F.col("answer")))
    reply = F.when(F.col("id") % 3 == 0, "Judgement: 1").when(F.col("id") % 3 == 1, "Judgement: 0").otherwise("cannot tell")
    replies = view(spark, d, "fx_eval").where("id % 2 = 0").select("id", reply.alias("reply"))
    m = e.join(replies, "id", "left").withColumn("judged", S.judge_parse(F.col("reply")))
    return m.groupBy("test_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("rule", "judged", F.lit(0))).cast("long").alias("n_right"), F.count_if(F.col("rule").isNull() & F.col("judged").isNull()).alias("unparsed"))


@query("score_common", oracle("SELECT traj_id, round(0.8 * accuracy - 0.2 * CASE WHEN status = 'error' THEN 1 ELSE 0 END + 1.2 * CASE WHEN has_image AND accuracy > 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM fx_traj"))
def score_common(spark, d):
    right, tool = F.col("accuracy"), F.col("has_image")
    score = 0.8 * right - 0.2 * S.flag(F.col("status") == "error") + 1.2 * S.flag(tool & (right > 0))
    return view(spark, d, "fx_traj").select("traj_id", F.round(score, 6).alias("score"))


@query("score_math_mix", oracle("SELECT id, round(1.2 * CASE WHEN regexp_extract(response, '#### ([0-9]+)', 1) = ground_truth THEN 1 ELSE 0 END - 0.4 * CASE WHEN id % 2 = 1 THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM fx_numeric"))
def score_math_mix(spark, d):
    """Odd rows box twice, which is a wrong format."""
    box = F.concat(F.lit(" \\boxed{"), S.gsm8k_strict(F.col("response")), F.lit("}"))
    text = F.when(F.col("id") % 2 == 1, F.concat(box, box)).otherwise(box)
    n = F.size(F.regexp_extract_all(text, F.lit(r"\\boxed\{"), F.lit(0)))
    return view(spark, d, "fx_numeric").select("id", F.round(1.2 * S.flag(S.last_boxed(text) == F.col("ground_truth")) - 0.4 * S.flag(n != 1), 6).alias("score"))


_DISPATCH = f"CASE WHEN data_source IN ('1-URGENT', '2-HIGH') THEN CASE WHEN p = g THEN 1.0 ELSE 0.0 END WHEN data_source = '3-MEDIUM' THEN {_MRA} ELSE 0.0 END"


def scored(spark, d):
    """Scorer columns and the one that the source calls for; a source that no scorer knows scores 0."""
    n = numbers(spark, d)
    src, strict = F.col("data_source"), S.score_gsm8k(F.col("response"), F.col("ground_truth"))
    by = F.when(src.isin("1-URGENT", "2-HIGH"), strict).when(src == "3-MEDIUM", S.score_mra(F.col("p"), F.col("g"))).otherwise(0.0)
    name = F.when(src.isin("1-URGENT", "2-HIGH"), "gsm8k").when(src == "3-MEDIUM", "mra").otherwise("none")
    return n.withColumns({"score": by, "scorer": name, "strict": strict, "mra": S.score_mra(F.col("p"), F.col("g"))})


@query("score_dispatch", oracle(f"WITH s AS (SELECT f.id, data_source, p, g FROM fx_numeric f JOIN (WITH {_NUM} SELECT * FROM nm) q ON f.id = q.id) SELECT id, CAST({_DISPATCH} AS DOUBLE) AS score FROM s"))
def score_dispatch(spark, d):
    return scored(spark, d).select("id", "score")


@query("job_score_responses", oracle(f"WITH s AS (SELECT f.id, data_source, p, g FROM fx_numeric f JOIN (WITH {_NUM} SELECT * FROM nm) q ON f.id = q.id) SELECT data_source, count(*) AS n, round(avg(CAST({_DISPATCH} AS DOUBLE)), 6) AS score, round(avg(CASE WHEN (p = g) = ({_MRA} >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM s GROUP BY 1"))
def job_score_responses(spark, d):
    s = scored(spark, d)
    return s.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg(S.flag((F.col("strict") == 1) == (F.col("mra") >= 0.5))), 6).alias("agreement"))


@query("answer_cue_match", oracle("SELECT id, ground_truth AS answer FROM fx_numeric"))
def answer_cue_match(spark, d):
    text = F.concat(F.col("response"), F.lit(". So the answer is: "), F.col("ground_truth"), F.lit("."))
    return view(spark, d, "fx_numeric").select("id", S.answer_cue_match(text).alias("answer"))


@query("expr_normalize", oracle("SELECT id, concat(ground_truth, '000') AS text FROM fx_numeric"))
def expr_normalize(spark, d):
    return view(spark, d, "fx_numeric").select("id", S.expr_normalize(F.concat(F.col("ground_truth"), F.lit(",000 Miles"))).alias("text"))

"""Queries on costs, utilities, sequences, gates, arms and combined rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, trajectories, view
from ..operators import groups
from ..operators import reward as R
from ..registry import query

_IOU = """CASE WHEN ({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1)
  - greatest(0.0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0.0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) > 0
 THEN greatest(0.0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0.0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))
  / (({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1)
  - greatest(0.0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0.0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))) ELSE 0 END"""


def iou_sql(a: str, b: str) -> str:
    return _IOU.format(a=a, b=b)


def words_sql(text: str, least: int = 1) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '{chr(92)}b{chr(92)}w{{{least},}}{chr(92)}b'))"


def sim_sql(a: str, b: str) -> str:
    x, y = words_sql(a), words_sql(b)
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN CAST(len(list_intersect({x}, {y})) AS DOUBLE) / greatest(len({x}), len({y})) ELSE 0 END"


# Per-call costs in long form: c (calls), pairs, nb (neighbours), cost (one row a call).
COST_CTE = f"""c AS (SELECT * FROM fx_calls),
sp AS (SELECT b.traj_id, b.step, count(*) AS n FROM c a JOIN c b ON a.traj_id = b.traj_id AND a.step < b.step
  WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL AND a.tool_name IN ('crop','zoom') AND b.tool_name IN ('crop','zoom') AND {iou_sql('a', 'b')} > 0.5 GROUP BY 1, 2),
oc AS (SELECT b.traj_id, b.step, count(*) AS n FROM c a JOIN c b ON a.traj_id = b.traj_id AND a.step < b.step
  WHERE a.tool_name = 'ocr' AND b.tool_name = 'ocr' AND {sim_sql('a.output', 'b.output')} > 0.85 GROUP BY 1, 2),
nb AS (SELECT traj_id, step, tool_name, lag(tool_name, 1) OVER w AS p1, lag(tool_name, 2) OVER w AS p2, lead(tool_name, 1) OVER w AS n1, lead(tool_name, 2) OVER w AS n2
  FROM c WINDOW w AS (PARTITION BY traj_id ORDER BY step)),
flags AS (SELECT nb.traj_id, nb.step, tool_name, n1, n2, coalesce(sp.n, 0) AS dup_spatial, coalesce(oc.n, 0) AS dup_ocr,
  coalesce(p1 = 'zoom' AND tool_name IN ('crop','zoom') AND n1 = 'zoom', false) AS middle,
  coalesce(p2 = 'zoom' AND p1 IN ('crop','zoom') AND tool_name = 'zoom', false) AS third,
  coalesce(tool_name = p1, false) AS consecutive, nb.step >= 3 AS budget
  FROM nb LEFT JOIN sp ON nb.traj_id = sp.traj_id AND nb.step = sp.step LEFT JOIN oc ON nb.traj_id = oc.traj_id AND nb.step = oc.step),
cost AS (SELECT *, greatest(CASE WHEN dup_spatial + dup_ocr > 0 THEN 0.6 ELSE 0.0 END, CASE WHEN middle OR third THEN 0.4 ELSE 0.0 END,
  CASE WHEN consecutive THEN 0.3 ELSE 0.0 END, CASE WHEN budget THEN 0.2 ELSE 0.0 END) AS cost FROM flags)"""


def _long(spark, d, column, name):
    """traj_id, step and one value a call from a per-call array."""
    t = trajectories(spark, d)
    return t.select("traj_id", F.posexplode(column(F.col("tool_calls"))).alias("step", name)).withColumn("step", F.col("step").cast("long"))


@query("cost_dup_spatial", oracle(f"WITH {COST_CTE} SELECT traj_id, step, CAST(dup_spatial AS BIGINT) AS pairs FROM flags WHERE dup_spatial > 0"))
def cost_dup_spatial(spark, d):
    return _long(spark, d, R.dup_spatial_pairs, "pairs").where("pairs > 0").withColumn("pairs", F.col("pairs").cast("long"))


@query("cost_dup_ocr", oracle(f"WITH {COST_CTE} SELECT traj_id, step, CAST(dup_ocr AS BIGINT) AS pairs FROM flags WHERE dup_ocr > 0"))
def cost_dup_ocr(spark, d):
    return _long(spark, d, R.dup_ocr_pairs, "pairs").where("pairs > 0").withColumn("pairs", F.col("pairs").cast("long"))


@query("cost_oscillation", oracle(f"WITH {COST_CTE} SELECT traj_id, step FROM flags WHERE middle"))
def cost_oscillation(spark, d):
    return _long(spark, d, R.oscillation, "hit").where("hit").select("traj_id", "step")


@query("cost_consecutive", oracle(f"WITH {COST_CTE} SELECT traj_id, step FROM flags WHERE consecutive"))
def cost_consecutive(spark, d):
    return _long(spark, d, R.consecutive_same, "hit").where("hit").select("traj_id", "step")


@query("cost_budget", oracle("SELECT traj_id, step FROM fx_calls WHERE step >= 3"))
def cost_budget(spark, d):
    return _long(spark, d, R.over_budget, "hit").where("hit").select("traj_id", "step")


_COUNTERS = ["cost_dup_spatial", "cost_dup_ocr", "cost_oscillation", "cost_consecutive_same", "cost_call_budget"]
_COST_TOTAL = """tot AS (SELECT traj_id, sum(cost) AS cost, CAST(sum(dup_spatial) AS BIGINT) AS cost_dup_spatial, CAST(sum(dup_ocr) AS BIGINT) AS cost_dup_ocr,
  count(*) FILTER (WHERE middle) AS cost_oscillation, count(*) FILTER (WHERE consecutive) AS cost_consecutive_same, count(*) FILTER (WHERE budget) AS cost_call_budget FROM cost GROUP BY 1)"""


@query("cost_total", oracle(f"WITH {COST_CTE}, {_COST_TOTAL} SELECT t.traj_id, round(CAST(coalesce(cost, 0) AS DOUBLE), 6) AS cost, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTERS)} FROM fx_traj t LEFT JOIN tot ON t.traj_id = tot.traj_id"))
def cost_total(spark, d):
    return R.with_costs(trajectories(spark, d)).select("traj_id", F.round("cost", 6).alias("cost"), *_COUNTERS)


@query("cost_firing", oracle(f"WITH {COST_CTE}, {_COST_TOTAL} SELECT t.step, {', '.join(f'CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}' for c in _COUNTERS)} FROM fx_traj t LEFT JOIN tot ON t.traj_id = tot.traj_id GROUP BY 1"))
def cost_firing(spark, d):
    return R.with_costs(trajectories(spark, d)).groupBy("step").agg(*[F.sum(c).alias(c) for c in _COUNTERS])


# --- utility: one row a call with the question and the first box ----------------------------------------------------

_Q3, _O3 = words_sql("question", 3), words_sql("output", 3)
# fixed values, written out here so that the SQL does not follow the implementation's own tables
_LADDER = """WHEN regexp_matches(lower(question), 'color|colour') AND regexp_matches(lower(output), 'red|blue|green|yellow|white|black|pink|purple|orange|brown|gray|grey') THEN 0.8
WHEN regexp_matches(lower(question), 'number|count|how many') AND regexp_matches(lower(output), '[0-9]+') THEN 0.7
WHEN regexp_matches(lower(question), 'where|location|position|side') AND regexp_matches(lower(output), 'left|right|top|bottom|center|middle|front|back|behind|above|below') THEN 0.7
WHEN regexp_matches(lower(question), 'shape|size') AND regexp_matches(lower(output), 'large|small|big|tiny|round|square|rectangular|circular') THEN 0.6"""
UTILITY_CTE = f"""g AS (SELECT c.*, t.question, b.x1 AS gx1, b.y1 AS gy1, b.x2 AS gx2, b.y2 AS gy2,
  c.x1 IS NOT NULL AND c.tool_name IN ('crop','zoom') AS spatial FROM fx_calls c JOIN fx_traj t ON c.traj_id = t.traj_id JOIN fx_gt b ON b.traj_id = c.traj_id AND b.box_idx = 0),
gg AS (SELECT traj_id, step, gx1 AS x1, gy1 AS y1, gx2 AS x2, gy2 AS y2 FROM g),
seen AS (SELECT DISTINCT b.traj_id, b.step FROM g a JOIN g b ON a.traj_id = b.traj_id AND a.step < b.step AND a.tool_name = 'ocr' AND b.tool_name = 'ocr' AND {sim_sql('a.output', 'b.output')} > 0.85),
big AS (SELECT DISTINCT a.traj_id, a.step FROM g a JOIN g b ON a.traj_id = b.traj_id AND a.step <> b.step AND a.spatial AND b.spatial AND {iou_sql('a', 'b')} > 0.9),
lastsp AS (SELECT traj_id, max(step) AS step FROM g WHERE spatial GROUP BY 1),
lastbox AS (SELECT g.traj_id, g.step, (x2-x1)*(y2-y1) AS area FROM g JOIN lastsp l ON g.traj_id = l.traj_id AND g.step = l.step),
parts AS (SELECT g.traj_id, g.step,
  CASE WHEN len({_Q3}) = 0 OR len({_O3}) = 0 THEN 0.0 WHEN len(list_intersect({_Q3}, {_O3})) > 0 THEN 0.6 {_LADDER}
   WHEN regexp_matches(lower(question), 'yes|no|is there|does|contains|has|have') AND length(output) > 20 THEN 0.5 ELSE 0.0 END AS relevance,
  CASE WHEN regexp_matches(output, '[0-9]') AND regexp_matches(lower(question), 'how many|count|number|what is|what''s') THEN 0.15 ELSE 0.0 END AS hint,
  CASE WHEN len(list_filter({words_sql('output', 4)}, lambda x: NOT list_contains(string_split(lower(question), ' '), x))) >= 3 THEN 0.15 ELSE 0.0 END AS novelty,
  CASE WHEN NOT spatial THEN 0.0 WHEN {iou_sql('g', 'gg')} > 0.5 THEN 0.3 WHEN {iou_sql('g', 'gg')} > 0.2 THEN 0.1 ELSE 0.0 END AS gt_iou,
  CASE WHEN spatial AND (g.x2-g.x1)*(g.y2-g.y1) > 0.85 THEN CASE WHEN big.step IS NOT NULL THEN -0.5 ELSE -0.3 END ELSE 0.0 END AS lazy,
  CASE WHEN spatial AND (g.x2-g.x1)*(g.y2-g.y1) > 0.1 THEN CASE WHEN big.step IS NOT NULL THEN -0.5 ELSE -0.3 END ELSE 0.0 END AS lazy_small,
  CASE WHEN tool_name = 'ocr' THEN CASE WHEN regexp_matches(output, '[0-9]') THEN 0.15 ELSE 0.0 END + CASE WHEN regexp_matches(lower(output), '{R.UNITS}') THEN 0.15 ELSE 0.0 END
   - CASE WHEN seen.step IS NOT NULL THEN 0.2 ELSE 0.0 END ELSE 0.0 END AS ocr,
  CASE WHEN spatial AND lb.step > g.step AND lb.area > 0 AND (g.x2-g.x1)*(g.y2-g.y1) < lb.area * 0.5 THEN 0.15 ELSE 0.0 END AS refine
  FROM g JOIN gg ON g.traj_id = gg.traj_id AND g.step = gg.step LEFT JOIN seen ON g.traj_id = seen.traj_id AND g.step = seen.step LEFT JOIN big ON g.traj_id = big.traj_id AND g.step = big.step
  LEFT JOIN lastbox lb ON g.traj_id = lb.traj_id),
util AS (SELECT traj_id, step, greatest(-0.5, least(1.0, CAST(relevance * 0.4 + hint + novelty + gt_iou + lazy + ocr + refine AS DOUBLE))) AS utility FROM parts)"""


def _calls(spark, d):
    """One row a call, with its trajectory's calls, question and box."""
    t = trajectories(spark, d)
    return t.select("traj_id", "question", "gt_box", "tool_calls", F.posexplode("tool_calls").alias("i", "c"))


def _part(name, column, part):
    @query(name, oracle(f"WITH {UTILITY_CTE} SELECT traj_id, step, round(CAST({part} AS DOUBLE), 6) AS value FROM parts WHERE {part} <> 0"))
    def run(spark, d):
        v = column(F.col("c"), F.col("i"))
        return _calls(spark, d).select("traj_id", F.col("i").cast("long").alias("step"), F.round(v, 6).alias("value")).where("value <> 0")

    return run


_part("util_relevance", lambda c, i: R.relevance(c["output"], F.col("question")), "relevance")
_part("util_number_hint", lambda c, i: R.number_hint(c["output"], F.col("question")), "hint")
_part("util_novelty", lambda c, i: R.novelty(c["output"], F.col("question")), "novelty")
_part("util_gt_iou", lambda c, i: R.gt_bonus(c, F.col("gt_box")), "gt_iou")
_part("util_lazy_crop", lambda c, i: R.lazy_crop(c, i, F.col("tool_calls"), F.lit(1.0), F.lit(1.0), R.RewardConfig(lazy_ratio=0.1)), "lazy_small")
_part("util_ocr_gain", lambda c, i: R.ocr_gain(c, i, F.col("tool_calls")), "ocr")
_part("util_refine", lambda c, i: R.refine_bonus(c, i, F.col("tool_calls")), "refine")


@query(
    "util_answer_fallback",
    oracle(f"""SELECT c.traj_id, c.step, CASE WHEN len(w) > 0 AND CAST(len(list_filter(w, lambda x: contains(lower(t.question), x))) AS DOUBLE) / len(w) > 0.3 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value
  FROM (SELECT *, regexp_extract_all(lower(output), '{chr(92)}b{chr(92)}w{{3,}}{chr(92)}b') AS w FROM fx_calls) c JOIN fx_traj t ON c.traj_id = t.traj_id"""),
)
def util_answer_fallback(spark, d):
    return _calls(spark, d).select("traj_id", F.col("i").cast("long").alias("step"), R.answer_fallback(F.col("c.output"), F.col("question")).alias("value"))


@query("util_call", oracle(f"WITH {UTILITY_CTE} SELECT traj_id, step, round(utility, 6) AS utility FROM util"))
def util_call(spark, d):
    one = F.lit(1.0)
    u = R.call_utilities(F.col("tool_calls"), F.col("question"), F.col("gt_box"), one, one)
    t = trajectories(spark, d).select("traj_id", F.posexplode(u).alias("step", "utility"))
    return t.select("traj_id", F.col("step").cast("long").alias("step"), F.round("utility", 6).alias("utility"))


@query("token_sim", oracle(f"SELECT c.traj_id, c.step, round({sim_sql('output', 'question')}, 6) AS sim FROM fx_calls c JOIN fx_traj t ON c.traj_id = t.traj_id"))
def token_sim(spark, d):
    c = view(spark, d, "fx_calls").join(view(spark, d, "fx_traj").select("traj_id", "question"), "traj_id")
    return c.select("traj_id", "step", F.round(R.token_sim(F.col("output"), F.col("question")), 6).alias("sim"))


@query("util_total", oracle(f"WITH {UTILITY_CTE} SELECT traj_id, round(sum(utility), 6) AS utility FROM util GROUP BY 1"))
def util_total(spark, d):
    t = trajectories(spark, d).where(F.size("tool_calls") > 0)
    one = F.lit(1.0)
    return t.select("traj_id", F.round(R.add(R.call_utilities(F.col("tool_calls"), F.col("question"), F.col("gt_box"), one, one)), 6).alias("utility"))


# --- sequence -----------------------------------------------------------------------------------------------------


def _match_sql(pattern, weight):
    cols = ["tool_name", "n1", "n2"]
    return "CASE WHEN " + " AND ".join(f"coalesce({c}, '') = '{p}'" for c, p in zip(cols, pattern)) + f" THEN {weight} ELSE 0.0 END"


# fixed values, as above: patterns of consecutive tools and their weights
_PATTERNS = [
    (("crop", "ocr"), 0.4), (("crop", "zoom", "ocr"), 0.6), (("zoom", "ocr"), 0.4), (("zoom", "rotate", "ocr"), 0.5), (("crop", "ocr", "answer"), 0.5),
    (("ocr", "crop", "ocr"), -0.4), (("ocr", "zoom", "ocr"), -0.4), (("crop", "crop", "crop"), -0.3), (("ocr", "ocr"), -0.3),
]
SEQ_CTE = f"""pat AS (SELECT traj_id, sum(CAST({' + '.join(_match_sql(p, w) for p, w in _PATTERNS)} AS DOUBLE)) AS pattern, count(*) AS n, count(DISTINCT tool_name) AS kinds FROM flags GROUP BY 1),
seq AS (SELECT traj_id, n, kinds, pattern, CASE WHEN kinds >= 3 THEN 0.2 WHEN kinds = 2 THEN 0.1 WHEN kinds = 1 AND n > 1 THEN -0.3 ELSE 0.0 END AS diversity FROM pat),
ss AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE greatest(-1.0, least(1.0, pattern + diversity)) END AS s FROM seq)"""


@query("seq_patterns", oracle(f"WITH {COST_CTE}, {SEQ_CTE} SELECT traj_id, round(pattern, 6) AS pattern FROM seq"))
def seq_patterns(spark, d):
    names = F.transform("tool_calls", lambda c: c["tool_name"])
    return trajectories(spark, d).where(F.size("tool_calls") > 0).select("traj_id", F.round(R.pattern_score(names), 6).alias("pattern"))


@query("seq_diversity", oracle(f"WITH {COST_CTE}, {SEQ_CTE} SELECT traj_id, CAST(diversity AS DOUBLE) AS diversity FROM seq"))
def seq_diversity(spark, d):
    names = F.transform("tool_calls", lambda c: c["tool_name"])
    return trajectories(spark, d).where(F.size("tool_calls") > 0).select("traj_id", R.diversity(names).alias("diversity"))


@query("seq_score", oracle(f"WITH {COST_CTE}, {SEQ_CTE} SELECT t.traj_id, round(CAST(coalesce(s, 0) AS DOUBLE), 6) AS sequence FROM fx_traj t LEFT JOIN ss ON t.traj_id = ss.traj_id"))
def seq_score(spark, d):
    return trajectories(spark, d).select("traj_id", F.round(R.seq_score(F.col("tool_calls")), 6).alias("sequence"))


VALID_CTE = """v AS (SELECT traj_id, step, CASE WHEN raw_tool = 'select' THEN 1 WHEN raw_tool IN ('crop','zoom','zoom_in') THEN CASE WHEN x2 > x1 AND y2 > y1 THEN 3 ELSE 2 END ELSE 3 END AS validity FROM fx_calls),
vt AS (SELECT traj_id, count(*) AS n, CAST(sum(validity) AS DOUBLE) / (count(*) * 3) AS soft, CASE WHEN min(validity) >= 2 THEN 1.0 ELSE 0.0 END AS strict FROM v GROUP BY 1)"""


@query("call_validity", oracle(f"WITH {VALID_CTE} SELECT validity, count(*) AS n FROM v GROUP BY 1"))
def call_validity(spark, d):
    return trajectories(spark, d).select(F.explode(R.call_validities(F.col("tool_calls"))).alias("validity")).groupBy("validity").agg(F.count(F.lit(1)).alias("n"))


_WAY = "(traj_id + step) % 8"
_LEVEL = f"""CASE WHEN {_WAY} IN (0, 1) THEN 0 WHEN raw_tool = 'select' THEN 1 WHEN {_WAY} = 3 THEN 2
WHEN raw_tool IN ('crop','zoom','zoom_in') THEN CASE WHEN {_WAY} IN (4, 5) THEN 2 WHEN x2 > x1 AND y2 > y1 THEN 3 ELSE 2 END
WHEN raw_tool = 'rotate' AND {_WAY} = 6 THEN 2 ELSE 3 END"""


@query("call_validity_levels", oracle(f"SELECT traj_id, step, {_LEVEL} AS validity FROM fx_calls"))
def call_validity_levels(spark, d):
    """Every call, damaged in one of eight ways: no name, raw text that is no object, one or two unknown parameters, a
    turned box, no box, no angle, or not at all."""
    way, box = F.expr(_WAY), F.array("x1", "y1", "x2", "y2")
    name = F.when(way == 0, "").otherwise(F.col("raw_tool"))
    raw = F.when(way == 1, "zoom(1, 2)").when(way == 2, ' {"name": "zoom"}')
    params = F.when(way == 2, F.array(F.lit("p1"))).when(way == 3, F.array(F.lit("p1"), F.lit("P2"))).otherwise(F.array().cast("array<string>"))
    bbox = F.when(way == 4, F.array("x2", "y2", "x1", "y1")).when((way != 5) & F.col("x1").isNotNull(), box)
    return view(spark, d, "fx_calls").select("traj_id", "step", R.validity(name, raw, params, bbox, way != 6).alias("validity"))


@query("gate_strict", oracle(f"WITH {VALID_CTE} SELECT t.traj_id, CAST(coalesce(strict, 1) AS DOUBLE) AS gate FROM fx_traj t LEFT JOIN vt ON t.traj_id = vt.traj_id"))
def gate_strict(spark, d):
    return trajectories(spark, d).select("traj_id", R.gate_strict(R.call_validities(F.col("tool_calls"))).alias("gate"))


@query("gate_soft", oracle(f"WITH {VALID_CTE} SELECT t.traj_id, round(coalesce(soft, 1), 6) AS gate FROM fx_traj t LEFT JOIN vt ON t.traj_id = vt.traj_id"))
def gate_soft(spark, d):
    return trajectories(spark, d).select("traj_id", F.round(R.gate_soft(R.call_validities(F.col("tool_calls"))), 6).alias("gate"))


# --- totals -------------------------------------------------------------------------------------------------------

TOTAL_CTE = f"""{COST_CTE}, {_COST_TOTAL}, {UTILITY_CTE}, ut AS (SELECT traj_id, sum(utility) AS u FROM util GROUP BY 1), {SEQ_CTE}, {VALID_CTE},
r AS (SELECT t.*, coalesce(u, 0) AS u, CAST(coalesce(cost, 0) AS DOUBLE) AS c, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(tot2.n, 0) AS DOUBLE) AS n, soft, strict
  FROM fx_traj t LEFT JOIN ut ON t.traj_id = ut.traj_id LEFT JOIN tot ON t.traj_id = tot.traj_id LEFT JOIN ss ON t.traj_id = ss.traj_id LEFT JOIN vt tot2 ON t.traj_id = tot2.traj_id)"""


@query("reward_total", oracle(f"WITH {TOTAL_CTE} SELECT traj_id, round(accuracy + u - 0.5 * c + 0.3 * s, 6) AS reward, round((accuracy + u - 0.5 * c + 0.3 * s) * coalesce(soft, 1), 6) AS gated, round((accuracy + u - 0.5 * c + 0.3 * s) * coalesce(strict, 1), 6) AS strict FROM r"))
def reward_total(spark, d):
    t = R.with_scores(trajectories(spark, d))
    return t.select("traj_id", F.round(R.reward_column(R.RewardConfig()), 6).alias("reward"), F.round(R.reward_column(R.RewardConfig(gate="soft")), 6).alias("gated"), F.round(R.reward_column(R.RewardConfig(gate="strict")), 6).alias("strict"))


@query(
    "asym_fusion",
    oracle(f"""WITH {TOTAL_CTE} SELECT traj_id, round(CASE WHEN n < 1 THEN accuracy + u - 0.5 * c + 0.3 * s WHEN accuracy > 0.5 THEN accuracy + u - 0.5 * c
  ELSE 0.3 * greatest(0.0, s) + 0.7 * CASE WHEN n >= 2 THEN soft ELSE 0.0 END + greatest(0.0, u) - 0.5 * c END, 6) AS reward FROM r"""),
)
def asym_fusion(spark, d):
    return R.with_scores(trajectories(spark, d)).select("traj_id", F.round(R.reward_column(R.RewardConfig(asymmetric=True)), 6).alias("reward"))


@query("reward_components", oracle(f"WITH {TOTAL_CTE} SELECT data_source, count(*) AS n, round(avg(u), 6) AS utility, round(avg(c), 6) AS cost, round(avg(s), 6) AS sequence, round(avg(accuracy), 6) AS accuracy FROM r GROUP BY 1"))
def reward_components(spark, d):
    t = R.with_scores(trajectories(spark, d))
    return t.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("utility", "cost", "sequence", "accuracy")])


@query("reward_baseline", oracle("SELECT t.traj_id, round(CASE WHEN accuracy > 0 THEN accuracy + 0.1 * coalesce(n, 0) ELSE 0 END, 6) AS reward FROM fx_traj t LEFT JOIN (SELECT traj_id, CAST(count(*) AS DOUBLE) AS n FROM fx_calls GROUP BY 1) c ON t.traj_id = c.traj_id"))
def reward_baseline(spark, d):
    return trajectories(spark, d).select("traj_id", F.round(R.reward_baseline(F.col("accuracy"), F.size("tool_calls")), 6).alias("reward"))


def _preset_sql(name):
    p = R.PRESETS[name]
    return f"accuracy + {p.lambda_u if p.utility else 0} * u - {p.gamma_c if p.cost else 0} * c + {p.eta_s if p.sequence else 0} * s"


@query("reward_ablation", oracle(f"WITH {TOTAL_CTE} " + " UNION ALL ".join(f"SELECT '{p}' AS preset, data_source, round(avg({_preset_sql(p)}), 6) AS reward FROM r GROUP BY 2" for p in R.PRESETS)))
def reward_ablation(spark, d):
    """All presets from one pass of scores: one struct a preset, exploded after the scores are computed."""
    t = R.with_scores(trajectories(spark, d))
    each = F.array(*[F.struct(F.lit(k).alias("preset"), R.reward_column(p).alias("reward")) for k, p in R.PRESETS.items()])
    return t.select("data_source", F.inline(each)).groupBy("preset", "data_source").agg(F.round(F.avg("reward"), 6).alias("reward"))


@query("reward_variants", oracle(f"WITH {TOTAL_CTE} SELECT traj_id, round(CASE WHEN accuracy > 0 THEN accuracy + 0.1 * n ELSE 0 END, 6) AS baseline, round({_preset_sql('full')}, 6) AS full_reward, round({_preset_sql('utility_only')}, 6) AS utility_only, round({_preset_sql('no_sequence')}, 6) AS no_sequence FROM r WHERE status <> 'error'"))
def reward_variants(spark, d):
    t = R.with_scores(trajectories(spark, d).where("status <> 'error'"))
    named = {"full_reward": "full", "utility_only": "utility_only", "no_sequence": "no_sequence"}
    return t.select("traj_id", F.round(R.reward_baseline(F.col("accuracy"), F.size("tool_calls")), 6).alias("baseline"), *[F.round(R.reward_column(R.PRESETS[p]), 6).alias(k) for k, p in named.items()])


_ARM_BASE = "SELECT t.*, coalesce(n, 0) AS n, coalesce(m.delta_s, 1.0) AS delta FROM fx_traj t LEFT JOIN (SELECT traj_id, CAST(count(*) AS DOUBLE) AS n FROM fx_calls GROUP BY 1) c ON t.traj_id = c.traj_id LEFT JOIN fx_score_map m ON t.uid = m.uid"


def _arm_frame(spark, d):
    """Trajectories with the tool-benefit score of their prompt; the map is joined by key, 1.0 where it has none."""
    t = trajectories(spark, d)
    return t.join(view(spark, d, "fx_score_map"), "uid", "left").withColumns({"n": F.size("tool_calls").cast("double"), "delta": F.coalesce("delta_s", F.lit(1.0))})


@query("arm_rewards", oracle(f"WITH a AS ({_ARM_BASE}) SELECT traj_id, accuracy AS arm_a, round(accuracy + 0.6 * exp(-2.0 * pow((n - 6) / 6, 2)), 6) AS arm_b, round(accuracy + 0.6 * delta * exp(-2.0 * pow((n - 6) / 6, 2)), 6) AS arm_d FROM a"))
def arm_rewards(spark, d):
    t = _arm_frame(spark, d)
    return t.select("traj_id", F.col("accuracy").alias("arm_a"), *[F.round(R.arm_reward(a, F.col("accuracy"), F.col("n"), F.col("delta")), 6).alias(f"arm_{a}") for a in "bd"])


def _arm(name, sql):
    @query(f"arm_{name}", oracle(f"WITH a AS ({_ARM_BASE}) SELECT data_source, round(avg({sql}), 6) AS reward FROM a GROUP BY 1"))
    def run(spark, d):
        reward = R.arm_reward(name, F.col("accuracy"), F.col("n"), F.col("delta"))
        return _arm_frame(spark, d).withColumn("r", reward).groupBy("data_source").agg(F.round(F.avg("r"), 6).alias("reward"))

    return run


_arm("a", "accuracy")
_arm("b", "accuracy + 0.6 * exp(-2.0 * pow((n - 6) / 6, 2))")
_arm("d", "accuracy + 0.6 * delta * exp(-2.0 * pow((n - 6) / 6, 2))")


@query("arm_c", oracle(f"WITH {TOTAL_CTE} SELECT data_source, round(avg(accuracy + u - 0.5 * c + 0.3 * s), 6) AS arm_c FROM r GROUP BY 1"))
def arm_c(spark, d):
    t = R.with_scores(trajectories(spark, d))
    total = R.reward_column(R.RewardConfig())
    return t.withColumn("total", total).groupBy("data_source").agg(F.round(F.avg(R.arm_reward("c", F.col("accuracy"), F.size("tool_calls"), total=F.col("total"))), 6).alias("arm_c"))


@query("delta_lookup", oracle("SELECT t.traj_id, coalesce(m.delta_s, 1.0) AS delta FROM fx_traj t LEFT JOIN fx_score_map m ON t.uid = m.uid"))
def delta_lookup(spark, d):
    return _arm_frame(spark, d).select("traj_id", "delta")


@query("valid_action_count", oracle("SELECT t.traj_id, CAST(coalesce(n, 0) AS BIGINT) AS n_actions FROM fx_traj t LEFT JOIN (SELECT traj_id, count(*) AS n FROM fx_calls WHERE output NOT LIKE '[Unknown tool%' GROUP BY 1) c ON t.traj_id = c.traj_id"))
def valid_action_count(spark, d):
    good = F.size(F.filter("tool_calls", lambda c: ~c["output"].startswith("[Unknown tool")))
    return trajectories(spark, d).select("traj_id", good.cast("long").alias("n_actions"))


_MODES = "SELECT uid, avg(accuracy) FILTER (WHERE has_image) AS acc_tool, avg(accuracy) FILTER (WHERE NOT has_image) AS acc_no_tool FROM fx_traj GROUP BY 1"


@query("delta_s", oracle(f"SELECT uid, round(acc_tool, 6) AS acc_tool, round(acc_no_tool, 6) AS acc_no_tool, round(acc_tool - acc_no_tool, 6) AS delta_s FROM ({_MODES}) m"))
def delta_s(spark, d):
    m = groups.paired_modes(view(spark, d, "fx_traj"), "uid", "has_image", "accuracy")
    return m.select("uid", F.round("true", 6).alias("acc_tool"), F.round("false", 6).alias("acc_no_tool"), F.round(F.col("true") - F.col("false"), 6).alias("delta_s"))


@query("paired_modes", oracle(f"SELECT count(*) FILTER (WHERE acc_tool > acc_no_tool) AS better, count(*) FILTER (WHERE acc_tool = acc_no_tool) AS same, count(*) FILTER (WHERE acc_tool < acc_no_tool) AS worse FROM ({_MODES}) m"))
def paired_modes(spark, d):
    m = groups.paired_modes(view(spark, d, "fx_traj"), "uid", "has_image", "accuracy")
    t, f = F.col("true"), F.col("false")
    return m.agg(F.count_if(t > f).alias("better"), F.count_if(t == f).alias("same"), F.count_if(t < f).alias("worse"))


_DEATH = " UNION ALL ".join(f"SELECT step, '{k}' AS component, count(*) AS n, count(DISTINCT round({e}, 9)) AS unique_values, count(DISTINCT round({e}, 9)) <= 1 AS dead, round(min({e}), 6) AS min_value, round(max({e}), 6) AS max_value FROM r GROUP BY 1 HAVING count(*) >= 2" for k, e in (("accuracy", "accuracy"), ("cost", "c"), ("constant", "CAST(0.6 AS DOUBLE)"), ("sequence", "s")))


@query("silent_death", oracle(f"WITH {TOTAL_CTE} {_DEATH}"))
def silent_death(spark, d):
    t = R.with_scores(trajectories(spark, d)).withColumn("constant", F.lit(0.6))
    return groups.silent_death(t, "step", ["accuracy", "cost", "constant", "sequence"])


@query(
    "reward_by_source",
    oracle(f"""WITH {COST_CTE}, {_COST_TOTAL}, r AS (SELECT t.traj_id, uid, data_source, accuracy, round(CAST(accuracy - 0.5 * coalesce(cost, 0) AS DOUBLE), 6) AS reward FROM fx_traj t LEFT JOIN tot ON t.traj_id = tot.traj_id),
w AS (SELECT *, count(*) OVER g AS n, avg(reward) OVER g AS m, stddev_samp(reward) OVER g AS sd, stddev_pop(accuracy) OVER g AS acc_sd FROM r WINDOW g AS (PARTITION BY uid)),
k AS (SELECT *, CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - m) / (sd + 1e-6) END AS adv, acc_sd > 0 OR n = 1 AS kept FROM w)
SELECT data_source, count(*) AS n, round(avg(reward), 6) AS mean_reward, round(avg(CASE WHEN kept THEN 1.0 ELSE 0.0 END), 6) AS kept_share, round(avg(abs(adv)), 4) AS mean_abs_advantage FROM k GROUP BY 1"""),
)
def reward_by_source(spark, d):
    """Flagship: cost-only reward, group advantages, dynamic sampling and a summary by source; one shuffle by uid."""
    config = R.RewardConfig(lambda_u=0.0, eta_s=0.0, utility=False, sequence=False)
    t = R.with_costs(trajectories(spark, d), config)
    t = t.select("traj_id", "uid", "data_source", "accuracy", F.round(F.col("accuracy") - config.gamma_c * F.col("cost"), 6).alias("reward"))
    t = groups.dynamic_sampling(t.withColumn("adv", groups.adv_grpo("reward")), "accuracy")
    kept = F.when(F.col("reason") == "kept", 1.0).otherwise(0.0)
    return t.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.round(F.avg(kept), 6).alias("kept_share"), F.round(F.avg(F.abs("adv")), 4).alias("mean_abs_advantage"))

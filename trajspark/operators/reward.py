"""Trajectory scores over the nested tool_calls array: narrow transformations, no shuffle.

A call is a struct with tool_name, raw_name, bbox (array<double> or null) and output. Lists below marked as fixed values
must equal the scoring rules' own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, overlap
from ..functions.lambdas import bind

# fixed values: tools, patterns and weights
SPATIAL = ["crop", "zoom"]
KNOWN_TOOLS = {"crop": ["bbox_2d", "bbox"], "zoom": ["bbox_2d", "bbox"], "rotate": ["angle"], "ocr": ["bbox_2d", "bbox"]}
ALIASES = {"crop_image": "crop", "crop_image_normalized": "crop", "zoom_in": "zoom"}
PREFERRED = [(["crop", "ocr"], 0.4), (["crop", "zoom", "ocr"], 0.6), (["zoom", "ocr"], 0.4), (["zoom", "rotate", "ocr"], 0.5), (["crop", "ocr", "answer"], 0.5)]
ANTI = [(["ocr", "crop", "ocr"], -0.4), (["ocr", "zoom", "ocr"], -0.4), (["crop", "crop", "crop"], -0.3), (["ocr", "ocr"], -0.3)]
# fixed values: question kinds, what an output must hold for them, and the relevance that gives
KINDS = [
    ("color|colour", "red|blue|green|yellow|white|black|pink|purple|orange|brown|gray|grey", 0.8),
    ("number|count|how many", "[0-9]+", 0.7),
    ("where|location|position|side", "left|right|top|bottom|center|middle|front|back|behind|above|below", 0.7),
    ("shape|size", "large|small|big|tiny|round|square|rectangular|circular", 0.6),
]
EXISTENCE = "yes|no|is there|does|contains|has|have"
NUMBER_CUES = "how many|count|number|what is|what's"
UNITS = ":|°|%|mm|cm|kg|hz"


@dataclass(frozen=True)
class RewardConfig:
    """Weights, thresholds and switches of the combined reward."""

    lambda_u: float = 1.0
    gamma_c: float = 0.5
    eta_s: float = 0.3
    iou_threshold: float = 0.5
    text_threshold: float = 0.85
    call_budget: int = 3
    lazy_ratio: float = 0.85
    utility: bool = True
    cost: bool = True
    sequence: bool = True
    gate: str = "off"  # off, soft or strict
    asymmetric: bool = False
    lambda_s: float = 0.3
    lambda_call: float = 0.7


PRESETS = {
    "full": RewardConfig(),
    "baseline": RewardConfig(lambda_u=0.0, gamma_c=0.0, eta_s=0.0, utility=False, cost=False, sequence=False),
    "utility_only": RewardConfig(gamma_c=0.0, eta_s=0.0, cost=False, sequence=False),
    "cost_only": RewardConfig(lambda_u=0.0, eta_s=0.0, utility=False, sequence=False),
    "sequence_only": RewardConfig(lambda_u=0.0, gamma_c=0.0, utility=False, cost=False),
    "no_sequence": RewardConfig(eta_s=0.0, sequence=False),
}


def words(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words (letters, digits and underscore of any script) of at least so many characters."""
    found = lambda pattern: F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    # the same words; (?U) looks every character up in Unicode's tables
    plain = F.octet_length(text) == F.length(text)
    distinct = F.array_distinct(F.when(plain, found(r"\w+")).otherwise(found(r"(?U)\w+")))
    return distinct if least == 1 else longer(distinct, least)


def longer(found: Column, least: int) -> Column:
    return F.filter(found, lambda w: F.length(w) >= least)


def word_sim(x: Column, y: Column) -> Column:
    """Shared words over those of the richer list; 0 if either has none."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def token_sim(a: Column, b: Column) -> Column:
    """word_sim of two texts."""
    return bind(F.struct(words(a).alias("x"), words(b).alias("y")), lambda p: word_sim(p["x"], p["y"]))


def iou(a: Column, b: Column) -> Column:
    """As geometry.iou, with each part computed once where Spark interprets it, inside of lambdas."""
    ratio = lambda both: bind(area(a) + area(b) - both, lambda union: F.when(union > 0, both / union).otherwise(0.0))
    return bind(overlap(a, b), lambda both: F.when(both == 0, 0.0).otherwise(ratio(both)))


def with_words(calls: Column) -> Column:
    """The calls with the distinct words of their outputs, each extracted once; a null output reads "None" in `text`."""
    text = lambda c: F.coalesce(c["output"], F.lit("None"))
    fields = lambda c: [c[f].alias(f) for f in ("tool_name", "raw_name", "bbox", "output")]
    return F.transform(calls, lambda c: F.struct(*fields(c), text(c).alias("text"), F.lower(text(c)).alias("low"), words(text(c)).alias("words")))


def asked(question: Column) -> Column:
    """What the scores need of a question, computed once a row."""
    low = F.lower(question)
    kinds = F.array(*[low.rlike(kind) for kind, _, _ in KINDS])
    known = F.split(F.trim(low), r"\s+")
    return F.struct(words(question, 3).alias("words3"), known.alias("known"), kinds.alias("kinds"), low.rlike(EXISTENCE).alias("existence"), low.rlike(NUMBER_CUES).alias("number"))


def spatial(c: Column) -> Column:
    return c["tool_name"].isin(SPATIAL) & c["bbox"].isNotNull()


def reads(c: Column) -> Column:
    return (c["tool_name"] == "ocr") & (F.length(c["output"]) > 0)


def before(calls: Column, i: Column) -> Column:
    return F.slice(calls, F.lit(1), i)


def name_at(calls: Column, i: Column) -> Column:
    return F.get(calls, i)["tool_name"]


# --- cost ---------------------------------------------------------------------------------------------------------


def dup_spatial_pairs(calls: Column, config=RewardConfig()) -> Column:
    """For each call, how many earlier boxes overlap it too much."""
    return F.transform(calls, lambda c, i: _spatial_before(calls, c, i, config))


def _spatial_before(calls: Column, c: Column, i: Column, config=RewardConfig()) -> Column:
    own = F.filter(before(calls, i), lambda p: spatial(p) & (iou(p["bbox"], c["bbox"]) > config.iou_threshold))
    return F.when(spatial(c), F.size(own)).otherwise(0)


def dup_ocr_pairs(calls: Column, config=RewardConfig()) -> Column:
    return bind(with_words(calls), lambda k: F.transform(k, lambda c, i: _ocr_before(k, c, i, config)))


def _ocr_before(calls: Column, c: Column, i: Column, config=RewardConfig()) -> Column:
    own = F.filter(before(calls, i), lambda p: reads(p) & (word_sim(p["words"], c["words"]) > config.text_threshold))
    return F.when(reads(c), F.size(own)).otherwise(0)


def _zoom_middle(calls: Column, i: Column) -> Column:
    """Whether the call at i stands between two zooms as a zoom or crop."""
    hit = (name_at(calls, i - 1) == "zoom") & name_at(calls, i).isin(SPATIAL) & (name_at(calls, i + 1) == "zoom")
    return F.coalesce(hit, F.lit(False))


def oscillation(calls: Column) -> Column:
    return F.transform(calls, lambda c, i: _zoom_middle(calls, i))


def consecutive_same(calls: Column) -> Column:
    return F.transform(calls, lambda c, i: _same_before(calls, c, i))


def _same_before(calls: Column, c: Column, i: Column) -> Column:
    return (i > 0) & c["tool_name"].eqNullSafe(name_at(calls, i - 1))


def over_budget(calls: Column, config=RewardConfig()) -> Column:
    return F.transform(calls, lambda c, i: i >= config.call_budget)


def cost_parts(calls: Column, config=RewardConfig()) -> Column:
    """One struct for each call (with its words): dup_spatial and dup_ocr (pairs), oscillation, consecutive, budget."""
    return F.transform(
        calls,
        lambda c, i: F.struct(
            _spatial_before(calls, c, i, config).alias("dup_spatial"),
            _ocr_before(calls, c, i, config).alias("dup_ocr"),
            _zoom_middle(calls, i).alias("middle"),
            _zoom_middle(calls, i - 1).alias("third"),
            _same_before(calls, c, i).alias("consecutive"),
            (i >= config.call_budget).alias("budget"),
        ),
    )


def call_cost(p: Column) -> Column:
    part = lambda on, weight: F.when(on, weight).otherwise(0.0)
    return F.greatest(part((p["dup_spatial"] > 0) | (p["dup_ocr"] > 0), 0.6), part(p["middle"] | p["third"], 0.4), part(p["consecutive"], 0.3), part(p["budget"], 0.2))


def add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def count_true(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x)).cast("long")


def with_costs(df: DataFrame, config=RewardConfig(), calls: str = "tool_calls") -> DataFrame:
    """cost (C) and the five counters cost_dup_spatial (pairs), cost_dup_ocr (pairs), cost_oscillation, cost_consecutive_same,
    cost_call_budget."""
    if calls != "_calls":
        df = df.withColumn("_calls", with_words(F.col(calls)))
    out = df.withColumn("_parts", cost_parts(F.col("_calls"), config))
    total = lambda f: F.aggregate("_parts", F.lit(0).cast("long"), lambda a, p: a + p[f])
    count = lambda f: F.size(F.filter("_parts", lambda p: p[f])).cast("long")
    return out.withColumns(
        {
            "cost": add(F.transform("_parts", call_cost)),
            "cost_dup_spatial": total("dup_spatial"),
            "cost_dup_ocr": total("dup_ocr"),
            "cost_oscillation": count("middle"),
            "cost_consecutive_same": count("consecutive"),
            "cost_call_budget": count("budget"),
        }
    ).drop("_parts", *([] if calls == "_calls" else ["_calls"]))


# --- utility ------------------------------------------------------------------------------------------------------


def relevance(output: Column, question: Column) -> Column:
    """0 to 0.8: shared words come first, then the question's kind."""
    return bind(F.struct(words(output).alias("o"), F.lower(output).alias("low"), asked(question).alias("q")), lambda p: _relevance(p["low"], p["o"], p["q"], F.length(output)))


def _relevance(low: Column, found: Column, q: Column, length: Column) -> Column:
    """low: the output in lower case; found: its words, of which those of three characters or more count."""
    ladder = F.when((F.size(q["words3"]) == 0) | ~F.exists(found, lambda w: F.length(w) >= 3), 0.0).when(F.arrays_overlap(q["words3"], found), 0.6)
    for i, (_, given, value) in enumerate(KINDS):
        ladder = ladder.when(q["kinds"][i] & low.rlike(given), value)
    return ladder.when(q["existence"] & (length > 20), 0.5).otherwise(0.0)


def answer_fallback(output: Column, answer: Column) -> Column:
    """Without a question: 0.2 if over 0.3 of the output's words (repeats count) stand in the answer."""
    all_words = F.regexp_extract_all(F.lower(output), F.lit(r"(?U)\b\w{3,}\b"), F.lit(0))
    found = F.size(F.filter(all_words, lambda w: F.contains(F.lower(answer), w)))
    return F.when((F.size(all_words) > 0) & (found / F.size(all_words) > 0.3), 0.2).otherwise(0.0)


def number_hint(output: Column, question: Column) -> Column:
    return F.when(output.rlike("[0-9]") & F.lower(question).rlike(NUMBER_CUES), 0.15).otherwise(0.0)


def novelty(output: Column, question: Column) -> Column:
    return _novelty(words(output), asked(question))


def _novelty(found: Column, q: Column) -> Column:
    fresh = F.filter(found, lambda w: (F.length(w) >= 4) & ~F.array_contains(q["known"], w))
    return F.when((F.size(found) >= 3) & (F.size(fresh) >= 3), 0.15).otherwise(0.0)


def gt_bonus(c: Column, gt: Column, config=RewardConfig()) -> Column:
    bonus = bind(iou(c["bbox"], gt), lambda v: F.when(v > config.iou_threshold, 0.3).when(v > 0.2, 0.1).otherwise(0.0))
    return F.when(~spatial(c) | gt.isNull(), 0.0).otherwise(bonus)


def lazy_crop(c: Column, i: Column, calls: Column, w: Column, h: Column, config=RewardConfig()) -> Column:
    """-0.3 for a box that is most of the image, -0.2 more if another spatial call, earlier or later, has the same box."""
    others = F.concat(before(calls, i), F.slice(calls, i + 2, F.greatest(F.size(calls) - i - 1, F.lit(0))))
    again = F.exists(others, lambda p: spatial(p) & (iou(c["bbox"], p["bbox"]) > 0.9))
    lazy = spatial(c) & (w * h > 0) & (area(c["bbox"]) / (w * h) > config.lazy_ratio)
    return F.when(lazy, F.when(again, -0.5).otherwise(-0.3)).otherwise(0.0)


def ocr_gain(c: Column, i: Column, calls: Column, config=RewardConfig()) -> Column:
    """For one call by its place; the calls need no words."""
    return F.when(reads(c), bind(with_words(calls), lambda k: _ocr_gain(F.get(k, i), i, k, config))).otherwise(0.0)


def _ocr_gain(c: Column, i: Column, calls: Column, config=RewardConfig()) -> Column:
    text = c["output"]
    found = F.when(text.rlike("[0-9]"), 0.15).otherwise(0.0) + F.when(F.lower(text).rlike(UNITS), 0.15).otherwise(0.0)
    seen = F.exists(before(calls, i), lambda p: (p["tool_name"] == "ocr") & (word_sim(c["words"], p["words"]) > config.text_threshold))
    return F.when(reads(c), found - F.when(seen, 0.2).otherwise(0.0)).otherwise(0.0)


def refine_bonus(c: Column, i: Column, calls: Column, as_coded: bool = True) -> Column:
    """0.15 if the box has less than half the area of the one compared with: as coded, the last later spatial call's; as
    documented, the nearest earlier one's."""
    rest = F.slice(calls, i + 2, F.greatest(F.size(calls) - i - 1, F.lit(0))) if as_coded else before(calls, i)
    boxes = F.filter(rest, spatial)
    other = F.get(boxes, F.size(boxes) - 1)["bbox"]
    return F.when(spatial(c) & (area(other) > 0) & (area(c["bbox"]) < area(other) * 0.5), 0.15).otherwise(0.0)


def call_utilities(calls: Column, question: Column, gt: Column, w: Column, h: Column, config=RewardConfig()) -> Column:
    """Utility of every call, each within [-0.5, 1]."""
    return bind(F.struct(with_words(calls).alias("calls"), asked(question).alias("q")), lambda p: _utilities(p["calls"], p["q"], gt, w, h, config))


def _utilities(calls: Column, q: Column, gt: Column, w: Column, h: Column, config=RewardConfig()) -> Column:
    def one(c, i, last):
        text = c["text"]
        useful = (F.length(text) > 0) & ~c["low"].isin("none", "null")
        hint = F.when(q["number"] & text.rlike("[0-9]"), 0.15).otherwise(0.0)
        evidence = F.when(useful, _relevance(c["low"], c["words"], q, F.length(text)) * 0.4 + hint + _novelty(c["words"], q)).otherwise(0.0)
        # refine_bonus as coded: the last spatial call is the same for all before it
        refined = F.when((i < last["i"]) & (last["area"] > 0) & spatial(c) & (area(c["bbox"]) < last["area"] * 0.5), 0.15).otherwise(0.0)
        total = evidence + gt_bonus(c, gt, config) + lazy_crop(c, i, calls, w, h, config) + _ocr_gain(c, i, calls, config) + refined
        return F.greatest(F.lit(-0.5), F.least(F.lit(1.0), total))

    last = F.array_max(F.transform(calls, lambda c, i: F.when(spatial(c), F.struct(i.alias("i"), area(c["bbox"]).alias("area")))))
    return bind(last, lambda at: F.transform(calls, lambda c, i: one(c, i, at)))


# --- sequence and format ------------------------------------------------------------------------------------------


def pattern_score(names: Column) -> Column:
    """Weights of all places where a pattern stands, overlaps included: tools as letters, counted in their string."""
    letters = {t: chr(97 + k) for k, t in enumerate(sorted({t for p, _ in PREFERRED + ANTI for t in p}))}
    letter = lambda x: F.coalesce(*[F.when(x == t, c) for t, c in letters.items()], F.lit("."))

    def total(text):
        out = F.lit(0.0)
        for pattern, weight in PREFERRED + ANTI:
            p = "".join(letters[t] for t in pattern)
            out = out + F.when(text.contains(p), F.regexp_count(text, F.lit(f"(?={p})")) * weight).otherwise(0.0)
        return out

    return bind(F.array_join(F.transform(names, letter), ""), total)


def diversity(names: Column) -> Column:
    kinds = F.size(F.array_distinct(names))
    return F.when(kinds >= 3, 0.2).when(kinds == 2, 0.1).when((kinds == 1) & (F.size(names) > 1), -0.3).otherwise(0.0)


def seq_score(calls: Column) -> Column:
    """S within [-1, 1]; 0 for fewer than two calls."""
    names = F.transform(calls, lambda c: c["tool_name"])
    return F.when(F.size(calls) < 2, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pattern_score(names) + diversity(names))))


def canonical_tool(name: Column) -> Column:
    """Canonical tool name of a lower-cased name or alias, else null."""
    low = F.lower(name)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[low], F.when(low.isin(*KNOWN_TOOLS), low))


def validity(name: Column, raw: Column, params: Column, bbox: Column, angle_ok: Column) -> Column:
    """0 no name or a raw text that is no object, 1 unknown tool, 2 bad parameters or box, 3 right. params: parameter names."""
    tool = canonical_tool(name)
    allowed = F.create_map(*[x for k, v in KNOWN_TOOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[tool]
    unknown = F.size(F.array_except(F.transform(params, F.lower), allowed))
    box_ok = (F.size(bbox) == 4) & (bbox[2] > bbox[0]) & (bbox[3] > bbox[1])
    return (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, 0)
        .when((F.length(raw) > 0) & ~F.ltrim(raw).startswith("{"), 0)
        .when(tool.isNull(), 1)
        .when(F.coalesce(unknown, F.lit(0)) > 1, 2)
        .when(tool.isin(SPATIAL), F.when(F.coalesce(box_ok, F.lit(False)), 3).otherwise(2))
        .when(tool == "rotate", F.when(F.coalesce(angle_ok, F.lit(False)), 3).otherwise(2))
        .otherwise(3)
    )


def call_validities(calls: Column) -> Column:
    """validity of calls that carry no raw text; a rotate counts as having its angle."""
    return F.transform(calls, lambda c: validity(c["raw_name"], F.lit(None).cast("string"), F.array().cast("array<string>"), c["bbox"], F.lit(True)))


def gate_strict(v: Column) -> Column:
    return F.when(F.forall(v, lambda x: x >= 2), 1.0).otherwise(0.0)


def gate_soft(v: Column) -> Column:
    """Mean validity over 3; 0 if any call has no structure, 1 without calls."""
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / (F.size(v) * 3.0)
    return F.when(F.size(v) == 0, 1.0).when(F.exists(v, lambda x: x == 0), 0.0).otherwise(mean)


def asym_fusion(s: Column, v: Column, accuracy: Column, config=RewardConfig()) -> Column:
    """0 for a right answer, else the weighted sequence score and mean validity. Single calls have no validity here."""
    mean = F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / (F.size(v) * 3.0)).otherwise(0.0)
    return F.when(accuracy > 0.5, 0.0).otherwise(config.lambda_s * F.greatest(F.lit(0.0), s) + config.lambda_call * mean)


# --- totals -------------------------------------------------------------------------------------------------------


def with_scores(df: DataFrame, config=RewardConfig()) -> DataFrame:
    """utility (U), cost (C, with counters), sequence (S) and validities of every trajectory: computed once for all
    reward variants. Needs tool_calls, question, gt_box; boxes are normalised, so the image is 1 x 1. The rules are those
    above, taken a batch at a time (call_scores.py)."""
    from . import call_scores

    return call_scores.with_scores(df, config)


def reward_column(config: RewardConfig) -> Column:
    """Combined reward from the columns of with_scores and accuracy."""
    u = F.col("utility") if config.utility else F.lit(0.0)
    c = F.col("cost") if config.cost else F.lit(0.0)
    s = F.col("sequence") if config.sequence else F.lit(0.0)
    acc, n, v = F.col("accuracy"), F.size("tool_calls"), F.col("validities")
    total = acc + config.lambda_u * u - config.gamma_c * c + config.eta_s * s
    if config.asymmetric:
        per_call = F.when(F.lit(config.sequence) & (n >= 2), v).otherwise(F.array(F.lit(0)))
        wrong = asym_fusion(s, per_call, acc, config) + config.lambda_u * F.greatest(F.lit(0.0), u) - config.gamma_c * c
        total = F.when(n >= 1, F.when(acc > 0.5, acc + config.lambda_u * u - config.gamma_c * c).otherwise(wrong)).otherwise(total)
    gate = {"off": F.lit(1.0), "strict": gate_strict(v), "soft": gate_soft(v)}[config.gate]
    return total * F.when(n > 0, gate).otherwise(1.0)


def reward_baseline(accuracy: Column, n: Column, weight: float = 0.1) -> Column:
    return F.when(accuracy > 0, accuracy + weight * n).otherwise(0.0)


def at_reward(delta: Column, n: Column, n_max: int = 6, gamma: float = 2.0) -> Column:
    return delta * F.exp(-gamma * F.pow((n - n_max) / n_max, F.lit(2.0)))


def arm_reward(arm: str, accuracy: Column, n: Column, delta: Column | None = None, total: Column | None = None, alpha: float = 0.6) -> Column:
    """Reward under one arm: a accuracy; b accuracy and tool-count bonus; c combined reward; d as b, weighted by delta."""
    if arm == "a":
        return accuracy
    if arm == "b":
        return accuracy + alpha * at_reward(F.lit(1.0), n)
    if arm == "c":
        return total
    if arm == "d":
        return accuracy + alpha * at_reward(delta, n)
    raise ValueError(f"unknown arm {arm!r}")

"""All scores of a batch against the rules' own expressions, on odd rows too."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from trajspark.operators import call_scores
from trajspark.operators import reward as R

SCHEMA = "id int, question string, gt_box array<double>, tool_calls array<struct<step:bigint,raw_name:string,tool_name:string,bbox:array<double>,output:string>>"
TOOLS = ["crop", "zoom", "ocr", "rotate", "select", "answer", None, "Crop_Image", ""]
WORDS = ["red", "42", "mm", "left", "größe", "ÉTÉ", "कमरा", "½", "flag", "small", "region", "°", "İz", "_a", "none"]
QUESTIONS = ["How many mm wide is region O?", "What color is the flag?", "Where is  the text?", "Does it have size or GRÖßE?", " ", "", None, "कमरा where"]


def rows(n: int) -> list[tuple]:
    r = random.Random(5)
    side = lambda: r.choice([r.randrange(5) / 4, r.random(), None if r.random() < 0.05 else 0.5, float("nan") if r.random() < 0.05 else 1.0])
    box = lambda: None if r.random() < 0.1 else r.choice([[0.0, 0.0, 1.0, 1.0], [0.1, 0.1, 0.6, 0.6], [side() for _ in range(4)]])
    text = lambda: r.choice([None, "", "None", "NULL", " ".join(r.choices(WORDS, k=r.randrange(1, 7)))])
    call = lambda k: (k, r.choice(TOOLS), r.choice(TOOLS[:4] if r.random() < 0.8 else TOOLS), box(), text())
    return [(i, r.choice(QUESTIONS), box(), [call(k) for k in range(r.choice([0, 1, 2, 3, 5, 9]))]) for i in range(n)]


def by_rule(df, config):
    """As with_scores, by the expressions of reward.py."""
    calls, one = F.col("tool_calls"), F.lit(1.0)
    utility = R.add(R.call_utilities(calls, F.col("question"), F.col("gt_box"), one, one, config))
    return R.with_costs(df, config).withColumns({"utility": utility, "sequence": R.seq_score(calls), "validities": R.call_validities(calls)})


def test_batches_equal_rules(spark):
    df = spark.createDataFrame(rows(600), SCHEMA).repartition(3)
    columns = ["id", "utility", "cost", *call_scores.COUNTERS, "sequence", "validities"]
    for config in (R.RewardConfig(), R.RewardConfig(iou_threshold=0.2, text_threshold=0.4, call_budget=1, lazy_ratio=0.2)):
        want = by_rule(df, config).select(columns).orderBy("id").collect()
        assert R.with_scores(df, config).select(columns).orderBy("id").collect() == want


def test_pairs_in_slices(spark, monkeypatch):
    """Long trajectories are compared a slice at a time."""
    df = spark.createDataFrame(rows(40), SCHEMA)
    table = df.toArrow()
    args = [table.column(c).combine_chunks() for c in ("tool_calls", "question", "gt_box")]
    whole = call_scores.score(*args, R.RewardConfig())
    monkeypatch.setattr(call_scores, "_PAIRS", 2)
    assert call_scores.score(*args, R.RewardConfig()).equals(whole)
    assert call_scores.score(*[a.slice(7, 20) for a in args], R.RewardConfig()).equals(whole.slice(7, 20))


def test_null_calls_and_empty():
    calls = pa.array([None, []], pa.list_(pa.struct({"tool_name": pa.string(), "raw_name": pa.string(), "bbox": pa.list_(pa.float64()), "output": pa.string()})))
    got = call_scores.score(calls, pa.array([None, "x"]), pa.array([None, None], pa.list_(pa.float64())), R.RewardConfig()).to_pylist()
    assert got[0]["utility"] is None and got[0]["validities"] is None
    assert got[1]["utility"] == 0 and got[1]["cost"] == 0 and got[1]["validities"] == []


def test_no_interpreted_lambdas_over_calls(spark):
    """The scores of all calls come from one Arrow step: no fold over calls is left to Spark's interpreter."""
    plan = R.with_scores(spark.createDataFrame(rows(3), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan and "rlike" not in plan.lower()


def test_a_repeated_text_is_cut_into_words_once(monkeypatch):
    """Facts of a text are found once a batch, those of a text and a question once for each pair."""
    kind = pa.list_(pa.struct({"tool_name": pa.string(), "raw_name": pa.string(), "bbox": pa.list_(pa.float64()), "output": pa.string()}))
    call = lambda t: {"tool_name": "ocr", "raw_name": "ocr", "bbox": None, "output": t}
    calls = pa.array([[call("red 42 mm"), call("a blue flag here"), call(None)]] * 50, kind)
    seen, cut = [], call_scores.words
    monkeypatch.setattr(call_scores, "words", lambda low: seen.append(low) or cut(low))
    got = call_scores.score(calls, pa.array(["How many mm?", None] * 25), pa.array([None] * 50, pa.list_(pa.float64())), R.RewardConfig())
    assert sum(low in ("red 42 mm", "a blue flag here", "none") for low in seen) == 3
    assert len({str(x) for x in got.to_pylist()[::2]}) == len({str(x) for x in got.to_pylist()[1::2]}) == 1

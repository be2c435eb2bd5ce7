"""Depth-aware comparison of list answers."""

import pytest
from pyspark.sql import functions as F

from trajspark.functions import scorers as S

CASES = [
    ("(1, 2)", "(1,2.00001)", 1), ("(1, 2)", "[1, 2]", 0), ("(1, 2]", "(1, 2]", 1), ("(1, 2]", "(1, 3]", 0), ("1, 2", "1,2,3", 0), ("1, 2", "1.0, 2", 1),
    ("[1, (2, 3)]", "[1.0, (2.0, 3)]", 1), ("[1, (2, 3)]", "[1, (3, 2)]", 0), ("[(1, 2), (3, 4)]", "[(1, 2), (3, 4), (5, 6)]", 0), ("(1, 2), (3, 4)", "(1.0, 2), (3, 4)", 1),
    (r"\begin{pmatrix} 1 & 2 \\ 3 & 4 \end{pmatrix}", "[[1,2],[3,4.0]]", 1), (r"\begin{bmatrix} 1 \\ 3 \end{bmatrix}", r"\begin{pmatrix} 1 \\ 3.0 \end{pmatrix}", 1), (r"\begin{array}{cc} 1 & 2 \\ \end{array}", "[[1,3]]", 0),
    ("50", "0.5", 1), ("0.5", "50", 1), ("0.51", "50", 0), ("Red Flag", "red flag", 1), ("", "", 1), ("()", "()", 1), ("(", "(", 1), ("x, 2", "X, 2.0", 1), (None, "1", 0), ("1", None, 0), ("(a", "(b", 0), ("{1, 2}", "{1.0, 2}", 1),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(CASES)], "i int, p string, g string")
    got = {r.i: r.s for r in rows.select("i", S.score_numeric_close(F.col("p"), F.col("g")).alias("s")).collect()}
    assert [(p, g, got[i]) for i, (p, g, _) in enumerate(CASES)] == [(p, g, float(w)) for p, g, w in CASES]


@pytest.mark.parametrize("text,parts", [("1,2", ["1", "2"]), ("(1,2),[3,(4,5)]", ["(1,2)", "[3,(4,5)]"]), ("f(1,{2,3}), x", ["f(1,{2,3})", "x"]), ("", [""]), (",", ["", ""])])
def test_split_at_depth_zero(spark, text, parts):
    assert spark.createDataFrame([(text,)], "t string").select(S.split_list(F.col("t")).alias("p")).first().p == parts


def test_every_text_that_casts_to_a_number_is_tried(spark):
    texts = ["1", "-1.5e3", " 7 ", "\t7", "+.5", "1d", "2F", "0x1p3", "NaN", "nan", "inf", "-Infinity", "+INF", "Infinity", "", "(1", "1,2", "x", "red", "--1", "1e", "\u0661", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.as_number(F.col("t")).alias("got"), F.trim("t").try_cast("double").alias("want")).collect()
    assert [(r.t, str(r.got)) for r in rows] == [(r.t, str(r.want)) for r in rows]


def test_parts_used_often_are_made_once(spark):
    """Written out, the cuts of a list stood 30 times and more in the plan, and the normal form of a text in the fold over its words."""
    df = spark.range(1).selectExpr("cast(id as string) p", "cast(id as string) g")
    plan = lambda c: df.select(c)._jdf.queryExecution().analyzed().toString()
    assert plan(S.score_numeric_close(F.col("p"), F.col("g"), deep=1)).count("split(") <= 12
    assert plan(S.qa_f1(F.col("p"), F.col("g"))).count("(a|an|the)") <= 4

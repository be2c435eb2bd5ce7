"""System prompts: schemas of the tool dimension and the rules of either mode."""

import json

import pytest
from pyspark.sql import functions as F

from trajspark import tools
from trajspark.functions import text as X


def prompts(spark, names, specs=None):
    rows = spark.createDataFrame([("answer_first",), ("tool_first",), ("other",), (None,)], "mode string")
    return {r.mode: r.p for r in rows.select("mode", X.system_prompt(names, F.col("mode"), specs).alias("p")).collect()}


def test_modes_and_schemas(spark):
    got = prompts(spark, ["zoom", "crop"])
    assert got["other"] is None and got[None] is None
    for mode, rule in (("answer_first", "1. FIRST, answer directly"), ("tool_first", "1. BEFORE answering, you MUST call a tool")):
        lines = got[mode].split("<tools>\n")[1].split("\n</tools>")[0].split("\n")
        functions = [json.loads(x)["function"] for x in lines]
        assert [f["name"] for f in functions] == ["zoom", "crop"]
        assert all(f["parameters"]["required"] == ["bbox_2d"] and f["parameters"]["properties"]["bbox_2d"]["maxItems"] == 4 for f in functions)
        assert rule in got[mode] and got[mode].count("# Answer policy") == 1 and got[mode].endswith("<answer>your answer</answer>")


def test_every_tool_of_the_dimension_has_a_schema(spark):
    for name, _, _, _, params in tools.TOOLS:
        shape = json.loads(tools.function_schema(name))["function"]["parameters"]
        assert set(shape["properties"]) <= set(params) and set(shape["required"]) <= set(params)
    assert json.loads(tools.function_schema("ocr"))["function"]["parameters"]["required"] == []


def test_own_tools(spark):
    specs = {**tools.SPECS, "tilt": ("Tilt the \"view\".", "angle", "Degrees.", False)}
    line = prompts(spark, ["tilt"], specs)["tool_first"].split("<tools>\n")[1].split("\n")[0]
    assert json.loads(line)["function"]["description"] == 'Tilt the "view".'
    with pytest.raises(KeyError):
        X.system_prompt(["tilt"], F.lit("tool_first"))

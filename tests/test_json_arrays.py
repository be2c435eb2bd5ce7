"""JSON arrays read in ranges of a few bytes against Python's parser and the multi-line reader."""

import json
import random

import pytest

from trajspark.sources import json_arrays as J

ROWS = [
    {"id": 1, "s": 'a},{"id": 9}', "n": {"x": [1, {"y": "}"}]}},
    {"id": 2, "s": 'quote \\" and \\\\', "n": None},
    {"id": 3, "s": "\\", "n": {"x": []}},
    {"id": 4, "s": "\\\\\"}{[", "n": {"x": [{"y": "{"}]}},
    {"id": 5, "s": "é " * 40, "n": {"x": [{"y": "]"}] * 5}},
    {"id": 6, "s": "", "n": {}},
]
SCHEMA = "id long, s string, n struct<z:int>"


def texts():
    rng = random.Random(1)
    yield "dense", json.dumps(ROWS, separators=(",", ":"))
    yield "wide", json.dumps(ROWS * 2, indent=3, ensure_ascii=False)
    yield "one", json.dumps([{"id": 7, "s": "{" * 500 + '"' * 9, "n": None}])
    yield "none", " [ ] \n"
    yield "mixed", '[1, "x{y", [ {"id": 8} , [{"id": 8}]], {"id": 10, "s": "k"}, null, [[' + "[]," * 60 + '[]]], {"id": 11}\n]\n'
    yield "random", json.dumps([{"id": i, "s": "".join(rng.choice('\\"{}[],:a') for _ in range(rng.randrange(60)))} for i in range(40)])


@pytest.fixture(params=["128m", "61"])
def ranges(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_every_range_gives_every_object(spark, tmp_path, ranges):
    want = {}
    for name, text in texts():
        (tmp_path / f"{name}.json").write_text(text)
        want[name] = sorted(json.dumps(x) for x in json.loads(text) if isinstance(x, dict))
    found = J.objects(spark, [str(tmp_path)]).collect()
    for name in want:
        assert sorted(json.dumps(json.loads(r.value)) for r in found if r.file.endswith(f"/{name}.json")) == want[name], name
    assert len(found) == sum(map(len, want.values()))


def test_equals_the_multi_line_reader(spark, tmp_path):
    for i, (name, text) in enumerate(texts()):
        if name not in ("mixed", "none"):
            (tmp_path / f"{i}.json").write_text(text)
    plain = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(J.read_json_array(spark, [str(tmp_path)], SCHEMA)) == order(plain)
    for where in ("id > 3 and s <> ''", "n is not null", "`id` = 1", "true"):
        assert order(J.read_json_array(spark, [str(tmp_path)], SCHEMA, where)) == order(plain.where(where))


def test_a_large_file_is_several_tasks_and_only_named_columns_are_parsed_first(spark, tmp_path):
    path = str(tmp_path / "big")
    J.write_json_array(spark.range(5000).selectExpr("id", "concat('a},', id) AS s").coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert J._scan(spark, [path]).rdd.getNumPartitions() > 4
        got = J.read_json_array(spark, [path], "id long, s string", "id % 2 = 0")
        assert got.count() == 2500 and got.where("s = 'a},42'").count() == 1
        assert "from_json(StructField(id,LongType,true)" in got._jdf.queryExecution().optimizedPlan().toString().replace("jsontostructs", "from_json")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_damage_and_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}, {"id": 3')
    with pytest.raises(ValueError, match="does not close"):
        J.objects(spark, [str(tmp_path)])
    assert sorted(r.value for r in J.objects(spark, [str(tmp_path)], strict=False).collect()) == ['{"id": 1}', '{"id": 2}']
    J.write_json_array(spark.range(0), str(tmp_path / "none"))
    assert J.read_json_array(spark, [str(tmp_path / "none")], "id long").count() == 0


def test_files_are_read_twice_and_marks_are_those_of_a_plain_loop(spark, tmp_path, monkeypatch):
    scans, scan = [], J._scan
    monkeypatch.setattr(J, "_scan", lambda *a: scans.append(a) or scan(*a))
    (tmp_path / "a.json").write_text(json.dumps(ROWS))
    assert J.objects(spark, [str(tmp_path)]).count() == len(ROWS) and len(scans) == 2
    rng = random.Random(2)
    for _ in range(300):
        data = "".join(rng.choice('\\\\"{}[],a') for _ in range(rng.randrange(40))).encode()
        want, quotes, run = [], 0, 0
        for i, c in enumerate(data.decode()):
            if c in "{}[]" or (c == '"' and run % 2 == 0):
                quotes += c == '"'
                want.append((i, quotes, 1 if c in "{[" else -1 if c in "}]" else 0))
            run = run + 1 if c == "\\" else 0
        assert list(zip(*(x.tolist() for x in J.marks(data)))) == want

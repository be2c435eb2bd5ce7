"""Hand-made cases of the scoring rules, on tables of a few rows."""

import math

import pytest
from pyspark.sql import functions as F

from trajspark import tools
from trajspark.functions import geometry as G
from trajspark.functions import scorers as S
from trajspark.functions import text as X
from trajspark.operators import filters, groups, protocol
from trajspark.operators import reward as R

CALLS = "traj_id long, question string, gt_box array<double>, accuracy double, tool_calls array<struct<step:long,raw_name:string,tool_name:string,bbox:array<double>,output:string>>"


def attempt(spark, *calls, accuracy=1.0, question="What is here?", gt=None):
    rows = [(i, n, t, b, o) for i, (n, t, b, o) in enumerate(calls)]
    return spark.createDataFrame([(1, question, gt, accuracy, rows)], CALLS)


def zoom(box, out=""):
    return ("zoom_in", "zoom", box, out)


def test_duplicate_zooms_cost(spark):
    t = attempt(spark, zoom([0.10, 0.10, 0.30, 0.30]), zoom([0.11, 0.11, 0.31, 0.31]))
    r = R.with_costs(t).first()
    assert r.cost_dup_spatial == 1 and r.cost > 0


def test_budget_and_consecutive(spark):
    boxes = [[0.0, 0.0, 0.1, 0.1], [0.2, 0.2, 0.3, 0.3], None, [0.4, 0.4, 0.5, 0.5], [0.6, 0.6, 0.7, 0.7]]
    names = ["zoom", "crop", "ocr", "zoom", "zoom"]
    r = R.with_costs(attempt(spark, *[(n, n, b, "") for n, b in zip(names, boxes)])).first()
    assert r.cost_call_budget == 2 and r.cost_consecutive_same == 1


def test_clean_and_empty_cost_nothing(spark):
    for t in (attempt(spark, zoom([0.1, 0.1, 0.2, 0.2]), ("ocr", "ocr", None, "text")), attempt(spark)):
        r = R.with_costs(t).first()
        assert r.cost == 0 and [r.cost_dup_spatial, r.cost_dup_ocr, r.cost_oscillation, r.cost_consecutive_same, r.cost_call_budget] == [0] * 5


def test_one_aligned_zoom(spark):
    box = [0.1, 0.1, 0.4, 0.4]
    t = R.with_scores(attempt(spark, zoom(box, "[Zoomed into the small red region]"), gt=box, question="zzz"))
    r = t.select("utility", R.reward_column(R.RewardConfig()).alias("reward")).first()
    assert r.utility == pytest.approx(0.45) and r.reward == pytest.approx(1.45)


def test_same_zoom_three_times_wrong(spark):
    box = [0.6, 0.6, 0.9, 0.9]
    t = R.with_scores(attempt(spark, *[zoom(box, "[Zoomed into the small red region]")] * 3, accuracy=0.0, question="zzz", gt=[0.0, 0.0, 0.1, 0.1]))
    r = t.select("*", R.reward_column(R.RewardConfig()).alias("reward")).first()
    assert (r.cost_dup_spatial, r.cost_oscillation, r.cost_consecutive_same) == (3, 1, 2)
    assert r.cost == pytest.approx(1.2) and r.sequence == pytest.approx(-0.3) and r.utility == pytest.approx(0.45)
    assert r.reward == pytest.approx(0.45 - 0.6 - 0.09)


def test_validity_and_gates(spark):
    b = [0.1, 0.1, 0.2, 0.2]
    t = attempt(spark, ("crop", "crop", b, ""), ("zoom_in", "zoom", b, ""), ("rotate", "rotate", None, ""), ("ocr", "ocr", None, ""), ("select", "select", None, ""))
    r = t.select(R.call_validities(F.col("tool_calls")).alias("v")).select("v", R.gate_soft(F.col("v")).alias("soft"), R.gate_strict(F.col("v")).alias("strict")).first()
    assert r.v == [3, 3, 3, 3, 1] and r.soft < 1 and r.strict == 0


def test_arms(spark):
    r = spark.range(1).select(R.at_reward(F.lit(1.0), F.lit(6)).alias("six"), R.at_reward(F.lit(1.0), F.lit(0)).alias("none"), R.arm_reward("d", F.lit(0.0), F.lit(6), F.lit(-1.0)).alias("minus"), R.arm_reward("d", F.lit(0.0), F.lit(6), F.lit(0.0)).alias("zero")).first()
    assert 0.6 * r.six == pytest.approx(0.6) and 0.6 * r.none == pytest.approx(0.6 * math.exp(-2)) and r.minus == pytest.approx(-0.6) and r.zero == 0
    with pytest.raises(ValueError):
        R.arm_reward("x", F.lit(0.0), F.lit(0))


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, map(float, v)))
    r = spark.range(1).select(G.norm_if_pixel(box(100, 100, 300, 300), F.lit(600), F.lit(800)).alias("a"), G.norm_if_pixel(box(0.1, 0.1, 0.3, 0.3), F.lit(600), F.lit(800)).alias("b"), G.norm_if_pixel(box(5, 5), F.lit(6), F.lit(8)).alias("c"), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("none")).first()
    assert r.a == pytest.approx([1 / 6, 1 / 8, 1 / 2, 3 / 8]) and r.b == [0.1, 0.1, 0.3, 0.3] and r.c == [5.0, 5.0] and r.none == 0


def test_dead_components(spark):
    t = spark.createDataFrame([(1, 0.6, 0.0), (1, 0.6, 1.0), (2, 0.1, 0.1)], "step long, at_penalty double, acc double")
    got = {(r.step, r.component): r.dead for r in groups.silent_death(t, "step", ["at_penalty", "acc"]).collect()}
    assert got == {(1, "at_penalty"): True, (1, "acc"): False}


def test_answers(spark):
    options = F.array(F.lit("the red flag"), F.lit("the blue flag"))
    score = lambda p: S.score_mcq_text(F.lit(p), F.lit("the red flag"), options)
    r = spark.range(1).select(score("A").alias("a"), score("It is the red flag.").alias("b"), score("").alias("c"), score("B").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (1.0, 1.0, 0.0, 0.0)


def test_parsing_keeps_the_shift_of_outputs(spark):
    block = lambda s: f"<tool_call>{s}</tool_call>"
    good, bad = '{"name": "zoom_in", "arguments": {"bbox_2d": [0, 0, 1, 1], "label": "x"}}', '{"name": broken}'
    text = f"{block(bad)} one {block(good)} two {block(good.replace('zoom_in', 'Mystery'))} three"
    r = spark.range(1).select(X.parse_tool_calls(F.lit(text)).alias("c"), X.parse_tool_calls(F.lit("{'name': 1}")).alias("none"), X.parse_tool_calls(F.lit(block(good.replace('"', "'")))).alias("quoted")).first()
    assert [(c.raw_name, c.tool_name, c.output) for c in r.c] == [("zoom_in", "zoom", "one"), ("Mystery", "mystery", "three")]
    assert r.c[0].bbox == [0, 0, 1, 1] and r.c[0].label == "x" and r.none == [] and r.quoted[0].tool_name == "zoom"


def test_boxed_and_normal_forms(spark):
    texts = {"a \\boxed{1} b \\boxed{\\frac{1}{2}} c": "\\frac{1}{2}", "none": None, "\\boxed{open": None, "\\boxed{}": ""}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", S.last_boxed(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == texts
    forms = {"\\dfrac12": "\\frac{1}{2}", "0.5": "\\frac{1}{2}", "x=3": "3", "3/4": "\\frac{3}{4}", " 10\\% ": "10", "\\sqrt2": "\\sqrt{2}"}
    df = spark.createDataFrame([(k,) for k in forms], "t string").select("t", S.math_normalize(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == forms


def test_unicode_words(spark):
    r = spark.range(1).select(F.array_sort(R.words(F.lit("Héllo wörld, héllo ab"), 3)).alias("w"), R.token_sim(F.lit(""), F.lit("a")).alias("s")).first()
    assert r.w == ["héllo", "wörld"] and r.s == 0


def test_filters_count_every_row(spark):
    t = spark.createDataFrame([(i, i % 3 == 0, None if i == 4 else i) for i in range(10)], "i long, ok boolean, n long")
    tagged = filters.tagged(t, [("ok", F.col("ok")), ("n", F.col("n") < 5)])
    kept, dropped = filters.split_by_reason(tagged)
    assert kept.count() + dropped.count() == 10 and {r.reason for r in dropped.collect()} == {"ok", "n"}
    assert filters.tagged(t, []).where("reason = 'kept'").count() == 10


def test_protocol_round_trips_and_errors(spark):
    t = protocol.with_position(spark.createDataFrame([(i % 3, i) for i in range(50)], "k long, v long"), "k", "v")
    assert [r.row_idx for r in t.orderBy("k", "v").collect()] == list(range(50))
    back = protocol.unpad(protocol.pad_to_divisor(t, 64).drop("is_pad"), 14)
    assert sorted(r.v for r in back.collect()) == list(range(50))
    few = protocol.pad_to_divisor(t.where("row_idx < 3"), 16)
    assert sorted(r.row_idx for r in few.collect()) == list(range(16))
    with pytest.raises(ValueError):
        protocol.chunk(t, 7)
    with pytest.raises(KeyError):
        protocol.pop(t, ["missing"])
    assert protocol.with_position(t.limit(0).drop("row_idx"), "k", "v").count() == 0


def test_advantages_sum_to_nothing(spark):
    t = spark.createDataFrame([(i // 4, float(i % 3)) for i in range(40)] + [(99, 2.0)], "uid long, score double")
    sums = t.withColumn("a", groups.adv_grpo("score")).groupBy("uid").agg(F.sum("a").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in sums if r.uid != 99)
    assert [r.s for r in sums if r.uid == 99] == [pytest.approx(2 / (1 + 1e-6))]


def test_tool_names_are_unique(spark):
    more = tools.register(tools.tool_table(spark), "measure", ["ruler"])
    assert more.count() == 5
    with pytest.raises(ValueError):
        tools.register(more, "zoom_in", [])


def test_readers(spark, tmp_path):
    from trajspark.sources import io

    (tmp_path / "t.jsonl").write_text('{"image": "a", "status": "success", "tool_calls": [{"tool_name": "zoom"}]}\n\n{broken\n')
    t = io.read_trajectories(spark, str(tmp_path / "t.jsonl"))
    rows = t.collect()
    assert [r.image for r in rows if r._corrupt is None] == ["a"] and sum(r._corrupt is not None for r in rows) == 1
    for name in ("direct/x", "direct/y"):
        (tmp_path / "n" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "n" / f"{name}.jpg").write_bytes(b"0")
    (tmp_path / "n/direct/x.json").write_text('{"question": "q", "bbox": [[1, 2, 3, 4]]}')
    a = io.read_annotations(spark, str(tmp_path / "n")).collect()
    assert [(r.test_type, r.stem, r.question, r.bbox) for r in a] == [("direct", "x", "q", [[1.0, 2.0, 3.0, 4.0]])]


def test_packed_annotations_read_as_loose_files(spark, tmp_path):
    from trajspark.sources import io

    loose = {"direct/x.jpg": b"0", "direct/y.jpg": b"0", "direct/x.json": b'{"question": "q",\n "bbox": [[1, 2, 3, 4]]}', "other/x.json": b'{"options": ["a"]}'}
    for name, content in loose.items():
        (tmp_path / "n" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "n" / name).write_bytes(content)
    for folder, ending in (("notes", "json"), ("images", "jpg")):
        files = [(k, v) for k, v in loose.items() if k.endswith(ending)]
        io.write_pack(spark.createDataFrame(files, "path string, content binary"), str(tmp_path / "packs" / folder))
    rows = lambda df: sorted(map(repr, df.drop("image").collect()))
    for orphans in (False, True):
        want = rows(io.read_annotations(spark, str(tmp_path / "n"), orphans=orphans))
        assert rows(io.read_annotations(spark, str(tmp_path / "packs"), "notes", "images", orphans=orphans, packed=True)) == want and len(want) == (3 if orphans else 1)


def test_cues_and_expressions(spark):
    texts = {"Thus the answer is 5.": "5", "the correct answer is: 7 cm": "7 cm", "the answer is none": None, "so 4 ... ANSWER: x = 3": "x = 3", "nothing": None}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", S.answer_cue_match(F.col("t")).alias("a"))
    assert {r.t: r.a for r in df.collect()} == texts
    forms = {"1,234,567": "1234567", "2 million": "2*10^6", "3 1/2": "3+1/2", "45 degrees": "45", "10 cm^2": "10", "1,23": "1,23"}
    df = spark.createDataFrame([(k,) for k in forms], "t string").select("t", S.expr_normalize(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == forms


def test_positions_of_a_value_that_most_rows_share(spark):
    from pyspark.sql import functions as F

    from trajspark.operators.protocol import minibatches, with_position

    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"), "id").repartition(5)
    placed = with_position(df, "k", "v", "id", partitions=8)
    rows = sorted(placed.collect(), key=lambda r: (r.k, r.v is not None, r.v or 0, r.id))
    assert [r.row_idx for r in rows] == list(range(2000))
    # no range holds what one value of the first key would put together
    dealt = df.repartitionByRange(8, "k", "v", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in dealt) < 700
    batches = minibatches(placed, 64, 3, seed=5).groupBy("epoch", "batch_id").count().collect()
    assert sorted(r["count"] for r in batches) == [16] * 3 + [64] * 93


def test_scores_compute_each_part_once(spark):
    """Spark interprets what stands inside of lambdas, so a part that is written out twice is computed twice; results as by plain loops."""
    calls = [("crop", [0.0, 0.0, 0.5, 0.5], "Größe 12 mm"), ("crop", [0.0, 0.0, 0.5, 0.5], None), ("crop", [0.0, 0.0, 0.1, 0.1], "x"), ("ocr", None, "left side 5"), ("ocr", None, "left side 5"), (None, None, "ocr"), ("ocr", None, "")]
    schema = "question string, gt_box array<double>, tool_calls array<struct<tool_name:string,raw_name:string,bbox:array<double>,output:string>>"
    df = spark.createDataFrame([("How many mm?", [0.0, 0.0, 0.5, 0.4], [(t, t, b, o) for t, b, o in calls])], schema)
    scored = R.with_scores(df)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("how many") <= 2 and plan.count(".bbox") < 90
    names = [t for t, _, _ in calls]
    total = sum(w for i in range(len(names)) for p, w in R.PREFERRED + R.ANTI if names[i : i + len(p)] == p)
    got = scored.select("utility", "cost", "cost_dup_spatial", "cost_dup_ocr", R.pattern_score(F.transform("tool_calls", lambda c: c["tool_name"])).alias("p"), R.words(F.lit("Größe größe a_1 ١٢")).alias("w")).first()
    assert abs(got.p - total) < 1e-9 and sorted(got.w) == sorted(["größe", "a_1", "١٢"])
    assert (got.cost_dup_spatial, got.cost_dup_ocr) == (1, 1)


def test_greedy_batches_are_dealt_row_by_row(spark):
    import heapq

    from trajspark.operators import batching as B

    rows = [(k % 3, k, (k * 7919) % 101) for k in range(400)]
    dealt = B.balance_greedy(spark.createDataFrame(rows, "b long, k long, w long"), "b", "w", "k", 4)
    assert "FlatMapGroups" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for b in range(3):
        heap = [(0.0, p) for p in range(4)]
        for _, k, w in sorted((r for r in rows if r[0] == b), key=lambda r: (-r[2], r[1])):
            total, p = heapq.heappop(heap)
            want.add((b, k, w, p))
            heapq.heappush(heap, (total + w, p))
    assert {tuple(r) for r in dealt.collect()} == want


def test_pairs_number_keys_not_texts(spark, tmp_path):
    from trajspark.fixtures import VIEWS, view

    docs = [(k, None if k == 4 else f"t{k // 3}", [None, "de", "en"][k % 3]) for k in range(40)] + [(8, "other", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 1)) for k in range(38)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = view(spark, str(tmp_path), "fx_pairs")
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("text#" in line for i, line in enumerate(plan) if "Window" in "".join(plan[max(0, i - 1) : i]))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(name)
    key = lambda r: (r.id, r.prompt)
    assert sorted(map(key, got.collect())) == sorted(map(key, spark.sql(VIEWS["fx_pairs"]).collect()))
    plain = lambda df: sorted(map(repr, df.where("id <> 8").collect()))  # noqa: E731  (8 has two texts, whose order the view leaves open)
    assert len(got.collect()) > 5 and plain(got.where("chosen <> 'other'")) == plain(spark.sql(VIEWS["fx_pairs"]).where("chosen <> 'other'"))

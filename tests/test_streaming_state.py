"""Streams whose state ends: timers, turns out of order, exactly-once accumulation, mergeable sketches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trajspark import udf
from trajspark.streaming import jobs as J
from trajspark.streaming import state as S

DAY = 86_400_000


def run(spark, df, make, tmp, name, files=1):
    """All micro-batches of a stream over tmp/in; its rows and the rows left in state."""
    S.use_rocksdb(spark)
    q = make(J.read_stream(spark, f"{tmp}/in", df.schema, files)).writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/{name}-ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp}/{name}").collect(), q.lastProgress.stateOperators[0].numRowsTotal


def write(spark, tmp, rows, schema):
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    return df


def test_groups_complete_time_out_and_leave_no_state(spark, tmp_path):
    schema = "uid long, traj_id long, ts string, score double"
    df = write(spark, tmp_path, [(1, 1, "2024-01-01", 1.0), (1, 2, "2024-01-02", 0.0), (2, 3, "2024-01-01", 5.0), (3, 4, "2024-01-03", 1.0)], schema)
    write(spark, tmp_path, [(1, 5, "2024-01-04", 1.0), (2, 6, "2024-03-01", 2.0), (2, 7, "2024-03-02", 4.0)], schema)
    write(spark, tmp_path, [(9, 9, "2124-01-01", 0.0), (9, 10, "2124-01-01", 0.0), (9, 11, "2124-01-01", 0.0)], schema)
    got, left = run(spark, df, lambda s: S.wait_for_groups(s, 3, 10 * DAY, "1 day"), tmp_path, "out")
    groups = {}
    for r in got:
        groups.setdefault((r.uid, r.n, r.complete), []).append((r.traj_id, round(r.advantage, 3)))
    groups = {k: sorted(v) for k, v in groups.items()}
    assert groups.pop((9, 3, True))
    assert groups == {(1, 3, True): [(1, 0.577), (2, -1.155), (5, 0.577)], (2, 1, False): [(3, 5.0)], (3, 1, False): [(4, 1.0)], (2, 2, False): [(6, -0.707), (7, 0.707)]}
    assert left == 0


def test_prompts_of_one_bucket_keep_their_own_groups_and_times(spark, tmp_path):
    rng = random.Random(5)
    rows = [(u, 100 * u + k, f"2024-{1 + k % 6:02d}-{rng.randrange(1, 29):02d}", float(k)) for u in range(60) for k in range(rng.choice([1, 2, 5, 9]))]
    schema = "uid long, traj_id long, ts string, score double"
    for half in ("2024-01 2024-02 2024-03", "2024-04 2024-05 2024-06"):  # half-years in files of their own
        df = write(spark, tmp_path, [r for r in rows if r[2][:7] in half], schema)
    write(spark, tmp_path, [(-1, -1, "2124-01-01", 0.0)], schema)
    seen = []
    got, left = run(spark, df, lambda s: S.wait_for_groups(s, 3, 40 * DAY, "100 days", buckets=2), tmp_path, "out")
    for u in range(60):
        group = []
        for _, traj, ts, _ in sorted((r for r in rows if r[0] == u), key=lambda r: r[2:0:-1]):
            day = (datetime.date.fromisoformat(ts) - datetime.date(2024, 1, 1)).days
            if group and (len(group) == 3 or day > group[0][1] + 40):
                seen += [(u, t, len(group), len(group) == 3) for t, _ in group]
                group = []
            group.append((traj, day))
        seen += [(u, t, len(group), len(group) == 3) for t, _ in group]
    assert sorted((r.uid, r.traj_id, r.n, r.complete) for r in got if r.uid >= 0) == sorted(seen)
    # what is left is the last row's: one attempt and its bucket's timer (kept under the key and under the time)
    assert left <= 3


def test_shuffled_turns_give_the_batch_rows_and_leave_no_state(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for t in range(25):
        for k in range(rng.choice([1, 3, 8, 60])):
            rows.append((t, k, f"2024-01-{1 + k % 28:02d}", rng.random() < 0.03, rng.random() < 0.08, rng.choice([10, 900]), rng.choice([0, 0, 3])))
    schema = "traj_id long, turn long, ts string, is_error boolean, done boolean, n_tokens long, n_images int"
    rng.shuffle(rows)
    for a in range(0, len(rows), len(rows) // 4 + 1):
        df = write(spark, tmp_path, rows[a : a + len(rows) // 4 + 1], schema)
    batch = J.end_reasons(spark.read.parquet(f"{tmp_path}/in")).where("end_reason <> 'ON_GOING'").collect()
    write(spark, tmp_path, [(-1, 0, "2124-01-01", False, True, 0, 0)], schema)
    got, left = run(spark, df, lambda s: S.fold_turns(s, DAY, "60 days"), tmp_path, "out")
    assert sorted((r.traj_id, r.end_reason, r.tool_calls) for r in got if r.traj_id >= 0) == sorted((r.traj_id, r.end_reason, r.tool_calls) for r in batch)
    assert left == 0


def test_accumulation_is_exactly_once_and_stops(spark, tmp_path):
    for b in range(6):
        df = spark.createDataFrame([(b * 10 + i, i % 2) for i in range(10)], "id long, ok int")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: J.read_stream(spark, f"{tmp_path}/in", df.schema, 1)
    keep = lambda b: b.where("ok = 1")
    out = f"{tmp_path}/out"
    assert S.accumulate(stream(), keep, 12, out, f"{tmp_path}/ck") == 15
    rows = lambda: sorted(map(tuple, spark.read.schema("id long, ok int, batch long").parquet(f"{out}/rows").collect()))
    first = rows()
    assert len(first) == 15 and {b for *_, b in first} == {0, 1, 2}
    # without its checkpoint the stream runs every batch again: nothing changes
    assert S.accumulate(stream(), keep, 12, out, f"{tmp_path}/ck-2") == 15 and rows() == first
    # a later run goes on to a higher target
    assert S.accumulate(stream(), keep, 17, out, f"{tmp_path}/ck-3") == 20
    assert S.accumulate(stream(), lambda b: b.where("false"), 5, f"{tmp_path}/none", f"{tmp_path}/ck-4") == 0


def test_sketches_merge_over_batches(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "id % 3 AS step", "id % 4000 AS uid", "cast(id % 997 as double) AS v", "0.5D AS same")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    S.step_sketches(J.read_stream(spark, f"{tmp_path}/in", rows.schema, 1), ["v", "same"], "uid", "v", f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 5
    for r in S.merged_steps(spark, f"{tmp_path}/out", ["v", "same"]).collect():
        assert r.n in (6666, 6667) and abs(r.distinct - 4000) <= 200 and abs(r.q50 - 498) <= 20 and abs(r.q90 - 897) <= 20
        assert (r.dead_v, r.dead_same) == (False, True)


def test_scorer_from_a_file(spark, tmp_path):
    file = tmp_path / "my_scorer.py"
    file.write_text("def f(source, solution, truth, extra, bonus=0):\n    if solution == 'bad':\n        raise ValueError\n    return (solution == truth) + bonus\n")
    got = udf.shipped_scorer(spark, str(file), "f", "my_score", bonus=2)
    df = spark.createDataFrame([("s", "a", "a"), ("s", "b", "a"), ("s", "bad", "a")], "source string, solution string, truth string")
    assert [r.s.score for r in df.select(got("source", "solution", "truth", F.lit("")).alias("s")).collect()] == [3.0, 2.0, 0.0]
    df.createOrReplaceTempView("answers")
    assert spark.sql("SELECT sum(my_score(source, solution, truth, '').score) AS t FROM answers").first().t == 5.0
    with pytest.raises(AttributeError):
        udf.shipped_scorer(spark, str(file), "g")

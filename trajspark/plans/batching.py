"""Queries on top-k, balancing, dedupe, sampling, splits and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table, trajectories, view
from ..operators import batching as B
from ..operators import differencing as D
from ..operators import groups, protocol
from ..registry import query


def traj(spark, d):
    return view(spark, d, "fx_traj")


_STD = "s AS (SELECT traj_id, stddev_samp(accuracy) OVER (PARTITION BY uid) AS std FROM fx_traj)"


@query("topk_std", oracle(f"WITH {_STD} SELECT traj_id, round(std, 6) AS std FROM s ORDER BY std DESC NULLS LAST, traj_id LIMIT 50"))
def topk_std(spark, d):
    t = traj(spark, d).withColumn("std", F.stddev_samp("accuracy").over(groups.by_uid()))
    # the std is rounded for the order, so that the last bit does not decide ties
    return B.top_k(t, 50, F.round("std", 12).desc_nulls_last(), F.col("traj_id")).select("traj_id", F.round("std", 6).alias("std"))


@query("head_target", oracle("SELECT traj_id FROM fx_traj ORDER BY traj_id LIMIT 37"))
def head_target(spark, d):
    return B.top_k(traj(spark, d), 37, F.col("traj_id")).select("traj_id")


_ACC = "p AS (SELECT step, count(*) FILTER (WHERE accuracy > 0) AS k FROM fx_traj GROUP BY 1), u AS (SELECT step, coalesce(sum(k) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)"


@query("accumulate_until", oracle(f"WITH {_ACC} SELECT t.traj_id, t.step FROM fx_traj t JOIN u ON t.step = u.step WHERE accuracy > 0 AND before < 150"))
def accumulate_until(spark, d):
    return B.accumulate_until(traj(spark, d), "step", F.col("accuracy") > 0, 150, 12).select("traj_id", "step")


@query("align_discard", oracle("WITH n AS (SELECT count(*) % 7 AS drop0 FROM fx_traj), r AS (SELECT traj_id, has_image, row_number() OVER (PARTITION BY has_image ORDER BY traj_id DESC) AS r FROM fx_traj) SELECT traj_id FROM r, n WHERE NOT (has_image AND r <= drop0)"))
def align_discard(spark, d):
    return B.align_discard(traj(spark, d), F.col("has_image"), "traj_id", 7).select("traj_id")


@query("align_upsample", oracle("WITH n AS (SELECT (64 - count(*) % 64) % 64 AS need FROM fx_traj), r AS (SELECT traj_id, row_number() OVER (ORDER BY md5(concat('1-', traj_id)), traj_id) AS r FROM fx_traj WHERE has_image) SELECT traj_id, false AS is_added FROM fx_traj UNION ALL SELECT traj_id, true FROM r, n WHERE r <= need"))
def align_upsample(spark, d):
    t = traj(spark, d)
    return B.align_upsample(t, t.where("has_image"), "traj_id", 1, 64).select("traj_id", "is_added")


_SERP = "s AS (SELECT traj_id, trajlength, (row_number() OVER (ORDER BY trajlength DESC, traj_id) - 1) % 16 AS t FROM fx_traj), b AS (SELECT traj_id, trajlength, CASE WHEN t < 8 THEN t ELSE 15 - t END AS part FROM s)"


@query("balance_equal", oracle(f"WITH {_SERP} SELECT part, count(*) AS n, sum(trajlength) AS tokens FROM b GROUP BY 1"))
def balance_equal(spark, d):
    b = B.balance_serpentine(traj(spark, d), "trajlength", "traj_id", 8)
    return b.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("trajlength").alias("tokens"))


_GREEDY = """WITH RECURSIVE o AS (SELECT step, trajlength AS w, row_number() OVER (PARTITION BY step ORDER BY trajlength DESC, traj_id) AS r FROM fx_traj),
g AS (SELECT DISTINCT step, CAST(0 AS BIGINT) AS r, CAST([0, 0, 0, 0] AS BIGINT[]) AS s, CAST([0, 0, 0, 0] AS BIGINT[]) AS c FROM o
  UNION ALL SELECT g.step, o.r, list_transform(g.s, lambda x, i: x + CASE WHEN i = list_position(g.s, list_min(g.s)) THEN o.w ELSE 0 END),
    list_transform(g.c, lambda x, i: x + CASE WHEN i = list_position(g.s, list_min(g.s)) THEN 1 ELSE 0 END) FROM g JOIN o ON o.step = g.step AND o.r = g.r + 1),
e AS (SELECT step, arg_max(s, r) AS s, arg_max(c, r) AS c FROM g GROUP BY 1)
SELECT step, CAST(unnest(range(0, 4)) AS INTEGER) AS part, unnest(c) AS n, unnest(s) AS tokens FROM e"""


@query("balance_greedy", oracle(_GREEDY).replace("WITH fx_traj AS", "WITH RECURSIVE fx_traj AS").replace(", RECURSIVE o AS", ", o AS"))
def balance_greedy(spark, d):
    b = B.balance_greedy(traj(spark, d), "step", "trajlength", "traj_id", 4)
    return b.groupBy("step", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("trajlength").alias("tokens"))


_SERP_STEP = "s AS (SELECT step, trajlength, (row_number() OVER (PARTITION BY step ORDER BY trajlength DESC, traj_id) - 1) % 16 AS t FROM fx_traj), b AS (SELECT step, sum(trajlength) AS w FROM s GROUP BY step, CASE WHEN t < 8 THEN t ELSE 15 - t END), x AS (SELECT step, max(w) - min(w) AS dealt FROM b GROUP BY 1)"


@query("balance_differencing", oracle(f"WITH {_SERP_STEP}, n AS (SELECT step, count(*) AS n, sum(trajlength) AS tokens FROM fx_traj GROUP BY 1) SELECT n.step, n.n, CAST(n.tokens AS BIGINT) AS tokens, CAST(8 AS BIGINT) AS parts, n.n % 8 <> 0 AS uneven, true AS no_worse FROM n JOIN x ON n.step = x.step"))
def balance_differencing(spark, d):
    """Each step dealt to 8 parts by largest differencing with equal counts: what the parts add up to, whether counts differ,
    and whether the spread is at most that of the serpentine deal."""
    t = traj(spark, d)
    each = D.balance_differencing(t, "step", "trajlength", "traj_id", 8).groupBy("step", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("trajlength").alias("w"))
    each = each.groupBy("step").agg(F.sum("c").alias("n"), F.sum("w").alias("tokens"), F.count(F.lit(1)).alias("parts"), (F.max("c") > F.min("c")).alias("uneven"), (F.max("w") - F.min("w")).alias("spread"))
    turn = F.pmod(F.col("_pos"), F.lit(16))
    dealt = D.placed_in_batch(t, "step", "trajlength", "traj_id").groupBy(F.col("step").alias("s"), F.when(turn < 8, turn).otherwise(15 - turn)).agg(F.sum("trajlength").alias("w"))
    dealt = dealt.groupBy("s").agg((F.max("w") - F.min("w")).alias("dealt"))
    return each.hint("merge").join(dealt.hint("merge"), F.col("step") == F.col("s")).select("step", "n", "tokens", "parts", "uneven", (F.col("spread") <= F.col("dealt")).alias("no_worse"))


@query("balance_stats", oracle(f"WITH {_SERP}, x AS (SELECT part, sum(trajlength) AS s FROM b GROUP BY 1) SELECT CAST(min(s) AS BIGINT) AS least, CAST(max(s) AS BIGINT) AS most, round(avg(s), 4) AS mean, CAST(max(s) - min(s) AS BIGINT) AS spread FROM x"))
def balance_stats(spark, d):
    s = B.balance_stats(B.balance_serpentine(traj(spark, d), "trajlength", "traj_id", 8), "trajlength", "part")
    return s.withColumn("mean", F.round("mean", 4))


@query("microbatch_tokens", oracle("WITH n AS (SELECT CAST(ceil(sum(trajlength) / 5000000.0) AS BIGINT) AS k FROM fx_traj), s AS (SELECT traj_id, trajlength, (row_number() OVER (ORDER BY trajlength DESC, traj_id) - 1) % (2 * k) AS t, k FROM fx_traj, n) SELECT CASE WHEN t < k THEN t ELSE 2 * k - 1 - t END AS part, count(*) AS n, sum(trajlength) AS tokens FROM s GROUP BY 1"))
def microbatch_tokens(spark, d):
    """As many parts as the tokens need at 5,000,000 each, balanced by tokens."""
    t = traj(spark, d)
    parts = -(-t.agg(F.sum("trajlength").alias("n")).first()["n"] // 5_000_000)
    return B.balance_serpentine(t, "trajlength", "traj_id", parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("trajlength").alias("tokens"))


_CHUNKS = "c AS (SELECT step, CAST((row_number() OVER (PARTITION BY step ORDER BY traj_id) - 1) // 512 AS INTEGER) AS chunk, trajlength AS w FROM fx_traj), k AS (SELECT step, chunk, count(*) AS n, sum(w) AS tokens, max(w) AS widest, CAST(ceil(sum(w) / 1000000.0) AS BIGINT) AS parts FROM c GROUP BY 1, 2)"


@query("microbatch_differencing", oracle(f"WITH {_CHUNKS} SELECT step, chunk, n, CAST(tokens AS BIGINT) AS tokens, parts, true AS fits FROM k"))
def microbatch_differencing(spark, d):
    """Chunks of 512 attempts of a step in as many micro-batches as their tokens need at 1,000,000 each. fits: the spread is
    at most the longest attempt, which no deal by whole attempts can be held to beat."""
    m = D.microbatches(traj(spark, d), "step", "trajlength", "traj_id", 1_000_000, 512)
    parts = m.groupBy("step", "chunk", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("trajlength").alias("w"), F.max("trajlength").alias("x"))
    k = parts.groupBy("step", "chunk").agg(F.sum("c").alias("n"), F.sum("w").alias("tokens"), F.count(F.lit(1)).alias("parts"), ((F.max("w") - F.min("w")) <= F.max("x")).alias("fits"))
    return k.select("step", "chunk", "n", "tokens", "parts", "fits")


@query("pick_for_check", oracle("WITH r AS (SELECT *, row_number() OVER (PARTITION BY accuracy > 0 ORDER BY trajlength DESC, traj_id) AS r FROM fx_traj) SELECT traj_id, accuracy FROM r WHERE r <= 20 ORDER BY r > 11, trajlength DESC, traj_id LIMIT 20"))
def pick_for_check(spark, d):
    return B.pick_for_check(traj(spark, d), F.col("accuracy") > 0, [F.col("trajlength").desc()], "traj_id", 20).select("traj_id", "accuracy")


@query("disagreement_top", oracle("WITH m AS (SELECT avg(accuracy) AS ma, avg(trajlength) AS ml FROM fx_traj) (SELECT traj_id, 'up' AS side FROM fx_traj, m WHERE accuracy > ma AND trajlength < ml ORDER BY traj_id LIMIT 10) UNION ALL (SELECT traj_id, 'down' FROM fx_traj, m WHERE accuracy < ma AND trajlength > ml ORDER BY traj_id LIMIT 10)"))
def disagreement_top(spark, d):
    t = traj(spark, d)
    t = t.crossJoin(F.broadcast(t.agg(F.avg("accuracy").alias("ma"), F.avg("trajlength").alias("ml"))))  # one row
    up = t.where("accuracy > ma and trajlength < ml").orderBy("traj_id").limit(10).select("traj_id", F.lit("up").alias("side"))
    return up.unionByName(t.where("accuracy < ma and trajlength > ml").orderBy("traj_id").limit(10).select("traj_id", F.lit("down").alias("side")))


@query("print_samples", oracle("WITH r AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY traj_id) AS r FROM fx_traj) SELECT data_source, traj_id, pred FROM r WHERE r <= 3"))
def print_samples(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("data_source").orderBy("traj_id")
    return traj(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("data_source", "traj_id", "pred")


# --- dedupe, sampling, splits --------------------------------------------------------------------------------------


@query("dedupe_first", oracle("WITH r AS (SELECT stage, question, ordinal, row_number() OVER (PARTITION BY stage, question ORDER BY ordinal) AS r FROM fx_stage) SELECT stage, ordinal FROM r WHERE r = 1"))
def dedupe_first(spark, d):
    return B.first_per_key(view(spark, d, "fx_stage"), ["stage", "question"], ["ordinal"]).select("stage", "ordinal")


@query("dedupe_prompt", oracle("WITH r AS (SELECT stage, question, ordinal, row_number() OVER (PARTITION BY question ORDER BY stage, ordinal) AS r FROM fx_stage) SELECT stage, ordinal FROM r WHERE r = 1"))
def dedupe_prompt(spark, d):
    return B.first_per_key(view(spark, d, "fx_stage"), ["question"], ["stage", "ordinal"]).select("stage", "ordinal")


def _sample(name, seed, k):
    @query(name, oracle(f"SELECT traj_id FROM fx_traj WHERE status <> 'error' ORDER BY md5(concat('{seed}-', traj_id)), traj_id LIMIT {k}"))
    def run(spark, d):
        return B.sample_k(traj(spark, d).where("status <> 'error'"), k, seed, "traj_id").select("traj_id")

    return run


_sample("sample_reservoir", 42, 100)
_sample("sample_quick", 7, 20)


@query("sample_table", oracle("SELECT traj_id, question, pred, accuracy FROM fx_traj ORDER BY md5(concat('3-', traj_id)), traj_id LIMIT 15"))
def sample_table(spark, d):
    return B.sample_k(traj(spark, d), 15, 3, "traj_id").select("traj_id", "question", "pred", "accuracy")


@query("split_head", oracle("SELECT traj_id, CASE WHEN row_number() OVER (ORDER BY traj_id) <= 20 THEN 'val' ELSE 'train' END AS split FROM fx_traj"))
def split_head(spark, d):
    return B.split_first(traj(spark, d).select("traj_id"), 20, F.col("traj_id"))


@query("split_tail", oracle("SELECT traj_id, CASE WHEN row_number() OVER (ORDER BY traj_id DESC) <= 20 THEN 'val' ELSE 'train' END AS split FROM fx_traj"))
def split_tail(spark, d):
    return B.split_first(traj(spark, d).select("traj_id"), 20, F.col("traj_id").desc())


@query("split_percent", oracle("SELECT traj_id, CASE WHEN row_number() OVER (ORDER BY traj_id) <= floor(count(*) OVER () * 0.75) THEN 'train' ELSE 'test' END AS split FROM fx_traj"))
def split_percent(spark, d):
    t = traj(spark, d).select("traj_id")
    cut = t.count() * 3 // 4
    p = protocol.with_position(t, "traj_id")
    return p.select("traj_id", F.when(F.col("row_idx") < cut, "train").otherwise("test").alias("split"))


@query("sort_stable", oracle("SELECT traj_id, row_number() OVER (ORDER BY accuracy DESC, traj_id) - 1 AS pos FROM fx_traj"))
def sort_stable(spark, d):
    t = traj(spark, d).withColumn("neg", -F.col("accuracy"))
    return protocol.with_position(t, "neg", "traj_id", name="pos").select("traj_id", "pos")


# --- joins and sets ------------------------------------------------------------------------------------------------


@query("join_gt", oracle("WITH g AS (SELECT traj_id, box_idx, x1, row_number() OVER (PARTITION BY traj_id ORDER BY box_idx) AS r FROM fx_gt WHERE traj_id % 3 <> 0) SELECT t.traj_id, box_idx, x1 FROM fx_traj t LEFT JOIN g ON t.traj_id = g.traj_id AND r = 1"))
def join_gt(spark, d):
    """The first of the directories (here: boxes) that has the key."""
    g = B.first_per_key(view(spark, d, "fx_gt").where("traj_id % 3 <> 0"), ["traj_id"], ["box_idx"])
    return traj(spark, d).select("traj_id").join(g.select("traj_id", "box_idx", "x1"), "traj_id", "left")


_LAST = "l AS (SELECT uid, arg_max(traj_id % 5, traj_id) AS delta FROM fx_traj WHERE uid % 4 <> 0 GROUP BY 1)"


@query("join_delta", oracle(f"WITH {_LAST} SELECT t.traj_id, delta FROM fx_traj t LEFT JOIN l ON t.uid = l.uid"))
def join_delta(spark, d):
    """Left join on a map whose last duplicate wins."""
    t = traj(spark, d)
    last = t.where("uid % 4 <> 0").groupBy("uid").agg(F.max_by(F.col("traj_id") % 5, "traj_id").alias("delta"))
    return t.select("traj_id", "uid").join(last, "uid", "left").select("traj_id", "delta")


@query("src_lookup_map", oracle(f"WITH {_LAST} SELECT * FROM l"))
def src_lookup_map(spark, d):
    return traj(spark, d).where("uid % 4 <> 0").groupBy("uid").agg(F.max_by(F.col("traj_id") % 5, "traj_id").alias("delta"))


@query("join_uid_score", oracle("SELECT t.traj_id, m.delta_s FROM fx_traj t LEFT JOIN fx_score_map m ON t.uid = m.uid"))
def join_uid_score(spark, d):
    return traj(spark, d).select("traj_id", "uid").join(view(spark, d, "fx_score_map"), "uid", "left").select("traj_id", "delta_s")


@query("join_crop_index", oracle("SELECT t.traj_id, g.box_idx FROM fx_traj t JOIN fx_gt g ON t.traj_id = g.traj_id"))
def join_crop_index(spark, d):
    return traj(spark, d).select("traj_id").join(view(spark, d, "fx_gt").select("traj_id", "box_idx"), "traj_id")


@query("selfjoin_pairs", oracle("SELECT a.traj_id, count(*) AS pairs FROM fx_calls a JOIN fx_calls b ON a.traj_id = b.traj_id AND a.step < b.step GROUP BY 1"))
def selfjoin_pairs(spark, d):
    """Pairs inside one trajectory (a bounded number of calls): made inside the row, without a self join."""
    pairs = F.flatten(F.transform("tool_calls", lambda b, j: F.transform(F.slice("tool_calls", F.lit(1), j), lambda a: F.struct(a["step"].alias("i"), b["step"].alias("j")))))
    return trajectories(spark, d).select("traj_id", F.size(pairs).cast("long").alias("pairs")).where("pairs > 0")


@query("anti_existing", oracle("SELECT traj_id FROM fx_traj WHERE uid NOT IN (SELECT uid FROM fx_score_map)"))
def anti_existing(spark, d):
    return traj(spark, d).join(view(spark, d, "fx_score_map"), "uid", "left_anti").select("traj_id")


@query("anti_processed", oracle("SELECT traj_id, uid IN (SELECT uid FROM fx_score_map) AS done FROM fx_traj"))
def anti_processed(spark, d):
    t, m = traj(spark, d), view(spark, d, "fx_score_map").select("uid")
    done = t.join(m, "uid", "left_semi").select("traj_id", F.lit(True).alias("done"))
    return done.unionByName(t.join(m, "uid", "left_anti").select("traj_id", F.lit(False).alias("done")))


@query("concat_stages", oracle("SELECT ordinal, row_number() OVER (ORDER BY md5(concat('9-', ordinal)), ordinal) - 1 AS pos FROM fx_stage"))
def concat_stages(spark, d):
    s = view(spark, d, "fx_stage").select("ordinal", "stage")
    both = s.where("stage = 'stage1'").unionByName(s.where("stage = 'stage2'")).withColumn("o", B.seeded(9, "ordinal"))
    return protocol.with_position(both, "o", "ordinal", name="pos").select("ordinal", "pos")


@query("retry_rounds", oracle("WITH a AS (SELECT uid, traj_id, accuracy, row_number() OVER (PARTITION BY uid ORDER BY traj_id) AS round FROM fx_traj), f AS (SELECT uid, min(round) FILTER (WHERE accuracy > 0 AND round <= 3) AS passed FROM a GROUP BY 1) SELECT uid, coalesce(passed, 0) AS round FROM f"))
def retry_rounds(spark, d):
    """The first attempt of at most three that passes, 0 if none does."""
    from pyspark.sql import Window

    a = traj(spark, d).withColumn("round", F.row_number().over(Window.partitionBy("uid").orderBy("traj_id")))
    return a.groupBy("uid").agg(F.coalesce(F.min(F.when((F.col("accuracy") > 0) & (F.col("round") <= 3), F.col("round"))), F.lit(0)).cast("long").alias("round"))


# --- audits ---------------------------------------------------------------------------------------------------------


@query("audit_calls", oracle("""SELECT traj_id, step, 'unknown_tool' AS reason FROM fx_calls WHERE tool_name = 'select' UNION ALL SELECT traj_id, step, 'no_box' FROM fx_calls WHERE tool_name IN ('crop', 'zoom') AND x1 IS NULL
 UNION ALL SELECT traj_id, step, 'wide_box' FROM fx_calls WHERE tool_name IN ('crop', 'zoom') AND x2 - x1 > 0.4 UNION ALL SELECT traj_id, step, 'late_rotate' FROM fx_calls WHERE tool_name = 'rotate' AND step > 3"""))
def audit_calls(spark, d):
    """One row for each problem of a call; a call can have several."""
    tool, box = F.col("tool_name"), F.col("x1").isNotNull()
    spatial = tool.isin("crop", "zoom")
    problems = F.array(F.when(tool == "select", "unknown_tool"), F.when(spatial & ~box, "no_box"), F.when(spatial & (F.col("x2") - F.col("x1") > 0.4), "wide_box"), F.when((tool == "rotate") & (F.col("step") > 3), "late_rotate"))
    return view(spark, d, "fx_calls").select("traj_id", "step", F.explode(F.array_compact(problems)).alias("reason"))


@query("audit_roundtrip", oracle("SELECT count(*) AS n, bool_and(x1 >= 0 AND x2 <= 1 AND y1 >= 0 AND y2 <= 1) AS boxes_ok, count(*) FILTER (WHERE x2 <= x1) AS empty, count(DISTINCT box_idx) AS kinds FROM fx_gt"))
def audit_roundtrip(spark, d):
    ok = (F.col("x1") >= 0) & (F.col("x2") <= 1) & (F.col("y1") >= 0) & (F.col("y2") <= 1)
    return view(spark, d, "fx_gt").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("boxes_ok"), F.count_if(F.col("x2") <= F.col("x1")).alias("empty"), F.countDistinct("box_idx").alias("kinds"))


@query("audit_gate", oracle("WITH s AS (SELECT step, avg(accuracy) AS acc FROM fx_traj GROUP BY 1) SELECT step, round(acc, 6) AS acc, max(acc) OVER (ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) < 0.55 AS stop FROM s"))
def audit_gate(spark, d):
    """Stop where the last three steps' accuracy stays low: a window over one row a step."""
    from pyspark.sql import Window

    s = traj(spark, d).groupBy("step").agg(F.avg("accuracy").alias("acc"))
    return s.select("step", F.round("acc", 6).alias("acc"), (F.max("acc").over(Window.orderBy("step").rowsBetween(-2, 0)) < 0.55).alias("stop"))


@query("check_report", oracle("SELECT t.traj_id, accuracy, substr(question, 1, 12) AS question, substr(pred, 1, 4) AS pred, string_agg(tool_name, '>' ORDER BY c.step) AS tools FROM fx_traj t JOIN fx_calls c ON t.traj_id = c.traj_id GROUP BY ALL"))
def check_report(spark, d):
    t = trajectories(spark, d).where("size(tool_calls) > 0")
    return t.select("traj_id", "accuracy", F.substring("question", 1, 12).alias("question"), F.substring("pred", 1, 4).alias("pred"), F.array_join(F.transform("tool_calls", lambda c: c["tool_name"]), ">").alias("tools"))


@query("tool_plugin", oracle("SELECT raw_tool, coalesce(CASE raw_tool WHEN 'zoom_in' THEN 'zoom' END, raw_tool) AS tool, raw_tool IN ('crop', 'zoom', 'zoom_in') AS spatial, count(*) AS n FROM fx_calls GROUP BY 1"))
def tool_plugin(spark, d):
    """Calls against the tool dimension with one more tool registered; the dimension is a handful of rows."""
    from ..tools import register, tool_table

    tools = register(tool_table(spark), "select", [])
    names = tools.select(F.explode(F.concat(F.array("name"), "aliases")).alias("raw_tool"), F.col("name").alias("tool"), "spatial")
    calls = view(spark, d, "fx_calls").groupBy("raw_tool").agg(F.count(F.lit(1)).alias("n"))
    return calls.join(F.broadcast(names), "raw_tool").select("raw_tool", "tool", "spatial", "n")

"""Queries on token arrays and long token tables (fx_tokens)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..operators import groups
from ..operators import tokens as T
from ..registry import query


def arrays(spark, d):
    """One row a trajectory with ragged arrays in order of pos."""
    cols = ["mask", "reward", "value_pred", "old_logp", "ref_logp", "logp"]
    t = view(spark, d, "fx_tokens").groupBy("traj_id", "uid").agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("t"))
    return t.select("traj_id", "uid", *[F.col(f"t.{c}").alias(c) for c in cols])


def _per_row(name, sql, column, out="value"):
    @query(name, oracle(sql))
    def run(spark, d):
        return arrays(spark, d).select("traj_id", F.round(column(), 6).alias(out))

    return run


c = F.col
_per_row("masked_sum", "SELECT traj_id, round(sum(reward * mask), 6) AS value FROM fx_tokens GROUP BY 1", lambda: T.masked_sum(c("reward"), c("mask")))
_per_row("masked_mean", "SELECT traj_id, round(sum(reward * mask) / (sum(mask) + 1e-8), 6) AS value FROM fx_tokens GROUP BY 1", lambda: T.masked_mean(c("reward"), c("mask")))
_per_row("masked_var", "WITH m AS (SELECT traj_id, sum(reward * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM fx_tokens GROUP BY 1) SELECT t.traj_id, round(CASE WHEN max(n) > 1 THEN sum((reward - mean) * (reward - mean) * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1) END, 6) AS value FROM fx_tokens t JOIN m ON t.traj_id = m.traj_id GROUP BY 1", lambda: T.masked_var(c("reward"), c("mask")))
_per_row("seq_advantage", "SELECT traj_id, round(CASE WHEN sum(mask) > 0 THEN sum(value_pred * mask) / sum(mask) ELSE 0 END, 6) AS value FROM fx_tokens GROUP BY 1", lambda: F.when(T.add(c("mask")) > 0, T.masked_sum(c("value_pred"), c("mask")) / T.add(c("mask"))).otherwise(0.0))
_per_row("overlong_penalty", "SELECT traj_id, round(least(-(count(*) - (60 - 20)) / 20.0 * 1.5, 0), 6) AS value FROM fx_tokens GROUP BY 1", lambda: T.overlong_penalty(F.size("mask"), 60, 20, 1.5))

_MOMENTS = "mm AS (SELECT sum(mask) AS n, sum({x} * mask) / (sum(mask) + 1e-8) AS mean FROM {t}), vv AS (SELECT sum(({x} - mean) * ({x} - mean) * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM {t}, mm)"


@query("masked_whiten", oracle("WITH " + _MOMENTS.format(x="reward", t="fx_tokens") + " SELECT traj_id, pos, round((reward - mean) / sqrt(var + 1e-8) * mask, 5) AS value FROM fx_tokens, mm, vv"))
def masked_whiten(spark, d):
    return T.whiten_all(view(spark, d, "fx_tokens"), "reward", "mask", "w").select("traj_id", "pos", F.round("w", 5).alias("value"))


@query("adv_rf_baseline", oracle("WITH s AS (SELECT traj_id, uid, sum(reward * mask) AS score FROM fx_tokens GROUP BY 1, 2), cs AS (SELECT traj_id, score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END AS a FROM s WINDOW g AS (PARTITION BY uid)), tt AS (SELECT t.traj_id, pos, mask, a FROM fx_tokens t JOIN cs ON t.traj_id = cs.traj_id), " + _MOMENTS.format(x="a", t="tt") + " SELECT traj_id, pos, round((a - mean) / sqrt(var + 1e-8) * mask, 5) AS adv FROM tt, mm, vv"))
def adv_rf_baseline(spark, d):
    """Centred in the group, laid on the tokens, whitened over all tokens."""
    s = arrays(spark, d).withColumn("score", T.masked_sum(F.col("reward"), F.col("mask")))
    s = s.withColumn("a", groups.centred("score")).select("traj_id", "a", F.posexplode("mask").alias("pos", "mask"))
    return T.whiten_all(s, "a", "mask", "w").select("traj_id", F.col("pos").cast("long").alias("pos"), F.round("w", 5).alias("adv"))


_SUFFIX = "SELECT traj_id, pos, sum(reward) OVER (PARTITION BY traj_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret, mask FROM fx_tokens"


@query("adv_remax", oracle(f"WITH r AS ({_SUFFIX}), b AS (SELECT traj_id, max(reward) AS base FROM fx_tokens GROUP BY 1) SELECT r.traj_id, pos, round((ret - base) * mask, 6) AS adv FROM r JOIN b ON r.traj_id = b.traj_id"))
def adv_remax(spark, d):
    """Return to go less a baseline for the row (here its largest reward, in place of a stored greedy score)."""
    r = arrays(spark, d).select("traj_id", F.array_max("reward").alias("base"), F.posexplode(F.arrays_zip(T.suffix_sums(F.col("reward")).alias("ret"), F.col("mask").alias("mask"))).alias("pos", "z"))
    return r.select("traj_id", F.col("pos").cast("long").alias("pos"), F.round((F.col("z.ret") - F.col("base")) * F.col("z.mask"), 6).alias("adv"))


@query("adv_rfpp", oracle(f"WITH r AS ({_SUFFIX}), " + _MOMENTS.format(x="ret", t="r") + " SELECT traj_id, pos, round((ret - mean) / sqrt(var + 1e-8) * mask, 5) AS adv FROM r, mm, vv"))
def adv_rfpp(spark, d):
    r = arrays(spark, d).select("traj_id", F.posexplode(F.arrays_zip(T.suffix_sums(F.col("reward")).alias("ret"), F.col("mask").alias("mask"))).alias("pos", "z"))
    r = r.select("traj_id", F.col("pos").cast("long").alias("pos"), F.col("z.ret").alias("ret"), F.col("z.mask").alias("mask"))
    return T.whiten_all(r, "ret", "mask", "w").select("traj_id", "pos", F.round("w", 5).alias("adv"))


@query(
    "adv_gae",
    oracle("""WITH RECURSIVE k AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY pos DESC) AS i FROM fx_tokens),
g AS (SELECT traj_id, i, pos, CASE WHEN mask > 0 THEN reward - value_pred ELSE CAST(0 AS DOUBLE) END AS adv, CASE WHEN mask > 0 THEN value_pred ELSE CAST(0 AS DOUBLE) END AS nxt FROM k WHERE i = 1
 UNION ALL SELECT k.traj_id, k.i, k.pos, CASE WHEN mask > 0 THEN reward + 0.99 * nxt - value_pred + 0.99 * 0.95 * adv ELSE adv END, CASE WHEN mask > 0 THEN value_pred ELSE nxt END FROM g JOIN k ON g.traj_id = k.traj_id AND k.i = g.i + 1)
SELECT traj_id, pos, round(adv, 5) AS adv FROM g""").replace("WITH fx_tokens", "WITH RECURSIVE fx_tokens").replace(", RECURSIVE k", ", k"),
)
def adv_gae(spark, d):
    a = arrays(spark, d).select("traj_id", F.posexplode(T.gae(F.col("reward"), F.col("value_pred"), F.col("mask"), 0.99, 0.95)).alias("pos", "adv"))
    return a.select("traj_id", F.col("pos").cast("long").alias("pos"), F.round("adv", 5).alias("adv"))


_KL = {"kl": "logp - ref_logp", "abs": "abs(logp - ref_logp)", "mse": "0.5 * (logp - ref_logp) * (logp - ref_logp)", "low_var_kl": "greatest(-10, least(10, exp(ref_logp - logp) - (ref_logp - logp) - 1))"}


@query("kl_estimate", oracle("SELECT traj_id, " + ", ".join(f"round(sum({e}), 5) AS {k}" for k, e in _KL.items()) + " FROM fx_tokens GROUP BY 1"))
def kl_estimate(spark, d):
    t = view(spark, d, "fx_tokens")
    return t.groupBy("traj_id").agg(*[F.round(F.sum(T.kl_estimate(k, F.col("logp"), F.col("ref_logp"))), 5).alias(k) for k in _KL])


@query("kl_shaped_reward", oracle("WITH k AS (SELECT traj_id, sum((logp - ref_logp) * mask) / (sum(mask) + 1e-8) AS kl, sum(reward - 0.1 * (logp - ref_logp) * mask) AS shaped FROM fx_tokens GROUP BY 1) SELECT round(avg(kl), 6) AS kl, round(avg(shaped), 6) AS shaped FROM k"))
def kl_shaped_reward(spark, d):
    kl = F.zip_with("logp", "ref_logp", lambda a, b: T.kl_estimate("kl", a, b))
    a = arrays(spark, d).withColumn("kl", kl)
    shaped = T.add(F.col("reward")) - 0.1 * T.masked_sum(F.col("kl"), F.col("mask"))
    return a.agg(F.round(F.avg(T.masked_mean(F.col("kl"), F.col("mask"))), 6).alias("kl"), F.round(F.avg(shaped), 6).alias("shaped"))


@query("kl_controller", oracle("WITH s AS (SELECT step, count(*) AS n, avg(accuracy) AS kl FROM fx_traj GROUP BY 1), m AS (SELECT step, ln(1 + greatest(-0.2, least(0.2, kl / 0.5 - 1)) * n / 10000.0) AS f FROM s) SELECT step, round(0.2 * exp(sum(f) OVER (ORDER BY step)), 9) AS beta FROM m"))
def kl_controller(spark, d):
    """One row a step: the running product of the multipliers, as the exponential of a running sum over the few steps."""
    from pyspark.sql import Window

    s = view(spark, d, "fx_traj").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("kl"))
    f = F.log(1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("kl") / 0.5 - 1)) * F.col("n") / 10000.0)
    return s.select("step", F.round(0.2 * F.exp(F.sum(f).over(Window.orderBy("step"))), 9).alias("beta"))


_LOSS = "per AS (SELECT traj_id, sum(value_pred * mask) AS s, sum(mask) AS n, count(*) AS len FROM fx_tokens GROUP BY 1)"
_MODES = {"token-mean": "sum(s) / sum(n)", "seq-mean-token-sum": "avg(s)", "seq-mean-token-mean": "avg(s / (n + 1e-8))", "seq-mean-token-sum-norm": "sum(s) / max(len)"}


def _losses(spark, d, compact):
    from functools import reduce

    t = view(spark, d, "fx_tokens")
    parts = [T.loss_aggregate(t, "value_pred", "mask", "traj_id", m, compact).select(F.lit(m).alias("mode"), F.round("loss", 6).alias("loss")) for m in _MODES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("loss_aggregate", oracle(f"WITH {_LOSS} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, round({e}, 6) AS loss FROM per" for m, e in _MODES.items())))
def loss_aggregate(spark, d):
    return _losses(spark, d, False)


@query("loss_aggregate_compact", oracle(f"WITH {_LOSS} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, round({e if m != 'seq-mean-token-mean' else 'avg(CASE WHEN n > 0 THEN s / n ELSE 0 END)'}, 6) AS loss FROM per" for m, e in _MODES.items())))
def loss_aggregate_compact(spark, d):
    return _losses(spark, d, True)


_PPO = """p AS (SELECT mask, reward - 0.5 AS a, exp(logp - old_logp) AS r, old_logp - logp AS kl FROM fx_tokens),
q AS (SELECT *, -a * r AS l1, -a * greatest(0.8, least(1.2, r)) AS l2, -a * 3.0 AS l3 FROM p)"""


@query("ppo_diagnostics", oracle(f"WITH {_PPO} SELECT round(sum(mask * CASE WHEN a < 0 THEN least(l3, greatest(l1, l2)) ELSE greatest(l1, l2) END) / sum(mask), 5) AS loss, round(sum(mask * CASE WHEN l2 > l1 THEN 1 ELSE 0 END) / sum(mask), 5) AS clipped, round(sum(mask * CASE WHEN greatest(l1, l2) > l3 AND a < 0 THEN 1 ELSE 0 END) / sum(mask), 5) AS lower_clipped, round(sum(mask * kl) / sum(mask), 5) AS kl FROM q"))
def ppo_diagnostics(spark, d):
    t = view(spark, d, "fx_tokens")
    terms = T.ppo_token_terms(F.col("reward") - 0.5, F.col("logp"), F.col("old_logp"))
    return t.agg(*[F.round(F.sum(v * F.col("mask")) / F.sum("mask"), 5).alias(k) for k, v in terms.items()])


@query("value_diagnostics", oracle("WITH v AS (SELECT mask, reward AS ret, greatest(value_pred - 0.1, least(value_pred + 0.1, value_pred + logp)) AS cut, value_pred + logp AS pred FROM fx_tokens) SELECT round(0.5 * sum(mask * greatest((pred - ret) * (pred - ret), (cut - ret) * (cut - ret))) / sum(mask), 5) AS loss, round(sum(mask * CASE WHEN (cut - ret) * (cut - ret) > (pred - ret) * (pred - ret) THEN 1 ELSE 0 END) / sum(mask), 5) AS clipped FROM v"))
def value_diagnostics(spark, d):
    pred, old, ret, m = F.col("value_pred") + F.col("logp"), F.col("value_pred"), F.col("reward"), F.col("mask")
    cut = F.greatest(old - 0.1, F.least(old + 0.1, pred))
    a, b = (pred - ret) * (pred - ret), (cut - ret) * (cut - ret)
    return view(spark, d, "fx_tokens").agg(F.round(0.5 * F.sum(m * F.greatest(a, b)) / F.sum(m), 5).alias("loss"), F.round(F.sum(m * F.when(b > a, 1).otherwise(0)) / F.sum(m), 5).alias("clipped"))


@query("explained_var", oracle("SELECT round(1 - var_samp(reward - value_pred) / (var_samp(reward) + 1e-5), 6) AS explained FROM fx_tokens WHERE mask = 1"))
def explained_var(spark, d):
    t = view(spark, d, "fx_tokens").where("mask = 1")
    return t.agg(F.round(1 - F.var_samp(F.col("reward") - F.col("value_pred")) / (F.var_samp("reward") + 1e-5), 6).alias("explained"))


@query("lengths", oracle("SELECT traj_id, count(*) AS total, CAST(sum(mask) AS BIGINT) AS response_length, CAST(count(*) - sum(mask) AS BIGINT) AS obs_length FROM fx_tokens GROUP BY 1"))
def lengths(spark, d):
    n, on = F.size("mask").cast("long"), T.add(F.col("mask")).cast("long")
    return arrays(spark, d).select("traj_id", n.alias("total"), on.alias("response_length"), (n - on).alias("obs_length"))


@query("response_mask", oracle("SELECT traj_id, pos - 2 AS pos, CAST(CASE WHEN uid % 2 = 0 THEN mask ELSE 1 END AS DOUBLE) AS mask FROM fx_tokens WHERE pos >= 2"))
def response_mask(spark, d):
    """The action mask where there is one (here: for even prompts), else the attention mask, without the prompt's places."""
    action = F.when(F.col("uid") % 2 == 0, F.col("mask"))
    attention = F.transform("mask", lambda _: F.lit(1.0))
    m = F.slice(F.coalesce(action, attention), F.lit(3), F.greatest(F.size("mask") - 2, F.lit(0)))
    return arrays(spark, d).select("traj_id", F.posexplode(m).alias("pos", "mask")).withColumn("pos", F.col("pos").cast("long"))


def _ids(spark, d):
    return arrays(spark, d).select("traj_id", F.transform("mask", lambda m, i: (m * 5 + i % 7).cast("long")).alias("ids"), "mask")


_IDS = "i AS (SELECT traj_id, pos, mask, CAST(mask * 5 + pos % 7 AS BIGINT) AS id FROM fx_tokens)"


@query("eos_mask", oracle(f"WITH {_IDS}, f AS (SELECT traj_id, min(pos) AS e FROM i WHERE id = 8 GROUP BY 1) SELECT i.traj_id, pos, CASE WHEN e IS NULL OR pos <= e THEN 1 ELSE 0 END AS m FROM i LEFT JOIN f ON i.traj_id = f.traj_id"))
def eos_mask(spark, d):
    m = _ids(spark, d).select("traj_id", F.posexplode(T.eos_mask(F.col("ids"), 8)).alias("pos", "m"))
    return m.withColumn("pos", F.col("pos").cast("long"))


@query("pad_mask", oracle(f"WITH {_IDS} SELECT traj_id, pos, CASE WHEN id IN (0, 11) THEN 0 ELSE 1 END AS m FROM i"))
def pad_mask(spark, d):
    m = _ids(spark, d).select("traj_id", F.posexplode(T.pad_mask(F.col("ids"), [0, 11])).alias("pos", "m"))
    return m.withColumn("pos", F.col("pos").cast("long"))


@query("position_ids", oracle("SELECT traj_id, pos, CAST(greatest(0, sum(mask) OVER (PARTITION BY traj_id ORDER BY pos) - 1) AS INTEGER) AS p FROM fx_tokens"))
def position_ids(spark, d):
    m = arrays(spark, d).select("traj_id", F.posexplode(T.position_ids(F.col("mask"))).alias("pos", "p"))
    return m.withColumn("pos", F.col("pos").cast("long"))


@query("pad_truncate", oracle(f"WITH {_IDS}, l AS (SELECT traj_id, list(id ORDER BY pos) AS ids FROM i GROUP BY 1) SELECT traj_id, list_resize(ids[1:12], 12, 0) AS right_cut, list_concat(list_resize([]::BIGINT[], greatest(0, 40 - len(ids)), 0), ids[greatest(1, len(ids) - 39):]) AS left_cut FROM l"))
def pad_truncate(spark, d):
    return _ids(spark, d).select("traj_id", T.pad_truncate(F.col("ids"), 12, 0).alias("right_cut"), T.pad_truncate(F.col("ids"), 40, 0, left=True, cut="left").alias("left_cut"))


@query("unpad_ids", oracle(f"WITH {_IDS}, l AS (SELECT traj_id, list(id ORDER BY pos) AS ids, CAST(sum(mask) AS BIGINT) AS n FROM i GROUP BY 1) SELECT traj_id, ids[len(ids) - n + 1:] AS ids FROM l"))
def unpad_ids(spark, d):
    return _ids(spark, d).select("traj_id", T.unpad_left(F.col("ids"), F.col("mask")).alias("ids"))


@query("sft_loss_mask", oracle("SELECT traj_id, pos, CASE WHEN pos < 4 OR pos = max(pos) OVER (PARTITION BY traj_id) THEN 0 ELSE 1 END AS m FROM fx_tokens"))
def sft_loss_mask(spark, d):
    m = arrays(spark, d).select("traj_id", F.posexplode(T.sft_loss_mask(F.size("mask"), F.lit(5))).alias("pos", "m"))
    return m.withColumn("pos", F.col("pos").cast("long"))


@query("sparse_to_last", oracle("SELECT traj_id, pos, CASE WHEN pos = max(pos) OVER w THEN round(sum(reward) OVER w, 6) ELSE 0 END AS r FROM fx_tokens WINDOW w AS (PARTITION BY traj_id)"))
def sparse_to_last(spark, d):
    m = arrays(spark, d).select("traj_id", F.posexplode(T.sparse_to_last(F.round(T.add(F.col("reward")), 6), F.size("mask"))).alias("pos", "r"))
    return m.withColumn("pos", F.col("pos").cast("long"))


@query("env_reward_if_right", oracle("SELECT traj_id, round(sum(reward + CASE WHEN traj_id % 2 = 0 THEN value_pred ELSE 0 END), 6) AS r FROM fx_tokens GROUP BY 1"))
def env_reward_if_right(spark, d):
    """The environment's per-token reward (here: value_pred) counts only where the answer is right (here: even ids)."""
    both = F.when(F.col("traj_id") % 2 == 0, F.zip_with("reward", "value_pred", lambda a, b: a + b)).otherwise(F.col("reward"))
    return arrays(spark, d).select("traj_id", F.round(T.add(both), 6).alias("r"))


@query("timeout_to_zero", oracle("SELECT traj_id, CASE WHEN status = 'error' THEN 0 ELSE accuracy END AS score FROM fx_traj"))
def timeout_to_zero(spark, d):
    t = view(spark, d, "fx_traj").withColumn("raw", F.when(F.col("status") != "error", F.col("accuracy").cast("string")).otherwise("timeout"))
    return t.select("traj_id", F.coalesce(F.col("raw").try_cast("double"), F.lit(0.0)).alias("score"))


@query("multiturn_loss_mask", "SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '[^ ]+'))) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '[^ ]+')) ELSE 0 END) AS BIGINT) AS trained FROM conversations GROUP BY 1")
def multiturn_loss_mask(spark, d):
    """Tokens of a conversation in turn order, 1 on the assistant's; here counted."""
    from ..fixtures import table

    n = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", n.alias("n")))).alias("m"))
    mask = F.flatten(F.transform("m", lambda x: F.array_repeat(F.when(x["role"] == "assistant", 1).otherwise(0), x["n"])))
    return t.select("conv_id", F.size(mask).cast("long").alias("tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("trained"))


@query("pref_pair_tokens", oracle("SELECT id, string_split(concat(prompt, ' ', chosen), ' ')[1:16] AS chosen, string_split(concat(prompt, ' ', rejected), ' ')[1:16] AS rejected FROM fx_pairs"))
def pref_pair_tokens(spark, d):
    p = view(spark, d, "fx_pairs")
    toks = lambda c: F.slice(F.split(F.concat("prompt", F.lit(" "), c), " "), 1, 16)
    return p.select("id", toks("chosen").alias("chosen"), toks("rejected").alias("rejected"))


#: Where the public vocabularies are on this machine.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("subword_lengths")
def subword_lengths(spark, d, ranks: str = RANKS):
    """Prompts of at most 12,000 subwords (flt_overlong_prompt with a real tokeniser): every document's length and verdict."""
    from ..fixtures import table
    from ..functions.tokenizers import with_subwords

    docs = with_subwords(table(spark, d, "documents").select("doc_id", "text"), {"text": "ids"}, ranks)
    return docs.select("doc_id", F.size("ids").cast("long").alias("tokens"), (F.size("ids") <= 12_000).alias("kept"))


@query("subword_loss_mask")
def subword_loss_mask(spark, d, ranks: str = RANKS):
    """Tokens of each conversation in turn order with 1 on the assistant's (multiturn_loss_mask with a real tokeniser)."""
    from ..fixtures import table
    from ..functions.tokenizers import with_subwords

    turns = with_subwords(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), {"text": "ids"}, ranks)
    t = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "ids"))).alias("m"))
    mask = F.flatten(F.transform("m", lambda x: F.array_repeat(F.when(x["role"] == "assistant", 1).otherwise(0), F.size(x["ids"]))))
    return t.select("conv_id", F.flatten("m.ids").alias("ids"), mask.alias("mask"))


@query("subword_pairs")
def subword_pairs(spark, d, ranks: str = RANKS):
    """Preference pairs as token ids, the prompt before either answer (pref_pair_tokens with a real tokeniser)."""
    from ..functions.tokenizers import with_subwords

    p = view(spark, d, "fx_pairs").select("id", F.concat("prompt", F.lit(" "), "chosen").alias("c"), F.concat("prompt", F.lit(" "), "rejected").alias("r"))
    return with_subwords(p, {"c": "chosen", "r": "rejected"}, ranks).select("id", "chosen", "rejected")

"""Token-level operators on ragged arrays (one row a trajectory) - narrow transformations without a shuffle - and the
whitening that needs global moments (one aggregation, broadcast as one row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def masked_sum(x: Column, m: Column) -> Column:
    return add(F.zip_with(x, m, lambda v, w: v * w))


def masked_mean(x: Column, m: Column) -> Column:
    return masked_sum(x, m) / (add(m) + 1e-8)


def masked_var(x: Column, m: Column) -> Column:
    """Bessel-corrected variance over the mask; null where the mask's sum is 1 or less."""
    n, mean = add(m), masked_mean(x, m)
    var = F.aggregate(F.zip_with(x, m, lambda v, w: F.struct(v.alias("v"), w.alias("w"))), F.lit(0.0), lambda a, p: a + (p["v"] - mean) * (p["v"] - mean) * p["w"]) / (n + 1e-8)
    return F.when(n > 1, var * n / (n - 1))


def whiten_all(df: DataFrame, value: str, mask: str, out: str) -> DataFrame:
    """df (one row a token) with (x - mean) / sqrt(var + 1e-8) over all masked tokens, 0 outside the mask."""
    x, m = F.col(value), F.col(mask)
    s = df.agg(F.sum(m).alias("_n"), F.sum(x * m).alias("_s"), F.sum(x * x * m).alias("_q"))
    mean = F.col("_s") / (F.col("_n") + 1e-8)
    var = (F.col("_q") - 2 * mean * F.col("_s") + mean * mean * F.col("_n")) / (F.col("_n") + 1e-8) * F.col("_n") / (F.col("_n") - 1)
    # one row joins every row
    return df.crossJoin(F.broadcast(s)).withColumn(out, (x - mean) / F.sqrt(var + 1e-8) * m).drop("_n", "_s", "_q")


def kl_estimate(kind: str, logp: Column, ref: Column) -> Column:
    """Per-token estimate; low_var_kl is clamped to 10 either way."""
    if kind == "kl":
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind == "mse":
        return 0.5 * (logp - ref) * (logp - ref)
    if kind == "low_var_kl":
        d = ref - logp
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(d) - d - 1))
    raise ValueError(f"unknown estimate {kind!r}")


def suffix_sums(x: Column, gamma: float = 1.0) -> Column:
    """Discounted return to go of every place: a fold from the right."""
    back = F.aggregate(F.reverse(x), F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(v + gamma * F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0.0)))))
    return F.reverse(back)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages; places outside the mask are skipped: they neither move the carried advantage nor the next
    value, and take the carried advantage as theirs."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, t):
        fresh = t["r"] + gamma * acc["next"] - t["v"] + gamma * lam * acc["last"]
        last = F.when(t["m"] > 0, fresh).otherwise(acc["last"])
        nxt = F.when(t["m"] > 0, t["v"]).otherwise(acc["next"])
        return F.struct(nxt.alias("next"), last.alias("last"), F.concat(acc["out"], F.array(last)).alias("out"))

    return F.reverse(F.aggregate(steps, start, step)["out"])


def sparse_to_last(score: Column, n: Column) -> Column:
    """An array of n zeros whose last place holds the score."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == n, score).otherwise(0.0))


def eos_mask(ids: Column, eos: int) -> Column:
    """1 up to and including the first end token."""
    at = F.array_position(ids, F.lit(eos))
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def pad_mask(ids: Column, pads: list[int]) -> Column:
    return F.transform(ids, lambda x: F.when(x.isin(pads), 0).otherwise(1))


def position_ids(mask: Column) -> Column:
    """Running sum of the mask less 1, at least 0."""
    return F.transform(mask, lambda _, i: F.greatest(F.lit(0), F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x.cast("int")) - 1))


def pad_truncate(ids: Column, most: int, pad: int, left: bool = False, cut: str = "right") -> Column:
    """Exactly `most` ids: padded left or right; longer ones cut at the named side, or an error."""
    n = F.size(ids)
    fill = F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(0), F.lit(most) - n))
    if cut == "error":
        ids = F.when(n > most, F.raise_error(F.lit("sequence too long")).cast("array<bigint>")).otherwise(ids)
    kept = F.slice(ids, F.greatest(F.lit(1), n - most + 1) if cut == "left" else F.lit(1), F.least(n, F.lit(most)))
    return F.concat(fill, kept) if left else F.concat(kept, fill)


def unpad_left(ids: Column, mask: Column) -> Column:
    """Without the leading pads: as many ids from the right as the mask counts."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.slice(ids, F.size(ids) - n + 1, n)


def sft_loss_mask(n: Column, prompt: Column) -> Column:
    """0 on the prompt but for its last token, and on the last response token."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i < prompt - 1) | (i == n - 1), 0).otherwise(1))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def ppo_token_terms(adv: Column, logp: Column, old: Column, clip: float = 0.2, clip_c: float = 3.0) -> dict[str, Column]:
    """Per-token dual-clip loss and what it did: loss, clipped, lower_clipped, kl."""
    kl = old - logp
    ratio = F.exp(-kl)
    plain, cut = -adv * ratio, -adv * F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
    high, low = F.greatest(plain, cut), -adv * clip_c
    loss = F.when(adv < 0, F.least(low, high)).otherwise(high)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {"loss": loss, "clipped": flag(cut > plain), "lower_clipped": flag((high > low) & (adv < 0)), "kl": kl}


def loss_aggregate(df: DataFrame, value: str, mask: str, row: str, mode: str, compact: bool = False) -> Column | DataFrame:
    """One row with the aggregate of per-token values: token-mean, seq-mean-token-sum, seq-mean-token-mean or
    seq-mean-token-sum-norm (over the longest row)."""
    x, m = F.col(value), F.col(mask)
    per = df.groupBy(row).agg(F.sum(x * m).alias("s"), F.sum(m).alias("n"), F.count(F.lit(1)).alias("len"))
    if mode == "token-mean":
        return per.agg((F.sum("s") / F.sum("n")).alias("loss"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0) if compact else F.col("s") / (F.col("n") + 1e-8)).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per.agg((F.sum("s") / F.max("len")).alias("loss"))
    raise ValueError(f"unknown mode {mode!r}")

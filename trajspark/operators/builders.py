"""Training-table builders: narrow projections from raw rows to prompt, preference and message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batching import first_per_key, seeded
from .protocol import with_position


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def rl_prompt(df: DataFrame, source: str, ability: str, prompt: Column, truth: Column, extra: dict[str, Column], style: str = "rule") -> DataFrame:
    """The prompt table: data_source, ability, prompt messages, reward model and extra_info."""
    info = F.struct(*[v.alias(k) for k, v in extra.items()])
    return df.select(F.lit(source).alias("data_source"), F.lit(ability).alias("ability"), F.array(message("user", prompt)).alias("prompt"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), info.alias("extra_info"))


def pref_sft(pairs: DataFrame) -> DataFrame:
    """Two (prompt, response) rows a pair, chosen first."""
    both = F.posexplode(F.array("chosen", "rejected")).alias("rank", "response")
    return pairs.select("id", "prompt", both)


def pref_rm(pairs: DataFrame, key: str, share: float = 0.75) -> DataFrame:
    """pairs with split: the first share of the rows trains, the rest tests."""
    cut = int(pairs.count() * share)
    return with_position(pairs, key).withColumn("split", F.when(F.col("row_idx") < cut, "train").otherwise("test")).drop("row_idx")


def conversations(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row a conversation with its messages in turn order."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def search_train(stages: DataFrame, system: str) -> DataFrame:
    """Prompts of both stages, each once (the first stage's first row wins), with system and user messages."""
    first = first_per_key(stages, ["question"], ["stage", "ordinal"])
    return first.select("ordinal", "stage", F.array(message("system", F.lit(system)), message("user", F.col("question"))).alias("prompt"), F.col("answer").alias("ground_truth"))


def sft_messages(traj: DataFrame, system: str) -> DataFrame:
    """traj_id and messages: system, user, then each call and its response, then the answer; parts are always lists."""
    part = lambda t: F.array(F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit(None).cast("string").alias("image")))
    msg = lambda r, t: F.struct(F.lit(r).alias("role"), part(t).alias("parts"))
    call = lambda c: F.concat(F.lit("<tool_call>"), F.to_json(F.struct(c["tool_name"].alias("name"), c["bbox"].alias("bbox_2d"))), F.lit("</tool_call>"))
    turns = F.flatten(F.transform("tool_calls", lambda c: F.array(msg("assistant", call(c)), msg("tool", c["output"]))))
    answer = F.concat(F.lit("<answer>"), F.col("pred"), F.lit("</answer>"))
    return traj.select("traj_id", F.concat(F.array(msg("system", F.lit(system)), msg("user", F.col("question"))), turns, F.array(msg("assistant", answer))).alias("messages"))


def sft_split(df: DataFrame, key: str, seed: int, share: float = 0.1) -> DataFrame:
    """df with split: a share of the rows (at least one) in hash order is val."""
    n = max(1, int(df.count() * share))
    placed = with_position(df.withColumn("_o", seeded(seed, key)), "_o", key, name="_at").drop("_o")
    return placed.withColumn("split", F.when(F.col("_at") < n, "val").otherwise("train")).drop("_at")


def pivot_samples(df: DataFrame, row: str, sample: str, value: str) -> DataFrame:
    """One list of values a row, in order of the sample number."""
    g = df.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(sample, value))).alias("_s"))
    return g.select(row, F.col(f"_s.{value}").alias("responses"))

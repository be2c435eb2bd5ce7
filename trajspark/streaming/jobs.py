"""Structured Streaming jobs over files of attempts as they arrive. Every job takes and returns streaming DataFrames, or
starts a query on a checkpointed sink; the scoring code is the batch code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reward as R

#: Terminal reasons of a turn, in order of precedence, as conditions over the running state of the turn log.
OVER_LENGTH, ERROR, DONE, MAX_TURNS, MAX_IMAGES = "OVER_LENGTH", "ERROR_IN_ACTION", "DONE", "EXCEED_MAX_TURNS", "EXCEED_MAX_IMAGE_NUM_32"


def read_stream(spark: SparkSession, path: str, schema, files: int = 4, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; progress is in the checkpoint, so a rerun goes on where this one ended."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def score(attempts: DataFrame, config=R.RewardConfig()) -> DataFrame:
    """Narrow: rewards of each attempt as it arrives."""
    return R.with_scores(attempts, config).withColumn("reward", R.reward_column(config))


def dedupe(attempts: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time the state of a key goes when the watermark passes."""
    return attempts.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else attempts.dropDuplicates([key])


def step_metrics(attempts: DataFrame, metrics: dict) -> DataFrame:
    """Running metrics of each step, for update or complete mode."""
    return attempts.groupBy("step").agg(*[v.alias(k) for k, v in metrics.items()])


def windowed_metrics(events: DataFrame, time: str, width: str, delay: str, by: list[str], metrics: dict) -> DataFrame:
    """Metrics of tumbling windows; a window is final when the watermark passes its end."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(*[v.alias(k) for k, v in metrics.items()])


def end_reasons(turns: DataFrame, max_tokens: int = 4000, max_turns: int = 50, max_images: int = 32) -> DataFrame:
    """Batch form over a turn log: traj_id, end_reason, turns, tool_calls at the first turn that ends the trajectory. A turn
    that ends it does not raise the tool count."""
    from pyspark.sql import Window

    w = Window.partitionBy("traj_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = turns.withColumns({"_tokens": F.sum("n_tokens").over(w), "_images": F.sum("n_images").over(w)})
    reason = F.when(F.col("_tokens") > max_tokens, OVER_LENGTH).when(F.col("is_error"), ERROR).when(F.col("done"), DONE).when(F.col("turn") + 1 >= max_turns, MAX_TURNS).when(F.col("_images") >= max_images, MAX_IMAGES)
    ended = t.withColumn("_r", reason)
    first = ended.groupBy("traj_id").agg(F.min(F.when(F.col("_r").isNotNull(), F.struct("turn", "_r"))).alias("_e"), F.count(F.lit(1)).alias("_n"))
    return first.select("traj_id", F.coalesce("_e._r", F.lit("ON_GOING")).alias("end_reason"), F.coalesce(F.col("_e.turn") + 1, "_n").alias("turns"), F.coalesce("_e.turn", "_n").alias("tool_calls"))

"""Keyed state with event-time timers: every key's state ends, by completion or by the watermark."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import DONE, ERROR, MAX_IMAGES, MAX_TURNS, OVER_LENGTH

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState keeps its state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _advantages(scores: list[float]) -> list[float]:
    """Score minus mean over the sample std; a lone attempt keeps its score."""
    n = len(scores)
    mean = sum(scores) / n if n > 1 else 0.0
    std = (sum((s - mean) ** 2 for s in scores) / (n - 1)) ** 0.5 if n > 1 else 1.0
    return [(s - mean) / (std + 1e-6) for s in scores]


class WaitForGroups(StatefulProcessor):
    """Holds the attempts of each prompt of a bucket until n are there or timeout_ms have passed in event time since the prompt's first.
    At most n - 1 attempts a prompt are in state. A bucket's attempts are read and put back in one go and its timer is that of its
    oldest group, so that calls to the state store grow with buckets, not with prompts."""

    OUT = "uid long, traj_id long, n int, complete boolean, advantage double"

    def __init__(self, n: int, timeout_ms: int):
        self.n, self.timeout_ms = n, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "uid long, ts long, traj_id long, score double")

    def _held(self) -> dict[int, list[tuple]]:
        """The open group of each prompt."""
        groups: dict[int, list[tuple]] = {}
        for uid, *row in self.rows.get() if self.rows.exists() else ():
            groups.setdefault(uid, []).append(tuple(row))
        return groups

    def _hold(self, groups: dict[int, list[tuple]], timer: int | None) -> None:
        """Puts the open groups back; timer: the one that is set."""
        due = min((g[0][0] for g in groups.values()), default=None)
        due = None if due is None else due + self.timeout_ms + 1
        if groups:
            self.rows.put([(uid, *row) for uid, g in groups.items() for row in g])
        elif timer is not None:
            self.rows.clear()
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)

    def _timer(self, groups: dict[int, list[tuple]]) -> int | None:
        return min(g[0][0] for g in groups.values()) + self.timeout_ms + 1 if groups else None

    def _rows(self, done: list[tuple[int, list[tuple]]]) -> pd.DataFrame:
        out = [(uid, row[1], len(g), len(g) == self.n, a) for uid, g in done for row, a in zip(g, _advantages([s for *_, s in g]))]
        return pd.DataFrame(out, columns=["uid", "traj_id", "n", "complete", "advantage"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        groups = self._held()
        timer, done, new = self._timer(groups), [], []
        for b in rows:
            ms = b["ts"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            new += zip(ms, b["traj_id"].tolist(), b["score"].tolist(), b["uid"].tolist())
        new.sort()
        for *row, uid in new:
            group = groups.setdefault(uid, [])
            if group and row[0] > group[0][0] + self.timeout_ms:
                done.append((uid, group))
                group = groups[uid] = []
            group.append(tuple(row))
            if len(group) == self.n:
                done.append((uid, groups.pop(uid)))
        self._hold(groups, timer)
        if done:
            yield self._rows(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        groups, now = self._held(), timerValues.getCurrentWatermarkInMs()
        done = [(uid, g) for uid, g in groups.items() if g[0][0] + self.timeout_ms + 1 <= now]
        # the timer that fired goes by itself
        left = {uid: g for uid, g in groups.items() if g[0][0] + self.timeout_ms + 1 > now}
        self.rows.clear()
        self._hold(left, None)
        if done:
            yield self._rows(done)

    def close(self) -> None:
        pass


class FoldTurns(StatefulProcessor):
    """Folds the turns of a trajectory in their order, whatever order they come in: early ones wait in a map by number. State goes
    at the turn that ends the trajectory, or when idle_ms pass in event time after its latest turn (then nothing is emitted).
    Turns that come after the end wait for a first turn that will not come, and go with the timer."""

    OUT = "traj_id long, end_reason string, tool_calls long"

    def __init__(self, idle_ms: int, max_tokens: int = 4000, max_turns: int = 50, max_images: int = 32):
        self.idle_ms, self.max_tokens, self.max_turns, self.max_images = idle_ms, max_tokens, max_turns, max_images

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sofar = handle.getValueState("sofar", "next long, tokens long, images long, latest long")
        self.waiting = handle.getMapState("waiting", "turn long", "tokens long, images long, error boolean, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, tokens, images, latest = self.sofar.get() if self.sofar.exists() else (0, 0, 0, 0)
        timer = latest + self.idle_ms if latest else None
        for b in rows:
            for r in b.itertuples():
                latest = max(latest, _ms(r.ts))
                if r.turn >= turn:
                    self.waiting.updateValue((int(r.turn),), (int(r.n_tokens), int(r.n_images), bool(r.is_error), bool(r.done)))
        reason = None
        while reason is None and self.waiting.exists() and self.waiting.containsKey((turn,)):
            more, pictures, error, done = self.waiting.getValue((turn,))
            self.waiting.removeKey((turn,))
            tokens, images = tokens + more, images + pictures
            reason = OVER_LENGTH if tokens > self.max_tokens else ERROR if error else DONE if done else MAX_TURNS if turn + 1 >= self.max_turns else MAX_IMAGES if images >= self.max_images else None
            turn += reason is None
        moved = reason or latest + self.idle_ms != timer
        if timer is not None and moved:
            self.handle.deleteTimer(timer)
        if reason:
            self.sofar.clear()
            self.waiting.clear()
            yield pd.DataFrame({"traj_id": [key[0]], "end_reason": pd.Series([reason], dtype=object), "tool_calls": [turn]})
        else:
            self.sofar.update((turn, tokens, images, latest))
            if moved:
                self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sofar.clear()
        self.waiting.clear()
        yield from ()

    def close(self) -> None:
        pass


def wait_for_groups(attempts: DataFrame, n: int, timeout_ms: int, delay: str, buckets: int = 1024) -> DataFrame:
    """A row for each attempt (uid, traj_id, ts, score) when its group is complete or timed out. delay: how late rows may come.
    Prompts are dealt to buckets by their hash, a key of the state each; the number stays the same over restarts from a checkpoint."""
    rows = attempts.withWatermark("ts", delay).select(F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket"), "uid", "traj_id", "ts", F.col("score").cast("double").alias("score"))
    return rows.groupBy("bucket").transformWithStateInPandas(WaitForGroups(n, timeout_ms), WaitForGroups.OUT, "Append", "eventTime")


def fold_turns(turns: DataFrame, idle_ms: int, delay: str, **limits) -> DataFrame:
    """traj_id, end_reason, tool_calls of every trajectory that ends, from turns (traj_id, turn, ts, ...) in any order."""
    return turns.withWatermark("ts", delay).groupBy("traj_id").transformWithStateInPandas(FoldTurns(idle_ms, **limits), FoldTurns.OUT, "Append", "eventTime")


def accumulate(source: DataFrame, keep: Callable[[DataFrame], DataFrame], target: int, path: str, checkpoint: str) -> int:
    """Kept rows are written batch by batch below path until the target is there, then the query stops itself. Gives the count.

    Each batch writes its rows (path/rows/batch=N) and then one counter row (path/counts/batch=N), replacing what a failed try of the same
    batch left, so a replay changes nothing. What is there is the sum of the counters of earlier batches; rows are not counted again.
    """
    spark, full = source.sparkSession, threading.Event()
    counts = f"{path}/counts"
    spark.createDataFrame([], "n long, batch long").write.mode("append").partitionBy("batch").parquet(counts)

    def before(number: int | None) -> int:
        c = spark.read.schema("n long, batch long").parquet(counts)
        return c.where(F.col("batch") < number if number is not None else F.lit(True)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def replace(df: DataFrame, to: str, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)

    def add(batch: DataFrame, number: int) -> None:
        have = before(number)
        if have >= target:
            full.set()
            return
        counted = Observation()
        replace(keep(batch).observe(counted, F.count(F.lit(1)).alias("n")), f"{path}/rows", number)
        n = counted.get["n"]
        replace(spark.createDataFrame([(n,)], "n long"), counts, number)
        if have + n >= target:
            full.set()

    query = source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(1):
        if full.is_set():
            query.stop()
    return before(None)


def step_sketches(attempts: DataFrame, components: list[str], distinct: str, value: str, path: str, checkpoint: str) -> None:
    """For each batch and step one row of partial states: count, extremes of the components, a HyperLogLog sketch of `distinct`
    and a KLL sketch of `value`. Rows of a repeated batch replace each other."""
    ends = [f(c).alias(f"{name}_{c}") for c in components for name, f in (("min", F.min), ("max", F.max))]

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("step").agg(F.count(F.lit(1)).alias("n"), *ends, F.hll_sketch_agg(distinct).alias("hll"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("kll"))
        part.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    attempts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_steps(spark: SparkSession, path: str, components: list[str], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """step, n, distinct, a column a quantile, and dead_<component>: constant over a step of two attempts or more."""
    p = spark.read.parquet(path)
    m = p.groupBy("step").agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"), F.kll_merge_agg_double("kll").alias("kll"),
        *[(F.round(F.max(f"max_{c}"), 9) == F.round(F.min(f"min_{c}"), 9)).alias(f"dead_{c}") for c in components],
    )
    values = [F.kll_sketch_get_quantile_double("kll", F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles]
    return m.select("step", "n", "distinct", *values, *[((F.col("n") >= 2) & F.col(f"dead_{c}")).alias(f"dead_{c}") for c in components])

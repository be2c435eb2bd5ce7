"""Queries on the batch protocol, over fx_traj with its rows in order of traj_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..operators import protocol as P
from ..registry import query

_ROWS = "rows0 AS (SELECT traj_id, uid, data_source, accuracy, trajlength, row_number() OVER (ORDER BY traj_id) - 1 AS row_idx FROM fx_traj)"


def sql(body: str) -> str:
    return oracle(f"WITH {_ROWS}{body if body.startswith(',') else ' ' + body}")


def rows(spark, d):
    t = view(spark, d, "fx_traj").select("traj_id", "uid", "data_source", "accuracy", "trajlength")
    return P.with_position(t, "traj_id")


@query("bp_select", sql("SELECT row_idx, uid FROM rows0"))
def bp_select(spark, d):
    return rows(spark, d).select("row_idx", "uid")


_PICK = "SELECT row_idx AS pos, (row_idx * 7) % (SELECT count(*) FROM rows0) AS idx FROM rows0"


@query("bp_select_idxs", sql(f", pick AS ({_PICK}) SELECT pos AS row_idx, traj_id FROM pick JOIN rows0 ON idx = row_idx"))
def bp_select_idxs(spark, d):
    r = rows(spark, d)
    pick = r.select(F.col("row_idx").alias("pos"), ((F.col("row_idx") * 7) % F.lit(r.count())).alias("idx"))
    return P.select_idxs(r, pick).select("row_idx", "traj_id")


@query("bp_slice", sql("SELECT row_idx, traj_id FROM rows0 WHERE row_idx >= 10 AND row_idx < 500 AND (row_idx - 10) % 3 = 0"))
def bp_slice(spark, d):
    return P.slice_rows(rows(spark, d), 10, 500, 3).select("row_idx", "traj_id")


@query("bp_pop", sql("SELECT row_idx, uid, accuracy FROM rows0"))
def bp_pop(spark, d):
    return P.pop(rows(spark, d), ["uid", "accuracy"])[1]


@query("bp_rename", sql("SELECT row_idx, uid AS prompt_id, accuracy AS acc FROM rows0"))
def bp_rename(spark, d):
    return P.rename(rows(spark, d).select("row_idx", "uid", "accuracy"), ["uid", "accuracy"], ["prompt_id", "acc"])


@query("bp_union", sql("SELECT row_idx, uid, accuracy, trajlength FROM rows0"))
def bp_union(spark, d):
    r = rows(spark, d)
    return P.union_columns(r.select("row_idx", "uid", "accuracy"), r.select("row_idx", "uid", "trajlength"))


@query("bp_concat", sql("SELECT traj_id, accuracy FROM rows0 WHERE accuracy = 1 UNION ALL SELECT traj_id, accuracy FROM rows0"))
def bp_concat(spark, d):
    r = rows(spark, d)
    return P.concat([r.where("accuracy = 1"), r]).select("traj_id", "accuracy")


@query("bp_repeat", sql("SELECT row_idx * 3 + r AS row_idx, traj_id FROM rows0, range(3) t(r)"))
def bp_repeat(spark, d):
    return P.repeat(rows(spark, d), 3).select("row_idx", "traj_id")


@query("bp_repeat_tiled", sql("SELECT row_idx + r * (SELECT count(*) FROM rows0) AS row_idx, traj_id FROM rows0, range(2) t(r)"))
def bp_repeat_tiled(spark, d):
    return P.repeat(rows(spark, d), 2, interleave=False).select("row_idx", "traj_id")


@query("bp_chunk", sql("SELECT CAST(floor(row_idx / ((SELECT count(*) FROM rows0) / 5)) AS BIGINT) AS chunk, count(*) AS n, min(traj_id) AS first FROM rows0 GROUP BY 1"))
def bp_chunk(spark, d):
    return P.chunk(rows(spark, d), 5).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("traj_id").alias("first"))


@query("bp_reorder", sql("SELECT (SELECT count(*) FROM rows0) - 1 - row_idx AS row_idx, traj_id FROM rows0"))
def bp_reorder(spark, d):
    r = rows(spark, d)
    n = r.count()
    return P.reorder(r, r.select((F.lit(n - 1) - F.col("row_idx")).alias("pos"), F.col("row_idx").alias("idx"))).select("row_idx", "traj_id")


@query("bp_pad_to_divisor", sql(", n AS (SELECT count(*) AS n, (64 - count(*) % 64) % 64 AS pad FROM rows0) SELECT row_idx, traj_id, false AS is_pad FROM rows0 UNION ALL SELECT row_idx + n, traj_id, true FROM rows0, n WHERE row_idx < pad"))
def bp_pad_to_divisor(spark, d):
    return P.pad_to_divisor(rows(spark, d), 64).select("row_idx", "traj_id", "is_pad")


@query("bp_unpad", sql("SELECT row_idx, traj_id FROM rows0 WHERE row_idx < (SELECT count(*) FROM rows0) - 17"))
def bp_unpad(spark, d):
    return P.unpad(rows(spark, d), 17).select("row_idx", "traj_id")


@query("bp_fold", sql("SELECT CAST(floor(row_idx / 4) AS BIGINT) AS fold, list(traj_id ORDER BY row_idx) AS traj_id FROM rows0 GROUP BY 1"))
def bp_fold(spark, d):
    return P.fold(rows(spark, d), 4, ["traj_id"])


@query("bp_unfold", sql("SELECT row_idx, traj_id, accuracy FROM rows0"))
def bp_unfold(spark, d):
    return P.unfold(P.fold(rows(spark, d), 4, ["traj_id", "accuracy"]), 4, ["traj_id", "accuracy"])


@query("bp_minibatches", sql(", e AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat('7-', epoch, '-', row_idx)), row_idx) - 1 AS pos0 FROM rows0, range(2) t(epoch)) SELECT CAST(epoch AS INTEGER) AS epoch, CAST(floor(pos0 / 100) AS BIGINT) AS batch_id, count(*) AS n, min(traj_id) AS first FROM e GROUP BY 1, 2"))
def bp_minibatches(spark, d):
    return P.minibatches(rows(spark, d), 100, 2, seed=7).groupBy("epoch", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("traj_id").alias("first"))


@query("bp_collate", sql("SELECT uid, list(traj_id ORDER BY row_idx) AS traj_id, list(accuracy ORDER BY row_idx) AS accuracy FROM rows0 GROUP BY 1"))
def bp_collate(spark, d):
    return P.collate(rows(spark, d), "uid", ["traj_id", "accuracy"])


@query("bp_loader", sql(", o AS (SELECT *, row_number() OVER (ORDER BY md5(concat('3-', row_idx)), row_idx) - 1 AS pos0 FROM rows0) SELECT CAST(floor(pos0 / 64) AS BIGINT) AS batch_id, count(*) AS n, sum(traj_id) AS ids FROM o WHERE floor(pos0 / 64) < floor((SELECT count(*) FROM rows0) / 64) GROUP BY 1"))
def bp_loader(spark, d):
    return P.loader(rows(spark, d), 64, seed=3).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("traj_id").alias("ids"))


@query("bp_loader_val", sql("SELECT CAST(floor(row_idx / 64) AS BIGINT) AS batch_id, count(*) AS n FROM rows0 GROUP BY 1"))
def bp_loader_val(spark, d):
    return P.loader(rows(spark, d), 64, drop_last=False).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("bp_shard", sql(", o AS (SELECT *, row_number() OVER (ORDER BY md5(concat('5-', row_idx)), row_idx) - 1 AS pos0 FROM rows0) SELECT pos0 % 7 AS shard, count(*) AS n, sum(traj_id) AS ids FROM o WHERE pos0 < (SELECT count(*) // 7 * 7 FROM rows0) GROUP BY 1"))
def bp_shard(spark, d):
    return P.shard(rows(spark, d), 7, seed=5).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("traj_id").alias("ids"))


@query("combine_samples", sql("SELECT traj_id, uid, NULL::DOUBLE AS accuracy FROM rows0 WHERE accuracy = 1 UNION ALL SELECT traj_id, NULL, accuracy FROM rows0 WHERE accuracy <> 1"))
def combine_samples(spark, d):
    r = rows(spark, d)
    return P.combine_samples([r.where("accuracy = 1").select("traj_id", "uid"), r.where("accuracy <> 1").select("traj_id", "accuracy")])


@query("reverse_index", sql(", p AS (SELECT row_number() OVER (ORDER BY trajlength, traj_id) - 1 AS pos, row_idx AS idx FROM rows0) SELECT idx AS pos, pos AS idx FROM p"))
def reverse_index(spark, d):
    p = P.with_position(rows(spark, d), "trajlength", "traj_id", name="pos").select("pos", F.col("row_idx").alias("idx"))
    return P.reverse_index(p)

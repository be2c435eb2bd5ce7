"""Filters that keep every row's reason, and the chains that compose them.

A filter is a (name, condition to stay) pair; `tagged` gives each row the first filter that it fails, or "kept", in one
projection. Group statistics must be columns before a chain runs, as a later filter must not change them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import gt_coverage


def tagged(df: DataFrame, filters: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """df with the name of the first filter that a row fails, else "kept". A null condition fails."""
    ladder = None
    for label, stays in filters:
        fails = ~F.coalesce(stays, F.lit(False))
        ladder = F.when(fails, label) if ladder is None else ladder.when(fails, label)
    return df.withColumn(name, F.lit("kept") if ladder is None else ladder.otherwise("kept"))


def split_by_reason(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with reasons)."""
    return df.where("reason = 'kept'").drop("reason"), df.where("reason <> 'kept'")


#: The training chain's order, whatever order its filters are listed in.
TRAIN_ORDER = ["seq_reward", "hasimage", "vtoken", "trajlength", "end_reason", "pos_neg_adv"]


def conditions(max_length: int = 128_000, reserve: tuple[str, ...] = ("DONE",)) -> dict[str, Column]:
    """What each filter lets stay; seq_reward needs the column group_reason, pos_neg_adv needs mean_adv."""
    c = F.col
    return {
        "seq_reward": c("group_reason") == "kept",
        "hasimage": c("has_image"),
        "vtoken": c("vision_consistent"),
        "trajlength": c("trajlength") <= max_length,
        "end_reason": c("end_reason").isin(*reserve),
        "pos_neg_adv": ~((c("accuracy") > 0) & (c("mean_adv") < 0)),
    }


def chain_train(df: DataFrame, wanted: list[str], **how) -> DataFrame:
    known = conditions(**how)
    return tagged(df, [(k, known[k]) for k in TRAIN_ORDER if k in wanted])


def chain_validation(df: DataFrame, wanted: list[str], **how) -> DataFrame:
    """In the listed order; only trajlength and end_reason are known here."""
    known = {k: v for k, v in conditions(**how).items() if k in ("trajlength", "end_reason")}
    return tagged(df, [(k, known[k]) for k in wanted if k in known])


def video_cap(df: DataFrame, batch: str, is_video: Column, order: str, k: int) -> DataFrame:
    """All rows that are no video and the first k videos of each batch."""
    w = Window.partitionBy(batch, "_video").orderBy(order)
    return df.withColumn("_video", is_video).withColumn("_r", F.row_number().over(w)).where(~F.col("_video") | (F.col("_r") <= k)).drop("_video", "_r")


def real_call(tool: Column, output: Column, box: Column) -> Column:
    """Whether a call really ran: a known tool, an output that is no error, and what its kind must leave behind."""
    bad = output.startswith("[Unknown tool") | output.startswith("[Error")
    box_ok = F.coalesce((box[2] > box[0]) & (box[3] > box[1]), F.lit(False))
    return F.when(~tool.isin("crop", "zoom", "rotate", "ocr") | bad, False).when(tool.isin("crop", "zoom"), box_ok).when(tool == "rotate", output.contains("Rotated") & box.isNull()).otherwise(output.contains("OCR result"))


def max_gt_coverage(calls: Column, boxes: Column) -> Column:
    """Best coverage of any box by any call's box, up to and including the first call that changes the view (zoom, rotate);
    boxes over the whole image do not count."""
    changes = lambda c: c["tool_name"].isin("zoom", "rotate")
    early = F.filter(calls, lambda c, i: ~F.exists(F.slice(calls, F.lit(1), i), changes))
    whole = lambda b: (b[0] <= 0) & (b[1] <= 0) & (b[2] >= 1) & (b[3] >= 1)
    used = F.filter(early, lambda c: c["bbox"].isNotNull() & ~whole(c["bbox"]))
    best = lambda c: F.aggregate(boxes, F.lit(0.0), lambda a, g: F.greatest(a, gt_coverage(c["bbox"], g)))
    return F.aggregate(used, F.lit(0.0), lambda a, c: F.greatest(a, best(c)))


def sft_tool(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Reasons status, accuracy, no_tool_calls, unreal_call, gt_coverage; needs tool_calls and coverage."""
    real = F.forall("tool_calls", lambda c: real_call(c["tool_name"], c["output"], c["bbox"]))
    rules = [("status", F.col("status") == "success"), ("accuracy", F.col("accuracy") == 1), ("no_tool_calls", F.size("tool_calls") > 0), ("unreal_call", real), ("gt_coverage", F.col("coverage") >= least)]
    return tagged(df, rules)


def sft_answer_first(df: DataFrame) -> DataFrame:
    return tagged(df, [("status", F.col("status") == "success"), ("accuracy", F.col("accuracy") == 1), ("has_tool_calls", F.size("tool_calls") == 0)])

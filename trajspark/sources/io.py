"""Readers and writers for trajectory files. Schemas are explicit; paths go to Spark as they are, so any store works."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAJECTORY = "image string, question string, options array<string>, ground_truth string, predicted_answer string, accuracy double, tool_calls array<struct<tool_name:string,arguments:string,output:string,bbox:array<double>>>, image_size array<int>, status string"
RL_ROW = "uid string, data_source string, env_name string, prompt array<struct<role:string,content:string>>, mm_hint struct<hint_type:string,hint_path:string>, reward_model struct<style:string,ground_truth:string>, extra_info string, image string"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or in local mode the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and warehouse.split(":")[0] in ("file", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = warehouse + "/_scratch"
    return f"{base.rstrip('/')}/io-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: lineage is cut, and what was computed once stays the same."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_trajectories(spark: SparkSession, paths: str | list[str], schema: str = TRAJECTORY, encodings: tuple[str, ...] = ("UTF-8",)) -> DataFrame:
    """JSON lines with source_file and line text kept where a line cannot be read (_corrupt); blank lines are skipped. Each
    encoding reads its own group of paths."""
    groups = [paths] if len(encodings) == 1 else list(paths)
    out = None
    for group, encoding in zip(groups, encodings):
        full = T.StructType.fromDDL(schema).add("_corrupt", "string")
        df = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").option("encoding", encoding).option("lineSep", "\n").json(group)
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
        out = df if out is None else out.unionByName(df)
    return out


def read_parquets(spark: SparkSession, paths: list[str], merge: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge).parquet(*paths)


_NOTE = "question string, options array<string>, bbox array<array<double>>, target_object array<string>"


def read_annotations(spark: SparkSession, root: str, notes: str = "*/*.json", images: str = "*/*.jpg", parts: str = r"([^/]+)/([^/]+)\.[A-Za-z]+$", orphans: bool = False, packed: bool = False) -> DataFrame:
    """One row an image that has a JSON of the same stem in its folder: test_type, stem, image, and the note's columns. Images are
    only listed, not read. parts: the pattern that gives folder and stem of a path. With orphans, images without a note and notes without
    an image are kept, told apart by status (paired, no_note, no_image).

    Of files by the million each is a row in the driver's listing. packed: notes and images are folders of packs (see write_pack), where
    the listing is a column: nothing of it passes through the driver, and the images' contents are not read either."""
    named = lambda df: df.withColumns({"test_type": F.regexp_extract("_file", parts, 1), "stem": F.regexp_extract("_file", parts, 2)}).drop("_file")
    if packed:
        files = lambda folder: spark.read.schema("path string, content binary").parquet(f"{root}/{folder}")
        noted = files(notes).select(F.from_json(F.col("content").cast("string"), _NOTE).alias("n"), F.col("path").alias("_file")).select("n.*", "_file")
        listed = files(images).select(F.col("path").alias("_file"), F.col("path").alias("image"))
    else:
        # else each of many folders is a task of its own when files are listed
        spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)
        noted = spark.read.schema(_NOTE).option("multiLine", True).json(f"{root}/{notes}").withColumn("_file", F.col("_metadata.file_path"))
        listed = spark.read.format("binaryFile").load(f"{root}/{images}").select(F.col("path").alias("_file"), F.col("path").alias("image"))
    noted = named(noted).withColumn("_noted", F.lit(True))
    both = named(listed).hint("merge").join(noted.hint("merge"), ["test_type", "stem"], "full" if orphans else "inner")
    status = F.when(F.col("image").isNull(), "no_image").when(F.col("_noted").isNull(), "no_note").otherwise("paired")
    return (both.withColumn("status", status) if orphans else both).drop("_noted")


def write_pack(files: DataFrame, path: str) -> None:
    """Small files (path, content) packed: Parquet with a row a file, as many packs as files has partitions."""
    files.select(F.col("path").cast("string"), F.col("content").cast("binary")).write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def dump_rollouts(df: DataFrame, path: str, step: str = "step") -> None:
    """One folder a step, JSON lines; a rerun of a step replaces only that step."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).json(path)


def clean_nested(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """A nested column read again through JSON with a plain schema."""
    return df.withColumn(column, F.from_json(F.to_json(column), ddl))


def with_image(df: DataFrame) -> DataFrame:
    """Rows as JSON text with image = mm_hint.hint_path."""
    return df.withColumn("image", F.col("mm_hint.hint_path")).select(F.to_json(F.struct("*")).alias("json"))

"""User-supplied functions: scorers, reducers, a table function and a data source. Arrow batches throughout."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCORE = "score double, is_answer_right boolean"


def load_function(path: str, name: str, **fixed) -> Callable:
    """A function by file and name, with fixed keyword arguments; the file must be readable where it is loaded."""
    spec = importlib.util.spec_from_file_location("custom_module", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    f = getattr(module, name)
    return lambda *a, **k: f(*a, **(fixed | k))


def scorer(f: Callable) -> Callable[..., Column]:
    """A column function from f(data_source, solution, ground_truth, extra_info) -> number or dict; a failing row scores 0."""

    def one(source, solution, truth, extra):
        try:
            r = f(source, solution, truth, extra)
        except Exception:  # the contract: a scorer's failure is a score of 0, never a failed job
            return 0.0, False
        score = float(r["score"] if isinstance(r, dict) else r)
        return score, bool(r.get("is_answer_right", score > 0)) if isinstance(r, dict) else score > 0

    @F.pandas_udf(SCORE)
    def run(source: pd.Series, solution: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(source, solution, truth, extra)], columns=["score", "is_answer_right"])

    return run


_LOADED: dict[tuple, Callable] = {}


def _shipped(file: str, name: str, fixed: tuple) -> Callable:
    """The function of a shipped file, loaded once in each Python worker."""
    key = (file, name, fixed)
    if key not in _LOADED:
        _LOADED[key] = load_function(SparkFiles.get(file), name, **dict(fixed))
    return _LOADED[key]


def shipped_scorer(spark: SparkSession, path: str, name: str, sql_name: str | None = None, **fixed) -> Callable[..., Column]:
    """A scorer from a file that only the driver sees: the file goes to every executor, its function gets the fixed arguments, and
    SQL can call it by sql_name. The function is looked up here too, so a wrong name fails before any task runs."""
    load_function(path, name)
    spark.sparkContext.addFile(path)
    file, given = os.path.basename(path), tuple(sorted(fixed.items()))
    run = scorer(lambda *row: _shipped(file, name, given)(*row))
    if sql_name:
        spark.udf.register(sql_name, run)
    return run


def batch_scorer(df: DataFrame, f: Callable[[list, list, list], list], out: str = "score") -> DataFrame:
    """df with f over whole columns (data_source, solution, ground_truth) of each Arrow batch."""
    schema = StructType([*df.schema.fields]).add(out, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [float(x) for x in f(list(b["data_source"]), list(b["solution"]), list(b["ground_truth"]))]})

    return df.mapInPandas(run, schema)


def reducers(df: DataFrame, by: str, value: str, functions: dict[str, Callable[[pd.Series], float]]) -> DataFrame:
    """One column a reducer, as grouped-aggregate functions; groups are attempts of one prompt, tens of rows."""
    made = {k: F.pandas_udf("double")(_typed(f)) for k, f in functions.items()}
    return df.groupBy(by).agg(*[m(value).alias(k) for k, m in made.items()])


def _typed(f):
    def run(v: pd.Series) -> float:
        return float(f(v))

    return run


@F.udtf(returnType="step int, tool_name string")
class ParseCalls:
    """SQL table function: the names of a response's calls, for users of SQL; jobs use functions.text.parse_tool_calls."""

    def eval(self, response: str):
        import json
        import re

        k = 0
        for m in re.finditer(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", response or "", re.S):
            try:
                name = json.loads(m[1])["name"]
            except (ValueError, KeyError, TypeError):
                continue
            yield k, str(name).lower()
            k += 1


class RowsSource(DataSource):
    """A custom dataset class as a data source: format "trajectory_rows" reads the Parquet files below option path, a task for
    each row group, column `id` named by option id; a subclass overrides `uid` to make what its rows hold."""

    @classmethod
    def name(cls) -> str:
        return "trajectory_rows"

    def schema(self) -> str:
        return "id long, uid string"

    def uid(self, key: int) -> str:
        return f"u{key // 4}"

    def reader(self, schema) -> DataSourceReader:
        return _RowsReader(self.options["path"], self.options.get("id", "id"), self.uid)


class _RowsReader(DataSourceReader):
    def __init__(self, path: str, column: str, uid: Callable[[int], str]):
        self.path, self.column, self.uid = path, column, uid

    def _files(self):
        from pyarrow import dataset

        return dataset.dataset(self.path, format="parquet").get_fragments()

    def partitions(self):
        return [InputPartition((f.path, g.id)) for f in self._files() for g in f.row_groups]

    def read(self, partition):
        path, group = partition.value
        fragment = next(f for f in self._files() if f.path == path)
        for batch in fragment.subset(row_group_ids=[group]).to_batches(columns=[self.column]):
            for key in batch.column(0).to_pylist():
                yield key, self.uid(key)


def register_all(spark: SparkSession) -> None:
    """The table function and the data source under their names."""
    spark.udtf.register("parse_calls", ParseCalls)
    spark.dataSource.register(RowsSource)

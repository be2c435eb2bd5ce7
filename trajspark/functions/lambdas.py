"""Helpers for expressions inside of higher-order functions, which Spark interprets without sharing common parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once: as the only element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))

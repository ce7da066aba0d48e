"""Parquet sources: one table per file or folder below a directory."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def number_in(text: Column) -> Column:
    """The number in a delivered text, as a double; null where it holds none.

    White space and punctuation around the number mean nothing, a comma is a decimal point, exponents are legal.
    """
    found = F.regexp_extract(F.regexp_replace(text, ",", "."), r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double") + F.lit(0.0)


def folded(name: Column) -> Column:
    """The folded form of a gene name: ASCII letters and digits only, upper-cased; null stays null."""
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", ""))

"""Contracts of the public operators: required columns, argument ranges, cleaned inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(holds: bool, message: str) -> None:
    """Raise ValueError with `message` unless `holds`."""
    if not holds:
        raise ValueError(message)


def one_of(value: str, choices: tuple[str, ...], name: str) -> str:
    check(value in choices, f"{name} must be one of {', '.join(choices)}")
    return value


def require(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with just the named columns, so that others can't clash; ValueError where one is missing."""
    missing = [c for c in columns if c not in df.columns]
    check(not missing, f"missing columns: {', '.join(missing)}")
    return df.select(*[df[c] for c in columns])


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def embedding_contract(df: DataFrame) -> DataFrame:
    """(gene, pos, vec array<double>) without null genes or vectors; without a column pos the genes order themselves."""
    pos = F.col("pos") if "pos" in df.columns else F.col("gene")
    require(df, "gene", "vec")
    return df.select(F.col("gene").cast("string").alias("gene"), pos.alias("pos"), F.col("vec").cast("array<double>").alias("vec")).where("gene is not null and vec is not null")


def membership_contract(df: DataFrame) -> DataFrame:
    """(set_id, gene, gene_pos), each member once at its first place; null ids are left out; without gene_pos the genes order themselves."""
    require(df, "set_id", "gene")
    pos = F.col("gene_pos") if "gene_pos" in df.columns else F.col("gene")
    slim = df.select(F.col("set_id").cast("string").alias("set_id"), F.col("gene").cast("string").alias("gene"), pos.alias("gene_pos")).where("set_id is not null and gene is not null")
    return slim.groupBy("set_id", "gene").agg(F.min("gene_pos").alias("gene_pos"))


def gaussian_contract(df: DataFrame) -> DataFrame:
    """(set_id, mu, var) as doubles; sets without a Gaussian keep nulls."""
    require(df, "set_id", "mu", "var")
    return df.select(F.col("set_id").cast("string").alias("set_id"), F.col("mu").cast("array<double>").alias("mu"), F.col("var").cast("array<double>").alias("var"))


def width(df: DataFrame, column: str) -> int:
    """The length that all arrays of a column share; ValueError where they differ, 0 where there are none."""
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    check(low == high, f"the arrays in {column} differ in length")
    return high or 0

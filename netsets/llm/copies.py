"""Duplicates hidden by formatting differences: bottom-up hashing of nested records.

A record is described as a tree. Leaves are normalised columns; a node hashes its children's digests, an unordered node sorts them
first. Records are grouped by root digest, and the digest is confirmed by a full comparison of the canonical structure, so a
hash collision never merges two records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsets.functions.spread import spread_join
from netsets.session import written


@dataclass(frozen=True)
class Leaf:
    """A normalised column; null is a value of its own (all nulls are alike)."""

    value: Column

    def canonical(self) -> Column:
        return F.coalesce(F.concat(F.lit("="), self.value.cast("string")), F.lit("-"))

    def digest(self) -> Column:
        return F.xxhash64(self.canonical())


@dataclass(frozen=True)
class Node:
    """Children in the given order, or as a multiset where `ordered` is false."""

    children: tuple
    ordered: bool = True

    def digest(self) -> Column:
        digests = F.array(*[c.digest() for c in self.children])
        return F.xxhash64(digests if self.ordered else F.array_sort(digests))

    def canonical(self) -> Column:
        parts = F.array(*[c.canonical() for c in self.children])
        parts = parts if self.ordered else F.array_sort(parts)
        # lengths in front of the parts keep the structure unambiguous
        return F.concat(F.lit("("), F.array_join(F.transform(parts, lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), ","), F.lit(")"))


def with_digest(rows: DataFrame, tree: Node, id_col: str) -> DataFrame:
    """(id_col, _digest, _canonical) of each row; other columns are dropped, so their names can't clash."""
    return rows.select(F.col(id_col), tree.digest().alias("_digest"), tree.canonical().alias("_canonical"))


def records(rows: DataFrame, tree: Node, id_col: str) -> DataFrame:
    """One row per record: first_id (lowest id), copies, and its digest and canonical form.

    Rows are counted map-side before the shuffle, so a record with a third of all rows costs one partial row per task. Rows
    with a null id aren't records. An empty table gives no rows; a repeated id counts as often as it comes.
    """
    known = with_digest(rows, tree, id_col).where(F.col(id_col).isNotNull())
    return known.groupBy("_digest", "_canonical").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def copies(rows: DataFrame, tree: Node, id_col: str) -> DataFrame:
    """(first_id, id_col) of every row but the lowest id of its record.

    Only records with copies go into the join, which is on the digest and the canonical form; the rows of a record with very
    many copies are spread over tasks by their ids.
    """
    known = with_digest(rows, tree, id_col).where(F.col(id_col).isNotNull())
    repeated = written(records(rows, tree, id_col).where("copies > 1").select("_digest", "_canonical", "first_id", "copies"), "repeated-records")
    joined = spread_join(known, repeated, ["_digest", "_canonical"], "copies", [F.col(id_col)])
    return joined.where(F.col(id_col) > F.col("first_id")).select("first_id", id_col)

"""Sizes that decide how something is done, never what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Counted rows times assumed bytes a row up to which a side is broadcast.
BROADCAST_BYTES = 48 << 20
#: Numbers of one block: a group's rows are sorted block by block, so that a hot group is no single task.
BLOCK = 1 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """The broadcast hint while the counted size allows it; beyond, Spark joins by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def block_of(value: Column, block: int) -> Column:
    return F.floor(value / block)


def blocked_number(df: DataFrame, groups: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with ``ordinal``, the place of each row in its group, from 1. Where the first column of the order is an integer,
    rows are numbered inside blocks of its values, and blocks by their counts; else each group is sorted as a whole."""
    whole = df.schema[order[0]].dataType.typeName() in ("byte", "short", "integer", "long")
    if not whole:
        return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    d = df.withColumn("__b", block_of(F.col(order[0]), block))
    counts = d.groupBy(*groups, "__b").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("__b").alias("__c"), F.coalesce(before, F.lit(0)).alias("__first"))
    same = F.col("__b").eqNullSafe(F.col("__c"))
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    own = F.row_number().over(Window.partitionBy(*groups, "__b").orderBy(*order))
    numbered = d.withColumn("__k", own).join(starts, same, "left")
    return numbered.withColumn("ordinal", (F.col("__first") + F.col("__k")).cast("int")).drop("__b", "__k", "__c", "__first", *[f"__{g}" for g in groups])

"""Deterministic samples and even partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.merge import numbered_groups


def stable_order(seed: str, *parts: Column) -> Column:
    """A hash that orders rows alike everywhere: sha256 of "seed:part:part"."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def balanced_sample(df: DataFrame, stratum: str, severity: str, key: str, levels: list[str], most: int, seed: str) -> DataFrame:
    """``most`` rows, round robin over strata, and inside a stratum over severities in the order of ``levels``."""
    h = stable_order(seed, F.col(key))
    level = F.array_position(F.array(*map(F.lit, levels)), F.col(severity))
    r = F.row_number().over(Window.partitionBy(stratum, severity).orderBy(h, key))
    s = F.row_number().over(Window.partitionBy(stratum).orderBy("__r", "__l", key))
    out = df.withColumn("__l", level).withColumn("__r", r).withColumn("__s", s)
    return out.orderBy("__s", stratum).limit(most).drop("__l", "__r", "__s")


def round_robin(df: DataFrame, order: list[str], workers: int) -> DataFrame:
    """Column ``worker`` from 0: rows dealt out in order, numbered without one task seeing them all."""
    return numbered_groups(df, [F.asc(c) for c in order], 1).withColumn("worker", F.col("group_no") % workers).drop("group_no")

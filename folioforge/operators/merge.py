"""Upserts, inserts, replacements and ledgers as joins of tables, old and new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All new rows, and the old ones whose keys are not among them."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows, and the new ones whose keys are not among them."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def update_from(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with ``columns`` from the new row of their key where that has a value."""
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    both = old.join(fresh, keys, "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """The rows of every group that ``new`` has are replaced as a whole."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def last_state(events: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """(key, state..., attempts): the last event of each key, and how many it had."""
    at = F.struct(*order)
    last = [F.max_by(c, at).alias(c) for c in state]
    return events.groupBy(key).agg(*last, F.count("*").alias("attempts"))


def numbered_groups(df: DataFrame, order: list, size: int) -> DataFrame:
    """Rows in groups of ``size`` by a global order: column ``group_no`` from 0.

    The running numbers come from range-sorted partitions and their sizes, one
    row a partition, so no task sees more than its own rows.
    """
    from pyspark.sql import Window

    from folioforge.session import cut

    parts = cut(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("c")).withColumn("__before", F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33)
    both = parts.join(F.broadcast(sizes.drop("c")), "__p")
    n = F.coalesce("__before", F.lit(0)) + local
    return both.withColumn("group_no", F.floor(n / size)).drop("__p", "__m", "__before")

"""Data-quality rules as tables of violations, and retrieval-evaluation metrics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import quality_counts, quality_score

_WORDS = re.compile("[a-z]{3,}")
RATED = ["n_common", "n_words", "n_alpha", "n_signs", "n_suspicious", "n_tokens", "n_odd"]


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row per row and rule it breaks, all rules in one scan; a null condition is not broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def compare_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_n, right_n) of keys whose numbers of rows differ."""
    a = left.groupBy(key).agg(F.count("*").alias("left_n"))
    b = right.groupBy(key).agg(F.count("*").alias("right_n"))
    both = a.join(b, key, "full").na.fill(0, ["left_n", "right_n"])
    return both.where("left_n <> right_n")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two tables only, with column ``side``: left or right; repeated rows count."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ratio(numerator: Column, denominator: Column, places: int = 4) -> Column:
    """A rounded share; null, never zero, where nothing was counted."""
    return F.when(denominator > 0, F.round(numerator / denominator, places))


def recall_at(found: Column, relevant: Column, k: int) -> Column:
    """Share of ``relevant`` among the first ``k`` different ids found; null without relevant ids."""
    first = F.slice(F.array_distinct(found), 1, k)
    return ratio(F.size(F.array_intersect(first, relevant)), F.size(F.array_distinct(relevant)))


def exact_set(predicted: Column, required: Column, acceptable: Column) -> Column:
    """Everything required is predicted and nothing beyond what is acceptable; null where nothing is required."""
    ok = (F.size(F.array_except(required, predicted)) == 0) & (F.size(F.array_except(predicted, F.array_union(required, acceptable))) == 0)
    return F.when(F.size(required) > 0, ok)


def common_words(df: DataFrame, text: str, least: int = 5, most: int = 50_000) -> DataFrame:
    """(word): lower-case words of three letters and more that at least ``least`` texts hold, the ``most`` commonest (what is broadcast is bounded by it)."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))
    n = df.select(F.explode(w).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.orderBy(F.desc("n"), "word").limit(most).select("word")


def text_metrics(df: DataFrame, keys: list[str], text: str, common: DataFrame) -> DataFrame:
    """(keys..., counts, n_common): the counts of ``quality_counts`` and the words found in ``common`` (word, bounded by ``common_words``); null texts give no row."""
    known = frozenset(r.word for r in common.collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(map(known.__contains__, _WORDS.findall(t.lower()))) for t in b.column("__t").to_pylist()]
            kept = [c for c in b.schema.names if c != "__t"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64())], [*kept, "n_common"])

    rows = df.where(F.col(text).isNotNull()).select(*keys, *[c.alias(n) for n, c in quality_counts(F.col(text)).items()], F.col(text).alias("__t"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "__t"), T.StructField("n_common", T.LongType())])
    return rows.mapInArrow(count, schema)


def rated(df: DataFrame) -> DataFrame:
    """The counts with ``quality`` and its bucket ``severity``."""
    q = df.withColumn("quality", quality_score(*[F.col(c) for c in RATED]))
    return q.withColumn("severity", F.when(F.col("quality") < 0.75, "severe").when(F.col("quality") < 0.9, "moderate").otherwise("mild"))

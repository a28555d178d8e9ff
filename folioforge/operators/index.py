"""A stored inverted index: postings by bucket of the term, statistics beside them; a question reads its own terms only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import words
from folioforge.session import checkpoint_dir, spread


@dataclass(frozen=True)
class Index:
    """Where an index lies, and how it is cut."""

    spark: SparkSession
    path: str
    id_col: str
    keep: tuple[str, ...]
    buckets: int

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, id, keep..., tf, n): all postings, or those of ``terms``, from their buckets only."""
        p = self.spark.read.parquet(f"{self.path}/postings")
        if terms is not None:
            own = [r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), self.buckets).alias("b")).distinct().collect()]
            p = p.where(F.col("bucket").isin(own) & F.col("term").isin(terms))
        return p.drop("bucket")

    def terms(self) -> DataFrame:
        """(term, df, cf)."""
        return self.spark.read.parquet(f"{self.path}/terms")

    def stats(self) -> DataFrame:
        """One row: n_docs, avg_n."""
        return self.spark.read.parquet(f"{self.path}/stats")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(df: DataFrame, id_col: str, text: Column, path: str, keep: tuple[str, ...] = (), buckets: int = 16, salts: int = 4) -> Index:
    """Write the index of ``df`` (ids are unique) to ``path``. Null texts are no documents.

    Postings are cut by bucket and by a salt of the id, so that a common term
    is written by several tasks, and sorted by term, so that a scan skips row groups.
    """
    spark = df.sparkSession
    texts = spread(df.select(id_col, *keep, text.alias("__t")).where("__t IS NOT NULL"))
    # a generator keeps the words from being taken apart anew for every column that uses them
    once = F.explode(F.transform(F.array(words(F.col("__t"))), lambda w: F.struct(w.alias("w"), F.size(w).alias("n")))).alias("x")
    docs = texts.select(id_col, *keep, once)
    each = docs.select(id_col, *keep, F.col("x.n").alias("n"), F.explode("x.w").alias("term")).groupBy("term", id_col, *keep, "n").agg(F.count("*").cast("int").alias("tf"))
    each = each.withColumn("bucket", _bucket(F.col("term"), buckets))
    cut_ = each.repartition(F.col("bucket"), F.pmod(F.xxhash64(id_col), F.lit(salts))).sortWithinPartitions("bucket", "term", id_col)
    cut_.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    p = spark.read.parquet(f"{path}/postings")
    p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{path}/terms")
    total = p.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("cf"))
    stats = df.select(text.alias("t")).where("t IS NOT NULL").agg(F.count("*").alias("n_docs")).crossJoin(total)  # one row each
    # last: its mark says that the index is whole
    stats.select("n_docs", F.try_divide(F.col("cf").cast("double"), F.col("n_docs")).alias("avg_n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return Index(spark, path, id_col, tuple(keep), buckets)


def stored(df: DataFrame, name: str, id_col: str, text: Column, keep: tuple[str, ...] = (), buckets: int = 16) -> Index:
    """The index of a table's files as they are: built in the shared folder if there is none for these files, sizes and times."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for f in sorted(df.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        seen.append(f"{f}:{s.getLen()}:{s.getModificationTime()}")
    mark = hashlib.sha256("\n".join([name, id_col, *keep, str(buckets), *seen]).encode()).hexdigest()[:24]
    path = f"{checkpoint_dir(spark)}/indices/{name}-{mark}"
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
    if done.getFileSystem(conf).exists(done):
        return Index(spark, path, id_col, tuple(keep), buckets)
    return build(df, id_col, text, path, keep, buckets)


def bm25(index: Index, terms: list[str], k1: float = 1.2, b: float = 0.75, only: Column | None = None) -> DataFrame:
    """(id, keep..., score) of every document with one of ``terms``, as ``search.bm25`` scores it; ``only`` filters hits by ``keep``."""
    p = index.postings(terms)
    df = p.groupBy("term").agg(F.count("*").alias("df"))  # one row per term asked
    hit = p if only is None else p.where(F.coalesce(only, F.lit(False)))
    x = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(index.stats()))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("avg_n")))
    return x.groupBy(index.id_col, *index.keep).agg(F.round(F.sum(part), 6).alias("score"))

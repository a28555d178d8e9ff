"""File scans and sinks, each with its contract on bad, missing and late input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines, plain or gzip: a bad line is an error, or is dropped where ``strict`` is off; blank lines are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def commented_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines in which lines that begin with # are remarks; a bad line is an error."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """The table, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{what} has no records")
    return df


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file, plain or gzip."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def with_origin(df: DataFrame) -> DataFrame:
    """Column ``_file``: the file a row was read from."""
    return df.withColumn("_file", F.col("_metadata.file_name"))


def finished_batches(spark: SparkSession, root: str, marker: str = "completion/COMPLETE.json") -> list[str]:
    """Folders of ``root`` that hold the marker of a finished batch, sorted."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(str(q.toString()) for q in found if fs.exists(jvm.org.apache.hadoop.fs.Path(q, marker)))


def keyset_page(df: DataFrame, key: str, after: str | int | None, size: int) -> DataFrame:
    """The next ``size`` rows by key after the last key seen; the filter reaches the scan."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def positional_join(left: DataFrame, right: DataFrame, pos: str, left_id: str, right_id: str) -> DataFrame:
    """Rows of equal position; an error if the lengths or the ids at any position differ."""
    both = left.join(right, pos, "full")
    wrong = both.where(~F.col(left_id).eqNullSafe(F.col(right_id))).limit(1).collect()
    if wrong:
        raise ValueError(f"position {wrong[0][pos]}: {wrong[0][left_id]} is not {wrong[0][right_id]}")
    return both


def publish(df: DataFrame, root: str, name: str, version: str) -> str:
    """Write a version beside the others and point the view ``name`` at it; readers see the old or the new one."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).createOrReplaceTempView(name)
    return path


def compare_listings(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(file, problem): files missing on one side or of another checksum."""
    both = local.select("file", F.col("sha256").alias("a")).join(remote.select("file", F.col("sha256").alias("b")), "file", "full")
    problem = F.when(F.col("b").isNull(), "not remote").when(F.col("a").isNull(), "not local").when(F.col("a") != F.col("b"), "differs")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")

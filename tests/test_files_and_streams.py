import gzip
import json

import pytest
from pyspark.sql import functions as F

from folioforge.sources import files as S
from folioforge.sources import shards as H
from folioforge.streaming import ingest as I


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 1}\n\n{"id": "2", "n": 2}\n')
    assert S.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\nnot json\n')
    with pytest.raises(Exception):
        S.json_lines(spark, str(tmp_path / "b.jsonl"), "id string").collect()
    assert S.json_lines(spark, str(tmp_path / "b.jsonl"), "id string", strict=False).count() == 1
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"id": "9"}\n')
    assert S.json_lines(spark, str(tmp_path / "c.jsonl.gz"), "id string").first().id == "9"
    (tmp_path / "d.jsonl").write_text('# remark\n{"id": "5"}\n')
    assert S.commented_json(spark, str(tmp_path / "d.jsonl"), "id string").first().id == "5"
    (tmp_path / "e.json").write_text(json.dumps({"id": "7", "pages": [{"n": 1}]}, indent=1))
    assert S.json_document(spark, str(tmp_path / "e.json"), "id string, pages array<struct<n int>>").first().pages[0].n == 1
    with pytest.raises(ValueError):
        S.not_empty(spark.createDataFrame([], "x int"), "the manifest")


def test_batches_and_checksums(spark, tmp_path):
    for b in "ab":
        (tmp_path / b / "completion").mkdir(parents=True)
    (tmp_path / "b" / "completion" / "COMPLETE.json").write_text("{}")
    assert [p.rsplit("/", 1)[1] for p in S.finished_batches(spark, str(tmp_path))] == ["b"]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.txt").write_text("abc")
    got = H.file_digests(spark, str(tmp_path / "x"))
    assert got.first().bytes == 3
    other = got.withColumn("sha256", F.lit("0"))
    assert S.compare_listings(got, other).first().problem == "differs"


def test_positions(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "p int, x string")
    b = spark.createDataFrame([(0, "a"), (1, "b")], "p int, y string")
    assert S.positional_join(a, b, "p", "x", "y").count() == 2
    with pytest.raises(ValueError):
        S.positional_join(a, b.where("p = 0"), "p", "x", "y")
    assert [r.p for r in S.keyset_page(a, "p", 0, 5).collect()] == [1]


def test_ingest_resumes(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "id string, v int"
    spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], schema).coalesce(1).write.parquet(src)
    I.ingest_available(spark, src, schema, out, ["id"], cp)
    assert sorted(map(tuple, I.latest(spark, out).collect())) == [("a", 1), ("b", 1)]
    spark.createDataFrame([("b", 2), ("c", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    I.ingest_available(spark, src, schema, out, ["id"], cp)
    I.ingest_available(spark, src, schema, out, ["id"], cp)
    assert sorted(map(tuple, I.latest(spark, out).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_ledger_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, seq long, status string"
    spark.createDataFrame([("a", 1, "failed"), ("a", 3, "done"), ("b", 2, "failed")], schema).coalesce(1).write.parquet(src)

    def write(df, n):
        df.write.mode("overwrite").parquet(f"{out}/{n}")

    def run():
        I.run_available(I.ledger_stream(spark.readStream.schema(schema).parquet(src)), write, str(tmp_path / "cp"))

    run()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/0").collect())) == [("a", "done", 2), ("b", "failed", 1)]
    spark.createDataFrame([("b", 5, "done")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert list(map(tuple, spark.read.parquet(f"{out}/1").collect())) == [("b", "done", 2)]


def test_windowed(spark):
    e = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:01:00', 'x'), (timestamp'2024-01-01 00:04:00', 'x'), (timestamp'2024-01-01 00:06:00', 'x') t(ts, k)")
    assert sorted(r.n for r in I.windowed_counts(e, "ts", "k", "5 minutes", "10 minutes").collect()) == [1, 2]

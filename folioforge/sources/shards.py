"""Vector shards, pages with positions, marked-up copies, streams of lines, and writers that leave whole files only."""

from __future__ import annotations

import hashlib
import io
import json
import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vector_shards(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(shard, place, id, vector array<float>) of NPZ files with ``ids`` and ``vectors``.

    An error if a shard has other shapes, ids that are not one for each vector, or a vector that is not finite or has
    no length; vectors off unit length by more than 0.001 are brought to it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    ids, v = z["ids"], z["vectors"].astype(np.float32)
                if v.ndim != 2 or v.shape[1] != dim or ids.shape != (len(v),):
                    raise ValueError(f"{name}: shapes {ids.shape} and {v.shape}, not (n,) and (n, {dim})")
                norm = np.linalg.norm(v.astype(np.float64), axis=1)
                if not np.isfinite(v).all() or (norm == 0).any():
                    raise ValueError(f"{name}: a vector that is not finite or has no length")
                off = np.abs(norm - 1) > 1e-3
                v[off] = (v[off] / norm[off, None]).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * dim + 1, dim), pa.int32()), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(np.arange(len(v)), pa.int32()), pa.array([str(i) for i in ids], pa.string()), flat], ["shard", "place", "id", "vector"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(read, "shard string, place int, id string, vector array<float>")


def positioned_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, place, top, left, width, height, font, size, text) of XML pages with positioned text elements and their fonts."""
    schema = "file string, page int, place int, top double, left double, width double, height double, font string, size double, text string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                fonts: dict[str, tuple[str | None, float | None]] = {}
                for page in ElementTree.fromstring(content).iter("page"):
                    for f in page.iter("fontspec"):
                        fonts[f.get("id")] = (f.get("family"), float(f.get("size", "nan")))
                    for i, t in enumerate(page.iter("text")):
                        family, size = fonts.get(t.get("font"), (None, None))
                        box = [float(t.get(k, 0)) for k in ("top", "left", "width", "height")]
                        rows.append((name, int(page.get("number", 0)), i, *box, family, size, "".join(t.itertext())))
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.float64(), pa.string()]
            names = ["file", "page", "place", "top", "left", "width", "height", "font", "size", "text"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(read, schema)


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(fields, body) of a text with ``key: value`` lines between two lines of three dashes at its head; no head gives no fields."""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", text.replace("\r\n", "\n"), re.S)
    if not m:
        return {}, text
    pairs = (line.split(":", 1) for line in m[1].split("\n") if ":" in line)
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}, text.replace("\r\n", "\n")[m.end() :]


def marked_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fields map, block, heading, text): marked-up copies in blocks; a line of ``#`` opens one, an empty line parts paragraphs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                fields, body = front_matter(t or "")
                heading, n = None, 0
                for part in re.split(r"\n[ \t]*\n", body):
                    m = re.match(r"\s*#+\s+(.*)", part)
                    if m:
                        heading = m[1].split("\n")[0].strip()
                        part = part[m.end() :]
                    if part.strip():
                        rows.append((k, list(fields.items()), n, heading, " ".join(part.split())))
                        n += 1
            types = [pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["key", "fields", "block", "heading", "text"])

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(read, "key string, fields map<string,string>, block int, heading string, text string").withColumnRenamed("key", key)


def versioned(df: DataFrame, column: str, version: str) -> DataFrame:
    """The documents, or an error if one is of another version of the layout than ``version``."""
    ok = F.col(column).eqNullSafe(F.lit(version))
    message = F.concat(F.lit(f"{column} is not {version}: "), F.coalesce(F.col(column), F.lit("null")))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def decoded_lines(chunks: Iterable[bytes], events: bool = False) -> Iterator[dict]:
    """JSON objects of a stream of newline-delimited JSON, or of the ``data:`` lines of an event stream; what a chunk leaves unfinished waits for the next."""
    held = b""
    for chunk in [*chunks, b"\n"]:
        held += chunk
        *lines, held = held.split(b"\n")
        for raw in lines:
            line = raw.strip()
            if events:
                if not line.startswith(b"data:"):
                    continue
                line = line[5:].strip()
            if line and line != b"[DONE]":
                yield json.loads(line)


def vector_records(df: DataFrame, id_col: str, vector: str, fields: list[str]) -> DataFrame:
    """(value): one JSON line per vector with its metadata; null fields are left out."""
    return df.select(F.to_json(F.struct(F.col(id_col).alias("id"), F.col(vector).alias("values"), F.struct(*fields).alias("metadata"))).alias("value"))


def fan_out(df: DataFrame, key: str, path: str, wanted: DataFrame | None = None) -> None:
    """Write the rows of each entity to a folder of its own in one pass, of ``wanted`` (key) only if given."""
    rows = df if wanted is None else df.join(wanted.select(key), key, "left_semi")
    rows.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).parquet(path)


def file_digests(spark: SparkSession, path: str, block: int = 1 << 22) -> DataFrame:
    """(file, bytes, sha256) of each file under ``path``, read by the executors in blocks, so that a file may be of any size."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    it, names = fs.listFiles(root, True), []
    while it.hasNext():
        names.append(it.next().getPath().toString())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        for b in batches:
            out = []
            for name in b.column("path").to_pylist():
                store, inner = arrow_fs.FileSystem.from_uri(name if "://" in name or name.startswith("file:///") else "file://" + name.removeprefix("file:"))
                h, n = hashlib.sha256(), 0
                with store.open_input_stream(inner) as f:
                    while data := f.read(block):
                        h.update(data)
                        n += len(data)
                out.append((name.rsplit("/", 1)[1], n, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["file", "bytes", "sha256"])

    paths = spark.createDataFrame([(n,) for n in sorted(names)], "path string").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    return paths.mapInArrow(digest, "file string, bytes long, sha256 string")

"""References to records that do not exist.

Parents are cut into key ranges and kept per range as sorted arrays;
references are sent to the range of their key in batches of bounded size and
probed by binary search. The number of ranges is bounded by what the driver
samples; a range with more parents than an array should hold is cut into
slices by a hash of the key. A slice with many references (a hot key) is asked
by several tasks, each with its own copy of the slice's parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut


def plain_key(c: Column) -> Column:
    """The key without outer blanks and letter case; one of more than 64 bytes as its digest, so that arrays of keys stay small."""
    k = F.lower(F.regexp_replace(c.cast("string"), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.when(F.octet_length(k) > 64, F.concat(F.lit("\ue000"), F.sha2(k, 256))).otherwise(k)


def _bytes(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Keys as an array of fixed width, compared without Python; a last sign keeps keys that end in zero bytes apart."""
    return np.array([k.encode("utf-8", "surrogatepass") + b"." for k in keys.to_pylist()], dtype="S") if len(keys) else np.zeros(0, "S1")


def _parents(parents: DataFrame, key: str, at: str, removed: DataFrame, removed_key: str) -> DataFrame:
    """One row per key: (key, since: microseconds of the earliest load or null, known: is a record)."""
    a = parents.select(plain_key(F.col(key)).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("since"), F.lit(True).alias("known"))
    b = removed.select(plain_key(F.col(removed_key)).alias("key"), F.lit(None).cast("long").alias("since"), F.lit(False).alias("known"))
    return a.unionByName(b).where("key IS NOT NULL").groupBy("key").agg(F.min("since").alias("since"), F.max("known").alias("known"))


def orphan_rows(
    references: list[tuple[str, DataFrame, str, str, str]],
    parents: tuple[DataFrame, str, str],
    removals: tuple[DataFrame, str],
    range_parents: int = 50_000,
    batch_rows: int = 200_000,
    sample_keys: int = 20_000,
) -> DataFrame:
    """(source_table, row_id, period_month, orphan_kind) for each reference row whose key is an orphan.

    ``references``: (name, table, id column, key column, time column);
    ``parents``: (table, key, load time); ``removals``: (table, key). Kinds:
    ``missing`` (in neither), ``deleted`` (only in the removals), ``late`` (a
    parent, first loaded after the row's time). A null key is no reference.
    A null time gives a null month and is never late; a null load time is
    passed over. Repeated rows give repeated results.
    """
    known = cut(_parents(*parents, *removals))
    n = known.count()
    ranges = max(1, min(-(-n // range_parents), sample_keys // 20))
    bounds: list[str] = []
    if ranges > 1:
        share = max(1, n // sample_keys)
        keys = sorted(r.key for r in known.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("key").limit(2 * sample_keys).collect())
        bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    edges = np.sort(_bytes(pa.array(bounds, pa.string())))

    rows = None
    for name, df, row_id, key, at in references:
        one = df.select(F.lit(name).alias("source_table"), F.col(row_id).cast("string").alias("row_id"), plain_key(F.col(key)).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.where("key IS NOT NULL")

    def part_of(b: pa.RecordBatch) -> np.ndarray:
        return np.searchsorted(edges, _bytes(b.column("key")), side="right")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            total += np.bincount(part_of(b), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["part", "n"])

    held = np.zeros(len(edges) + 1, np.int64)
    for r in known.select("key").mapInArrow(tally, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():  # one row per range
        held[r.part] = r.n
    slices = np.maximum(1, -(-held // range_parents))
    first = np.r_[0, np.cumsum(slices)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = part_of(b)
            code = first[part] + b.column("kh").to_numpy() % slices[part]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.int64())], [*b.schema.names, "code"])

    key_hash = F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(1 << 30)).alias("kh")
    counted = rows.select("key", key_hash).mapInArrow(placed, "key string, kh long, code long").groupBy("code").agg(F.count("*").alias("n"))
    hot = sorted((r.code, -(-r.n // batch_rows)) for r in counted.where(F.col("n") > batch_rows).collect())  # at most one row per batch of references
    hot_codes, hot_salts = np.array([c for c, _ in hot], np.int64), np.array([s for _, s in hot], np.int64)

    def salts_of(code: np.ndarray) -> np.ndarray:
        out = np.ones(len(code), np.int64)
        if len(hot_codes):
            at = np.minimum(np.searchsorted(hot_codes, code), len(hot_codes) - 1)
            out = np.where(hot_codes[at] == code, hot_salts[at], 1)
        return out

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in placed(batches):
            code = b.column("code").to_numpy()
            salt = b.column("h").to_numpy() % salts_of(code)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("source_table", "row_id", "key", "at")), pa.array(code), pa.array(salt)], ["source_table", "row_id", "key", "at", "code", "salt"])

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in placed(batches):
            code = b.column("code").to_numpy()
            times = salts_of(code)
            row = np.repeat(np.arange(len(code)), times)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("key", "since", "known")), pa.array(code[row]), pa.array(salt)], ["key", "since", "known", "code", "salt"])

    def probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
        keys = _bytes(parents.column("key"))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        # a key asked many times is looked for once
        coded = refs.column("key").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        each = coded.indices.to_numpy()
        at = refs.column("at").to_numpy().astype(float)
        if len(keys):
            asked = _bytes(coded.dictionary)
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = (keys[place] == asked)[each]
            row = order[place][each]
            is_known = parents.column("known").to_numpy()[row].astype(bool)
            late = hit & is_known & (parents.column("since").to_numpy().astype(float)[row] > at)
        else:
            hit = late = is_known = np.zeros(len(each), bool)
        kind = np.where(~hit, "missing", np.where(~is_known, "deleted", np.where(late, "late", "")))
        bad = np.nonzero(kind != "")[0]
        out = refs.select(["source_table", "row_id", "at"]).take(pa.array(bad))
        return out.append_column("orphan_kind", pa.array(kind[bad].tolist(), pa.string()))

    h = F.pmod(F.xxhash64("row_id", "at"), F.lit(1 << 30)).alias("h")
    asked = rows.select("*", h, key_hash).mapInArrow(salted, "source_table string, row_id string, key string, at long, code long, salt long")
    arrays = known.select("*", key_hash).mapInArrow(copied, "key string, since long, known boolean, code long, salt long")
    found = asked.groupBy("code", "salt").cogroup(arrays.groupBy("code", "salt")).applyInArrow(probe, "source_table string, row_id string, at long, orphan_kind string")
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return found.select("source_table", "row_id", month.alias("period_month"), "orphan_kind")


def orphan_counts(found: DataFrame) -> DataFrame:
    """(source_table, period_month, orphan_kind, n) over ``orphan_rows``."""
    return found.groupBy("source_table", "period_month", "orphan_kind").agg(F.count("*").alias("n"))

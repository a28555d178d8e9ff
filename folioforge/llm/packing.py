"""Filling fixed-capacity containers: best fit over several permitted lengths at once.

Items are spread over shards by a hash of their id and each shard packs its
own, largest first. For the largest item that waits, every permitted length is
tried: what still waits would fill it how well? The length of least cost, the
share it leaves unused, is opened and filled so; among lengths of equal cost
the shortest is. The lengths are so chosen jointly, from what waits at that
moment, and long containers serve where short ones cannot be filled. At the end
each bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut


def best_fit(sizes: list[int], lengths: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, final length of each bin, length each bin was opened at); each size is at most the greatest of ``lengths``.

    A bin is filled by the largest waiting item that fits, again and again. Items of no size go to the first bin.
    """
    lengths = sorted(set(lengths))
    by: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # items that wait, by size
    for i in range(len(sizes) - 1, -1, -1):
        by[sizes[i]].append(i)
    some = 0  # bit s: an item of size s waits
    for s in range(1, lengths[-1] + 1):
        if by[s]:
            some |= 1 << s
    where = [0] * len(sizes)
    filled: list[int] = []
    opened: list[int] = []
    while some:
        x = some.bit_length() - 1
        best: tuple[float, int, list[int], int] | None = None
        for c in lengths:
            if c < x:
                continue
            room, took, used, left = c - x, [x], {x: 1}, some
            if len(by[x]) == 1:
                left &= ~(1 << x)
            while room and (fit := left & ((1 << (room + 1)) - 1)):
                y = fit.bit_length() - 1
                used[y] = used.get(y, 0) + 1
                if used[y] == len(by[y]):
                    left &= ~(1 << y)
                took.append(y)
                room -= y
            if best is None or room / c < best[0]:
                best = (room / c, c, took, left)
            if not room:
                break  # a longer bin can cost no less
        _, c, took, some = best
        for y in took:
            where[by[y].pop()] = len(opened)
        opened.append(c)
        filled.append(sum(took))
    if sizes and not opened:
        opened, filled = [lengths[0]], [0]
    return where, [next(c for c in lengths if c >= f) for f in filled], opened


def pack(sizes: DataFrame, packs: DataFrame, id_col: str = "doc_id", shard_items: int = 100_000) -> DataFrame:
    """Every item in containers of each capacity: pack_name, capacity_tokens (of the bin, downsized), bin_id, id, piece, first_token, n_tokens.

    ``sizes``: (id, n_tokens); ``packs``: (pack_name, capacity_tokens), a
    handful. For a pack the permitted lengths are its capacity and the smaller
    ones of the others. Only an item larger than the pack's capacity is
    divided, into full pieces and a rest. An item of 0 tokens takes no room
    and goes to any bin; a null size counts as 0, null ids give no row, packs
    without a positive capacity are passed over.
    """
    rows = packs.select("pack_name", "capacity_tokens").where("pack_name IS NOT NULL AND capacity_tokens > 0").distinct().collect()
    caps = {r.pack_name: int(r.capacity_tokens) for r in rows}
    lengths = {p: sorted({d for d in caps.values() if d <= c}) for p, c in caps.items()}
    spark = sizes.sparkSession
    items = cut(sizes.select(F.col(id_col).alias("id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")).where("id IS NOT NULL"))
    kind = items.schema["id"].dataType.simpleString()
    if not caps:
        return spark.createDataFrame([], f"pack_name string, capacity_tokens int, bin_id string, {id_col} {kind}, piece int, first_token long, n_tokens int")
    shards = max(1, -(-items.count() // shard_items))
    names = spark.createDataFrame(list(caps.items()), "pack_name string, cap long")
    each = items.crossJoin(F.broadcast(names))  # a handful of packs
    last = F.greatest(F.ceil(F.col("n") / F.col("cap")), F.lit(1)) - 1
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    each = each.withColumn("first", F.col("piece") * F.col("cap")).withColumn("size", F.least(F.col("n") - F.col("first"), "cap").cast("int"))
    each = each.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int")).select("pack_name", "shard", "id", "piece", "first", "size")

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        pack_name, shard = key[0].as_py(), key[1].as_py()
        t = t.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending")])
        where, final, _ = best_fit(t.column("size").to_pylist(), lengths[pack_name])
        return pa.table(
            {
                "pack_name": pa.array([pack_name] * len(where), pa.string()),
                "capacity_tokens": pa.array([final[b] for b in where], pa.int32()),
                "bin_id": pa.array([f"{shard}-{b}" for b in where], pa.string()),
                "id": t.column("id"),
                "piece": t.column("piece").cast(pa.int32()),
                "first_token": t.column("first"),
                "n_tokens": t.column("size"),
            }
        )

    packed = each.groupBy("pack_name", "shard").applyInArrow(fill, f"pack_name string, capacity_tokens int, bin_id string, id {kind}, piece int, first_token long, n_tokens int")
    return packed.withColumnRenamed("id", id_col)


def fill_rates(packed: DataFrame) -> DataFrame:
    """Per pack: bins, tokens, room (sum of the bins' lengths), unused share, divided items."""
    bins = packed.groupBy("pack_name", "bin_id").agg(F.max("capacity_tokens").alias("c"), F.sum("n_tokens").alias("n"), F.count_if(F.col("piece") == 1).alias("d"))
    rates = bins.groupBy("pack_name").agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), F.sum("c").alias("room"), F.sum("d").alias("divided"))
    return rates.withColumn("unused_share", F.round(1 - F.col("tokens") / F.col("room"), 6))

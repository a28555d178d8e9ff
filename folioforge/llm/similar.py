"""Most similar vectors for every vector.

Vectors are spread over shards by a tree of coarse codebooks, each shard answers
for its rows, from its graph (``hnsw.Graph``) or, where near ones only are asked
for, by products of its rows (``near_rows``), and the shards' answers are merged
per id. A row goes to every cell whose centre is at most ``margin``
less similar to it than the nearest one, but to ``most_cells`` at most, so rows
near a border meet in some shard and the work grows with the rows. A cell of
more than ``limit`` rows is divided by a codebook of its own, as often as
needed; a cell of vectors that differ by rounding only is divided by a hash, as
any of them is as near as any other.

Ids with one and the same vector are one row in all of this (``distinct_vectors``)
and are told apart again in the answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut, spread

from .hnsw import Graph

_BLANKS = str.maketrans(",;|\t\r\n", "      ")
_PAIRS = {"[": "]", "{": "}", "(": ")"}


def read_vector(text: str | None, dim: int) -> bytes | None:
    """The unit vector written in ``text`` as float32 bytes; None if there is no such vector.

    A vector is ``dim`` finite numbers, not all zero, bare or in one pair of
    brackets, divided by blanks or by one comma, semicolon or bar.
    """
    if not text:
        return None
    body = text.strip()
    if not body:
        return None
    if body[0] in _PAIRS:
        if body[-1] != _PAIRS[body[0]]:
            return None
        body = body[1:-1]
    parts = body.translate(_BLANKS).split()
    if len(parts) != dim:
        return None
    marks = body.count(",") + body.count(";") + body.count("|")
    if marks not in (0, dim - 1):
        return None
    try:
        v = np.array(parts, dtype=np.float64)
    except ValueError:
        return None
    top = np.abs(v).max()
    if not (0 < top < np.inf):  # false for NaN too
        return None
    v /= top
    return (v / np.sqrt(v @ v)).astype(np.float32).tobytes()


def unit_vectors(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(id, vec): one readable unit vector per non-null id, as float32 bytes.

    Of several rows of one id the readable ones are kept; if these differ in
    direction, the one whose bytes sort first.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = pa.array([read_vector(t, dim) for t in b.column(1).to_pylist()], pa.binary())
            keep = vec.is_valid()
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), vec.filter(keep)], ["id", "vec"])

    rows = spread(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")))
    rows = rows.where("id IS NOT NULL AND t IS NOT NULL").mapInArrow(read, "id string, vec binary")
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def distinct_vectors(vectors: DataFrame, rows: int, most: int, group_rows: int = 100_000) -> DataFrame:
    """(vec, ids, id) of ``unit_vectors``: each vector once with its ``most`` smallest ids, in order.

    Every id beyond these has a row of its own, with the ``most`` smallest ids of its vector and without the vector.
    ``rows`` is about the number of rows; the ids of a vector meet in parts of about ``group_rows`` at most, however many share it.
    """
    salts = max(1, -(-rows // group_rows))
    parts = vectors.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.array_sort(F.collect_list("id")).alias("part"))
    first = F.slice(F.array_sort(F.flatten(F.collect_list(F.slice("part", 1, most)))), 1, most)
    heads = cut(parts.groupBy("vec").agg(first.alias("ids"), F.sum(F.size("part")).alias("n")))
    firsts = heads.select("vec", "ids", F.lit(None).cast("string").alias("id"))
    shared = heads.where(F.col("n") > most)
    if shared.isEmpty():
        return firsts
    rest = parts.join(shared, "vec").select("ids", F.explode(F.array_except("part", "ids")).alias("id"))
    return firsts.unionByName(rest.select(F.lit(None).cast("binary").alias("vec"), "ids", "id"))


def codebook(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Unit centres of ``cells`` groups of the sampled unit vectors (spherical k-means)."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    c = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        at = (sample @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, at, sample)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 0, s / np.maximum(norm, 1e-12), sample[rng.choice(len(sample), cells)])
    return c.astype(np.float32)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def nearest_cells(x: np.ndarray, centres: np.ndarray, margin: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells of each row of x: those within ``margin`` of its best, the ``most`` best of them."""
    s = x @ centres.T
    ok = s >= s.max(1, keepdims=True) - margin
    if s.shape[1] > most:
        least = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most]
        ok &= s >= least
    return np.nonzero(ok)


def _offer(x: np.ndarray, asking: np.ndarray, others: np.ndarray, near: np.ndarray, sim: np.ndarray, floor: np.float32, block: int = 512, width: int = 4096) -> None:
    """Enter in ``near``/``sim`` of the rows ``asking`` of x what is nearer among its rows ``others`` and more similar than ``floor``."""
    k = near.shape[1]
    for a in range(0, len(asking), block):
        q = asking[a : a + block]
        v = x[q]
        for b in range(0, len(others), width):
            o = others[b : b + width]
            s = v @ x[o].T
            r, c = np.divmod(np.flatnonzero(s > np.maximum(sim[q, -1], floor)[:, None]), len(o))
            if len(r) > 8 * k * len(q) and len(o) > k + 1:  # a dense group: its k + 1 nearest hold the k wanted, whether a row is among its others or not
                c = np.argpartition(-s, k, axis=1)[:, : k + 1].ravel()
                r = np.repeat(np.arange(len(q)), k + 1)
                ok = s[r, c] > np.maximum(sim[q, -1], floor)[r]
                r, c = r[ok], c[ok]
            i, u = o[c], s[r, c]
            ok = i != q[r]
            r, i, u = r[ok], i[ok], u[ok]
            if not len(r):
                continue
            at = np.lexsort((i, -u, r))
            r, i, u = r[at], i[at], u[at]
            start = np.r_[True, r[1:] != r[:-1]]
            rank = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0))
            row, node, keep = np.cumsum(start) - 1, q[r[start]], rank < k
            new_i, new_s = np.full((len(node), k), -1, near.dtype), np.full((len(node), k), -2.0, np.float32)
            new_i[row[keep], rank[keep]], new_s[row[keep], rank[keep]] = i[keep], u[keep]
            known = (new_i[:, :, None] == near[node][:, None, :]).any(2)
            new_s[known] = -2.0
            all_i, all_s = np.concatenate([near[node], new_i], 1), np.concatenate([sim[node], new_s], 1)
            top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            near[node], sim[node] = np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1)


def near_rows(x: np.ndarray, k: int, least: float, margin: float = 0.15, cell_rows: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cosines) of the ``k`` nearest others of each row of x at ``least`` or more, nearest first; free places hold -1 and -2.0.

    Every row is held against those of its cell of about ``cell_rows`` rows, and
    against all rows of other cells whose centres are at most ``margin`` less
    similar to either than its own: cells cost no copies here, so the margin is wide.
    """
    n, floor = len(x), np.nextafter(np.float32(least), np.float32(-3))
    near, sim = np.full((n, k), -1, np.int64), np.full((n, k), -2.0, np.float32)
    every, cells = np.arange(n), -(-n // cell_rows)
    if cells > 1:
        centres = codebook(x[np.random.default_rng(13).choice(n, min(n, 64 * cells), replace=False)], cells)
        s = x @ centres.T
        home = s.argmax(1)
        within = s >= s.max(1, keepdims=True) - margin
    if cells < 2 or within.mean() > 0.5:
        _offer(x, every, every, near, sim, floor)
        return near, sim
    for j in range(len(centres)):
        own = home == j
        ours, guests = np.nonzero(own)[0], np.nonzero(within[:, j] & ~own)[0]
        _offer(x, ours, np.nonzero(within[:, j])[0], near, sim, floor)
        _offer(x, guests, ours, near, sim, floor)
    return near, sim


def divided(rows: DataFrame, big: DataFrame, shard_rows: int, margin: float, most_cells: int, dim: int, fan: int = 256, per_centre: int = 64, task_rows: int = 100_000) -> DataFrame:
    """(cell, ids, vec) of the cells ``big`` (cell, n), each divided into at most ``fan`` cells by a codebook of its own.

    A codebook is fitted on about ``per_centre`` rows a centre; rows find their
    cells in tasks of about ``task_rows``, each with the centres of its cell.
    """
    parts = F.least(F.ceil(F.col("n") / shard_rows), F.lit(fan)).cast("int")
    big = big.select("cell", "n", parts.alias("parts"), F.ceil(F.col("n") / task_rows).cast("int").alias("tasks"))
    h = F.pmod(F.xxhash64(F.lit(5), F.col("ids")[0]), F.lit(1 << 30))
    mine = rows.join(big, "cell")
    drawn = mine.where(F.pmod(F.xxhash64(F.lit(9), F.col("ids")[0]), F.lit(1 << 30)) / (1 << 30) < F.col("parts") * per_centre / F.col("n")).select("cell", "parts", "tasks", "vec")

    def fit(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("vec"), dim)
        parts, tasks = t.column("parts")[0].as_py(), t.column("tasks")[0].as_py()
        mean = x.mean(0)
        spread = 1 - float((x @ (mean / max(float(np.linalg.norm(mean)), 1e-12))).min())
        made = codebook(x[np.lexsort(x.T[:3])], parts).tobytes() if spread > 1e-5 else b""
        return pa.table({"cell": pa.array([t.column("cell")[0].as_py()] * tasks, pa.int64()), "task": pa.array(range(tasks), pa.int32()), "parts": pa.array([parts] * tasks, pa.int32()), "centres": pa.array([made] * tasks, pa.binary())})

    books = drawn.groupBy("cell").applyInArrow(fit, "cell long, task int, parts int, centres binary")
    asked = mine.select("cell", (h % F.col("tasks")).cast("int").alias("task"), h.alias("h"), "ids", "vec")

    def send(r: pa.Table, c: pa.Table) -> pa.Table:
        x = _matrix(r.column("vec"), dim)
        if len(c) and len(c.column("centres")[0].as_py()):
            row, at = nearest_cells(x, np.frombuffer(c.column("centres")[0].as_py(), np.float32).reshape(-1, dim), margin, most_cells)
        else:
            parts = c.column("parts")[0].as_py() if len(c) else 1
            row, at = np.arange(len(x)), (r.column("h").to_numpy() // 7) % parts
        take = pa.array(row)
        return pa.table({"cell": pa.array(r.column("cell").to_numpy()[row] * fan + at, pa.int64()), "ids": r.column("ids").combine_chunks().take(take), "vec": r.column("vec").combine_chunks().take(take)})

    return asked.groupBy("cell", "task").cogroup(books.groupBy("cell", "task")).applyInArrow(send, "cell long, ids array<string>, vec binary")


def similar_vectors(
    df: DataFrame,
    id_col: str,
    text_col: str,
    k: int = 5,
    min_similarity: float = -1.0,
    dim: int = 64,
    shard_rows: int = 32_000,
    limit: int = 64_000,
    margin: float = 0.12,
    most_cells: int = 8,
    sample_rows: int = 20_000,
    links: int = 16,
    ef: int = 48,
    graph: bool = True,
) -> DataFrame:
    """(id, neighbours array<struct<similarity double, id string>>), nearest first, at most ``k``.

    Rows without an id or a readable vector give nothing; an id alone at
    ``min_similarity`` gives no row. Equal similarities are ordered by id. The
    first codebook is fitted on at most about ``sample_rows`` vectors (those of
    the smallest id hashes), the codebooks of large cells on samples of their
    own; every vector is indexed and asked for. Without ``graph`` a shard's rows
    are held against each other (``near_rows``), which finds all that meet in a
    shard and suits a ``min_similarity`` that few rows reach.
    """
    rows = distinct_vectors(unit_vectors(df, id_col, text_col, dim), df.count(), k + 1)
    vectors = rows.where("vec IS NOT NULL").select("ids", "vec")
    n = vectors.count()
    share = min(1.0, sample_rows / max(n, 1))
    cells = max(1, min(-(-n // shard_rows), sample_rows // 50))
    sampled = vectors.where(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec")
    if cells > 1:
        sample = _matrix(sampled.toArrow().column(0).combine_chunks(), dim)
        centres = codebook(sample[np.lexsort(sample.T[:3])], cells)
    else:
        centres = np.zeros((1, dim), np.float32)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cell = nearest_cells(_matrix(b.column("vec"), dim), centres, margin, most_cells)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), b.column("ids").take(take), b.column("vec").take(take)], ["cell", "ids", "vec"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.bincount(nearest_cells(_matrix(b.column("vec"), dim), centres, margin, most_cells)[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(n)[0]), pa.array(n[n > 0])], ["cell", "n"])

    # cells of more than a shard's limit are divided, level by level; each level has at most that share of cells of the one before.
    # The first level is routed anew where it is read: its rows on disk would be as large as the shuffle to the shards.
    routed = vectors.mapInArrow(route, "cell long, ids array<string>, vec binary")
    ready = None
    for level in range(4 if n > limit else 0):
        if level:
            routed = cut(routed)
            sizes = routed.groupBy("cell").agg(F.count("*").alias("n"))
        else:
            sizes = vectors.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        big = cut(sizes.where(F.col("n") > limit))
        if big.isEmpty():
            break
        small = routed.join(big.select("cell"), "cell", "left_anti").select(F.concat_ws(":", F.lit(str(level)), "cell").alias("shard"), "ids", "vec")
        ready = small if ready is None else ready.unionByName(small)
        routed = divided(routed, big, shard_rows, margin, most_cells, dim)
    routed = routed.select(F.concat_ws(":", F.lit("last"), "cell").alias("shard"), "ids", "vec")
    routed = routed if ready is None else ready.unionByName(routed)

    def answer(shard: pa.Table) -> pa.Table:
        shard = shard.append_column("first", pc.list_element(shard.column("ids"), 0)).sort_by("first")
        ids = shard.column("ids").combine_chunks()
        x = _matrix(shard.column("vec"), dim)
        near, sim = Graph(x, k, links=links, ef=ef).neighbours() if graph else near_rows(x, k, min_similarity)
        near, sim = near[:, :k], sim[:, :k]
        r, c = np.nonzero(sim >= max(min_similarity, -1.5))
        shared = np.nonzero(pc.list_value_length(ids).to_numpy(zero_copy_only=False) > 1)[0]
        q, nb = np.concatenate([r, shared]), np.concatenate([near[r, c], shared])
        s = np.concatenate([sim[r, c], np.ones(len(shared), np.float32)])
        return pa.table({"ids": ids.take(pa.array(q)), "others": ids.take(pa.array(nb)), "similarity": pa.array(np.minimum(s.astype(np.float64), 1.0))})

    found = routed.groupBy("shard").applyInArrow(answer, "ids array<string>, others array<string>, similarity double")
    each = F.transform("others", lambda o: F.struct((-F.col("similarity")).alias("s"), o.alias("o")))
    best = F.array_sort(F.flatten(F.collect_list(each)))
    merged = found.groupBy("ids").agg(best.alias("b")).select(F.explode("ids").alias("id"), "b")
    others = F.slice(F.array_distinct(F.filter("b.o", lambda o: o != F.col("id"))), 1, k)
    near = F.transform(others, lambda o: F.struct((-F.filter("b", lambda z: z.o == o)[0].s).alias("similarity"), o.alias("id")))
    beyond = F.transform(F.slice("ids", 1, k), lambda o: F.struct(F.lit(1.0).alias("similarity"), o.alias("id")))
    return merged.select("id", near.alias("neighbours")).unionByName(rows.where("vec IS NULL").select("id", beyond.alias("neighbours")))


def similar_rows(df: DataFrame, id_col: str, text_col: str, k: int = 5, **more) -> DataFrame:
    """(id, neighbour, similarity): the ``k`` most similar others of every id with a readable vector."""
    near = similar_vectors(df, id_col, text_col, k, **more).select("id", F.explode("neighbours").alias("n"))
    return near.select("id", F.col("n.id").alias("neighbour"), F.col("n.similarity").alias("similarity"))


def similar_pairs(df: DataFrame, id_col: str, text_col: str, k: int = 5, min_similarity: float = 0.85, **more) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the ``k`` most similar of every id that has ``k`` at ``min_similarity``.

    A row of which one near one is missed may seem to have fewer than ``k`` and lose all its pairs, so shards are
    searched in full and the margin between them is as wide as near ones are apart.
    """
    more = {"shard_rows": 16_000, "limit": 128_000, "margin": 0.1, "graph": False} | more
    near = similar_vectors(df, id_col, text_col, k, min_similarity, **more).where(F.size("neighbours") == k)
    pairs = near.select("id", F.explode("neighbours.id").alias("o"))
    return pairs.select(F.least("id", "o").alias("id_a"), F.greatest("id", "o").alias("id_b")).distinct()

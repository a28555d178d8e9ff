"""Mixing sources to target weights, by a splitting tree over blocks of documents.

Each source is cut into blocks by a hash of the document id; only the blocks'
sizes reach the driver. A mix is as large as its scarcest source allows. Every
source contributes whole rounds of its blocks and a random part of one more;
the last block of that part is taken by document until the quota is met. A
multivariate hypergeometric tree then splits the sources' numbers of blocks
over groups of output shards. Below the groups the tree goes on without the
driver: each block is cut by a second hash into as many equal parts as its
group has shards, one for each. So each shard is a fair sample of the mix and of
about the same size however large the sources are, and is put in random order by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import cut


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many blocks of each source every shard gets; each column sums to the source's count."""
    out = np.zeros((shards, len(counts)), np.int64)

    def split(left: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[a] = left
            return
        mid = (a + b) // 2
        total = int(left.sum())
        take = total * (mid - a) // (b - a)
        part = rng.multivariate_hypergeometric(left, take, method="marginals") if total else left * 0
        split(part, a, mid)
        split(left - part, mid, b)

    split(counts.astype(np.int64), 0, shards)
    return out


def plan_mix(targets: list[tuple[str, float, int]], blocks: dict[str, np.ndarray], shard_tokens: int, seed: int) -> tuple[list[tuple], int]:
    """Placements (source, block, copy, group of shards, most tokens or -1 for the whole block) of one mix, and the shards of each group.

    ``targets``: (source, weight, max_repeats); ``blocks``: the tokens of each block of a source.
    """
    rng = np.random.default_rng(seed)
    live = sorted((s, w, r) for s, w, r in targets if w > 0 and r > 0 and s in blocks and blocks[s].sum() > 0)
    if not live:
        return [], 1
    weight = sum(w for _, w, _ in live)
    total = min(r * float(blocks[s].sum()) * weight / w for s, w, r in live)
    units: list[list[tuple]] = []
    for s, w, r in live:
        size = blocks[s]
        quota = total * w / weight
        whole = min(int(quota / size.sum() + 1e-9), r)
        rest = quota - whole * float(size.sum()) if whole < r else 0.0
        mine = [(s, int(b), k + 1, -1) for k in range(whole) for b in np.nonzero(size)[0]]
        for b in rng.permutation(np.nonzero(size)[0]):
            if rest < 1:
                break
            mine.append((s, int(b), whole + 1, -1 if size[b] <= rest else int(rest)))
            rest -= min(rest, float(size[b]))
        units.append([mine[i] for i in rng.permutation(len(mine))])
    shards = max(1, round(total / shard_tokens))
    groups = max(1, min(shards, sum(len(u) for u in units)))
    quota = split_tree(np.array([len(u) for u in units]), groups, rng)
    at = np.zeros(len(units), np.int64)
    placed = []
    for k in range(groups):
        for j, u in enumerate(units):
            placed += [(*x[:3], k, x[3]) for x in u[at[j] : at[j] + quota[k, j]]]
        at += quota[k]
    return placed, -(-shards // groups)


def mix_sources(sizes: DataFrame, targets: DataFrame, most_blocks: int = 512, block_docs: int = 4, shard_tokens: int = 4_000_000, seed: int = 5) -> DataFrame:
    """The selection of each mix: mix_name, shard, position, doc_id, source, copy, n_tokens.

    ``sizes``: (doc_id, source, n_tokens); ``targets``: (mix_name, source,
    weight, max_repeats). Weights are relative in their mix; null and negative
    ones count as 0, a null max_repeats as 1, and rows of one mix and source
    add up (with the least max_repeats). Sources of weight 0, without tokens or
    unnamed give nothing, and the others share what these cannot give.
    Documents without tokens or source are never taken. A source's share is
    met to within half a document, or to its reach where documents are few.
    """
    spark = sizes.sparkSession
    wanted = targets.where("mix_name IS NOT NULL AND source IS NOT NULL").groupBy("mix_name", "source")
    wanted = wanted.agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("r")).collect()
    docs = sizes.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("doc_id IS NOT NULL AND source IS NOT NULL AND n_tokens > 0")
    docs = cut(docs.where(F.col("source").isin(sorted({r.source for r in wanted})) if wanted else F.lit(False)))
    # a fine hash bucket first; most_blocks bounds what the driver plans with, not what a shard or a task holds: how many make a block depends on the source's number of documents
    fine = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(most_blocks)).cast("int")
    stats: dict[str, np.ndarray] = {}
    number: dict[str, int] = {}
    for r in docs.groupBy("source", fine.alias("b")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect():  # sources times most_blocks rows
        stats.setdefault(r.source, np.zeros(most_blocks, np.int64))[r.b] += r.t
        number[r.source] = number.get(r.source, 0) + r.n
    cuts = {s: int(max(1, min(most_blocks, n // block_docs))) for s, n in number.items()}
    blocks = {s: np.bincount(np.arange(most_blocks) % cuts[s], weights=t, minlength=cuts[s]).astype(np.int64) for s, t in stats.items()}
    mixes = sorted({r.mix_name for r in wanted})
    rows = []
    for i, m in enumerate(mixes):
        placed, each = plan_mix([(r.source, r.w, r.r) for r in wanted if r.mix_name == m], blocks, shard_tokens, seed + i)
        rows += [(m, *p, each) for p in placed]
    plan = spark.createDataFrame(rows, "mix_name string, source string, block int, copy int, shard_group int, most long, parts int")
    modulus = spark.createDataFrame(list(cuts.items()), "source string, cuts int")  # one row per source
    blocked = docs.join(F.broadcast(modulus), "source").withColumn("block", (fine % F.col("cuts")).cast("int")).drop("cuts")
    drawn = blocked.join(plan, ["source", "block"]).withColumn("h", F.xxhash64(F.lit(seed), "mix_name", "copy", "doc_id"))
    # a block taken in part is one per mix and source: its hash buckets up to the quota are taken whole, the one that passes it by document
    part = ["mix_name", "source", "block", "copy"]
    some = drawn.where("most >= 0").withColumn("hb", F.pmod("h", F.lit(4096)))
    upto = Window.partitionBy(*part).orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    sums = some.groupBy(*part, "hb").agg(F.sum("n_tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))  # 4,096 rows a part at most
    some = some.join(sums, [*part, "hb"]).where(F.col("before") < F.col("most"))
    whole = some.where(F.col("before") + F.col("t") <= F.col("most"))
    inner = Window.partitionBy(*part, "hb").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = some.where(F.col("before") + F.col("t") > F.col("most")).withColumn("sofar", F.col("before") + F.sum("n_tokens").over(inner))
    last = last.where(F.col("sofar") - F.col("n_tokens") / 2 <= F.col("most"))
    taken = drawn.where("most < 0").unionByName(whole.select(*drawn.columns)).unionByName(last.select(*drawn.columns))
    own = F.pmod(F.xxhash64(F.lit(seed + 1), "mix_name", "copy", "doc_id"), F.col("parts"))
    taken = taken.withColumn("shard", (F.col("shard_group") * F.col("parts") + own).cast("int"))
    order = Window.partitionBy("mix_name", "shard").orderBy("h", "doc_id")
    return taken.select("mix_name", "shard", (F.row_number().over(order) - 1).alias("position"), "doc_id", "source", "copy", "n_tokens")


def mix_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: wanted_share, actual_share, tokens, documents (taken), most_taken (times one was taken), max_repeats."""
    per_doc = selection.groupBy("mix_name", "source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    got = per_doc.groupBy("mix_name", "source").agg(F.sum("t").alias("tokens"), F.sum("k").alias("documents"), F.max("k").alias("most_taken"))
    want = targets.where("mix_name IS NOT NULL AND source IS NOT NULL").groupBy("mix_name", "source")
    want = want.agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    mix = Window.partitionBy("mix_name")  # the rows of a mix are its sources
    both = want.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_taken"])
    share = lambda c: F.coalesce(F.round(F.try_divide(c, F.sum(c).over(mix)), 6), F.lit(0.0))
    return both.select("mix_name", "source", share(F.col("w")).alias("wanted_share"), share(F.col("tokens")).alias("actual_share"), "tokens", "documents", "most_taken", "max_repeats")

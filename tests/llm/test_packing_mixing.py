import os
import random

import numpy as np
import pytest

pytest.importorskip("folioforge.llm")
from folioforge.llm import mixing as M
from folioforge.llm import packing as P
from folioforge.llm import tokens as T


def test_best_fit():
    r = random.Random(1)
    for _ in range(60):
        sizes = [r.randint(0, 64) for _ in range(r.randint(0, 80))]
        where, final, opened = P.best_fit(sizes, [16, 64])
        assert all(f <= o for f, o in zip(final, opened))
        held = [0] * len(final)
        for s, b in zip(sizes, where):
            held[b] += s
        assert all(h <= f and f in (16, 64) for h, f in zip(held, final))
        assert sum(final) <= 1.25 * sum(sizes) + 64
    assert P.best_fit([60, 4, 64, 10], [16, 64])[1].count(64) == 2
    assert P.best_fit([], [8]) == ([], [], []) and P.best_fit([0, 0], [4, 8]) == ([0, 0], [4], [4])


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "narrow"])
def test_lengths_are_chosen_jointly(kind):
    """Several lengths open long before the end, and less room is left than with the longest alone."""
    r = np.random.default_rng(1)
    n = 4000
    sizes = {"lognormal": np.clip(r.lognormal(7, 1.2, n), 1, 32768), "uniform": r.integers(1, 16000, n), "narrow": r.integers(800, 3000, n)}[kind].astype(int).tolist()
    lengths = [2048, 8192, 32768]
    _, joint, opened = P.best_fit(sizes, lengths)
    _, alone, _ = P.best_fit(sizes, lengths[-1:])
    assert sum(joint) <= sum(alone)
    early = opened[: int(0.8 * len(opened))]
    assert len(set(early)) >= 2


def test_pack(spark):
    rows = [(1, 100, 0), (2, 0, 0), (3, None, 0), (None, 5, 0), (4, 7, 0), (5, 33, 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long, piece int")
    packs = spark.createDataFrame([("s", 32), ("s", 32), ("l", 128), ("bad", 0), (None, 9)], "pack_name string, capacity_tokens int")
    got = P.pack(sizes, packs)
    s = got.where("pack_name = 's'")
    assert s.count() == 4 + 1 + 1 + 1 + 2
    assert sorted((r.first_token, r.n_tokens) for r in s.where("doc_id = 1").collect()) == [(0, 32), (32, 32), (64, 32), (96, 4)]
    assert got.where("pack_name = 'l' AND piece > 0").count() == 0
    load = got.groupBy("pack_name", "bin_id").sum("n_tokens").collect()
    assert all(r[2] <= (32 if r.pack_name == "s" else 128) for r in load)
    assert P.pack(sizes.limit(0), packs).count() == 0 and P.pack(sizes, packs.limit(0)).count() == 0
    assert P.fill_rates(got).count() == 2


def test_shards_waste_little(spark):
    r = random.Random(4)
    sizes = spark.createDataFrame([(i, int(r.lognormvariate(5, 1)) + 1) for i in range(5000)], "doc_id long, n_tokens long")
    packs = spark.createDataFrame([("a", 512), ("b", 2048)], "pack_name string, capacity_tokens int")
    assert all(x.unused_share < 0.02 for x in P.fill_rates(P.pack(sizes, packs, shard_items=1500)).collect())


def test_split_tree():
    rng = np.random.default_rng(0)
    counts = np.array([100, 7, 0, 900])
    got = M.split_tree(counts, 7, rng)
    assert (got.sum(0) == counts).all() and (got >= 0).all() and np.ptp(got.sum(1)) <= 3


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, "big" if i % 3 else ("mid" if i % 2 else "small" if i < 60 else None), r.randint(50, 150), 1) for i in range(6000)]
    sizes = spark.createDataFrame(docs + [(9001, "mid", 0, 1), (9002, "mid", None, 1)], "doc_id long, source string, n_tokens long, copy int")
    targets = spark.createDataFrame(
        [("m", "big", 6.0, 1), ("m", "mid", 3.0, 2), ("m", "small", 1.0, 4), ("m", "none", 2.0, 3), ("m", "zero", 0.0, 1), ("n", "big", 1.0, None), ("n", "mid", None, 1), (None, "big", 1.0, 1), ("o", "none", 1.0, 1)],
        "mix_name string, source string, weight double, max_repeats int",
    )
    got = M.mix_sources(sizes, targets, shard_tokens=2000).cache()
    rep = {(x.mix_name, x.source): x for x in M.mix_report(got, targets).collect()}
    share = {s: rep["m", s].actual_share for s in ("big", "mid", "small")}
    assert share == pytest.approx({"big": 0.6, "mid": 0.3, "small": 0.1}, abs=0.02)
    assert rep["m", "small"].most_taken == 4 and rep["m", "big"].most_taken == 1 and rep["m", "none"].actual_share == 0
    assert rep["n", "big"].actual_share == 1 and rep["o", "none"].tokens == 0
    assert got.groupBy("mix_name", "doc_id", "copy").count().where("count > 1").count() == 0
    assert got.groupBy("mix_name", "shard", "position").count().where("count > 1").count() == 0
    assert M.mix_sources(sizes.limit(0), targets).count() == 0 and M.mix_sources(sizes, targets.limit(0)).count() == 0


def test_shards_stay_bounded(spark):
    """However few blocks the driver plans with, a shard is about shard_tokens and shares are met in each."""
    docs = spark.range(20_000).selectExpr("id doc_id", "if(id % 4 = 0, 'a', 'b') source", "100 n_tokens")
    targets = spark.createDataFrame([("m", "a", 1.0, 1), ("m", "b", 1.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    got = M.mix_sources(docs, targets, most_blocks=8, shard_tokens=20_000).groupBy("shard", "source").sum("n_tokens").collect()
    size: dict = {}
    for x in got:
        size.setdefault(x.shard, {})[x.source] = x[2]
    assert len(size) >= 45 and max(sum(v.values()) for v in size.values()) <= 40_000
    assert sum(v.get("a", 0) for v in size.values()) == 500_000 and abs(sum(v.get("b", 0) for v in size.values()) - 500_000) <= 100


@pytest.mark.skipif(not os.path.isdir(T.TOKENIZERS), reason="no tokenizer files")
def test_tokens(spark):
    texts = ["", None, "The appeal is dismissed.", "é — 東京 <|endoftext|>", "a" * 20000]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    enc = T.encoding()
    got = [r.n_tokens for r in T.token_sizes(df, "doc_id", "text").orderBy("doc_id").collect()]
    assert got == [len(enc.encode_ordinary(t or "")) for t in texts] and got[:2] == [0, 0]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)

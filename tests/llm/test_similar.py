import numpy as np
import pytest

pytest.importorskip("folioforge.llm")
from folioforge.llm import hnsw
from folioforge.llm import similar as S


def cluster(n_groups, size, noise, seed, dim=64, alone=0):
    r = np.random.default_rng(seed)
    c = r.normal(size=(n_groups, dim))
    x = np.repeat(c / np.linalg.norm(c, axis=1, keepdims=True), size, 0) + noise * r.normal(size=(n_groups * size, dim))
    x = np.vstack([x, r.normal(size=(alone, dim))])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 9000])
def test_graph_recall(n):
    x = cluster(max(1, n // 12), 6, 0.04, n, alone=n // 2)[:n] if n else np.zeros((0, 64), np.float32)
    ids, sims = hnsw.Graph(x, 5, links=16, ef=64).neighbours()
    if n < 2:
        assert (ids == -1).all()
        return
    true, s = brute(x, min(5, n - 1))
    hit = np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(true, ids)])
    assert hit >= (0.9 if n > 1000 else 0.95)
    # with the production parameters, where there are near ones at all
    few, _ = hnsw.Graph(x, 5, links=12, ef=24).neighbours()
    close = s[np.arange(n)[:, None], true].min(1) >= 0.85
    assert not close.any() or np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(true[close], few[close])]) >= 0.97
    near = ids >= 0
    assert np.allclose(sims[near], s[np.nonzero(near)[0], ids[near]], atol=1e-5)
    assert not (ids == np.arange(n)[:, None]).any()


def test_equal_vectors():
    x = np.tile(cluster(1, 1, 0, 1), (40, 1))
    ids, sims = hnsw.Graph(x, 5).neighbours()
    assert (ids >= 0).all() and np.allclose(sims, 1, atol=1e-5)
    assert all(len(set(r)) == len(r) for r in ids)


def test_search_of_others():
    x = cluster(400, 5, 0.04, 3)
    g = hnsw.Graph(x, 5, links=10)
    ids, sims = g.search(x[:50])
    assert np.mean(sims.max(1) > 0.999) > 0.95


def test_read_vector():
    v = [0.5] * 64
    plain = ",".join(map(str, v))
    same = [f"[{plain}]", f"{{{plain}}}", f" ({plain}) ", plain.replace(",", " "), plain.replace(",", " , "), "[" + ",".join(["5e-1"] * 64) + "]", plain.replace("0.5", "7")]
    assert len({S.read_vector(t, 64) for t in same}) == 1
    for t in [None, "", "[]", "ERROR: timeout", f"[{plain}", f"[{plain},]", f"[{plain},1]", plain.replace("0.5", "nan", 1), plain.replace("0.5", "inf", 1), plain.replace("0.5", "null", 1), ",".join(["0"] * 64), f"({plain}]"]:
        assert S.read_vector(t, 64) is None


def literal(v):
    return "[" + ",".join(f"{x:.9g}" for x in v) + "]"


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 40, "sample_rows": 500}])
def test_pairs(spark, kw):
    x = cluster(30, 8, 0.03, 9, alone=120)
    rows = [(f"id{i:04d}", literal(v), 1) for i, v in enumerate(x)]
    rows += [(f"id{i:04d}", literal(v * 3), 2) for i, v in enumerate(x[:20])] + [("id0001", "broken", 0), ("zz", None, 0), (None, literal(x[0]), 0)]
    df = spark.createDataFrame(rows, "id string, embedding_text string, vec int")
    got = {tuple(r) for r in S.similar_pairs(df, "id", "embedding_text", **kw).collect()}
    true, s = brute(x, 5)
    want = set()
    for i, t in enumerate(true):
        if s[i, t].min() >= 0.85:
            want |= {tuple(sorted((f"id{i:04d}", f"id{j:04d}"))) for j in t}
    assert len(want & got) / len(want) >= 0.9 and len(want & got) / len(got) >= 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "id string, embedding_text string")
    assert S.similar_pairs(df, "id", "embedding_text").count() == 0
    two = spark.createDataFrame([("a", literal(np.ones(64))), ("b", literal(np.ones(64) * 2))], "id string, embedding_text string")
    near = S.similar_vectors(two, "id", "embedding_text").orderBy("id").collect()
    assert [r.neighbours[0].id for r in near] == ["b", "a"] and near[0].neighbours[0].similarity == pytest.approx(1)


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 60, "sample_rows": 600}])
def test_rows_beside_copies(spark, kw):
    # 250 pairs of 0.98 around a vector that 1,500 ids share
    r = np.random.default_rng(4)
    c = r.normal(size=64) / 8
    one = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = one(one(c) + 0.05 * r.normal(size=(250, 64)))
    pairs = one(np.stack([a, a + 0.025 * r.normal(size=a.shape)], 1).reshape(-1, 64))
    rows = [(f"c{i:04d}", literal(c)) for i in range(1500)] + [(f"r{i:04d}", literal(v)) for i, v in enumerate(pairs)]
    near = {x.id: x.neighbours for x in S.similar_vectors(spark.createDataFrame(rows, "id string, embedding_text string"), "id", "embedding_text", **kw).collect()}
    assert len(near) == 2000
    first = [f"c{i:04d}" for i in range(6)]
    for i in range(1500):
        own = [x for x in first if x != f"c{i:04d}"][:5]
        assert [n.id for n in near[f"c{i:04d}"]] == own and all(n.similarity == pytest.approx(1) for n in near[f"c{i:04d}"])
    met = [f"r{i ^ 1:04d}" in {n.id for n in near[f"r{i:04d}"]} for i in range(500)]
    assert np.mean(met) >= 0.95
    sims = one(pairs) @ np.vstack([np.tile(one(c), (6, 1)), one(pairs)]).T
    sims[np.arange(500), 6 + np.arange(500)] = -2
    names = np.array(first + [f"r{i:04d}" for i in range(500)])
    true = names[np.argsort(-sims.round(6), axis=1, kind="stable")[:, :5]]
    assert np.mean([len({n.id for n in near[f"r{i:04d}"]} & set(t)) / 5 for i, t in enumerate(true)]) >= 0.95


def test_layers_are_walked():
    x = cluster(2500, 8, 0.04, 5)
    g = hnsw.Graph(x, 5, links=12, ef=24)
    assert len(g.layers) == 2 and g.layers[0][1].size and not g.layers[1][1].size
    true, _ = brute(x[:2000], 5)
    ids, _ = hnsw.Graph(x[:2000], 5, links=12, ef=24).neighbours()
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(true, ids)]) >= 0.95


def test_dense_cells(spark):
    """Cells over the limit are divided by codebooks of their own, those of vectors that differ by rounding by a hash; no row is lost."""
    r = np.random.default_rng(2)
    c = r.normal(size=64)
    x = np.vstack([c + 1e-7 * r.normal(size=(400, 64)), c + 0.3 * r.normal(size=(400, 64)), r.normal(size=(200, 64))])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"id{i:04d}", literal(v)) for i, v in enumerate(x)], "id string, embedding_text string")
    got = {x.id: x.neighbours for x in S.similar_vectors(df, "id", "embedding_text", shard_rows=150, limit=300, sample_rows=100).collect()}
    assert len(got) == 1000 and all(len(n) == 5 for n in got.values())
    assert all(n.similarity > 0.99999 for i in range(400) for n in got[f"id{i:04d}"])
    true, s = brute(x.astype(np.float32), 5)
    assert np.mean([np.mean([n.similarity for n in got[f"id{i:04d}"]]) / s[i, true[i]].mean() for i in range(400, 1000)]) > 0.9


def test_rows_of_all(spark):
    x = cluster(30, 8, 0.03, 9, alone=300)
    df = spark.createDataFrame([(f"id{i:04d}", literal(v)) for i, v in enumerate(x)], "id string, embedding_text string")
    got = {}
    for r in S.similar_rows(df, "id", "embedding_text").collect():
        got.setdefault(r.id, {})[r.neighbour] = r.similarity
    true, s = brute(x, 5)
    assert len(got) == len(x) and all(len(g) == 5 for g in got.values())
    assert all(v == pytest.approx(s[int(i[2:]), int(o[2:])], abs=1e-5) for i, g in got.items() for o, v in g.items())
    hit = [len({f"id{j:04d}" for j in t} & set(got[f"id{i:04d}"])) / 5 for i, t in enumerate(true)]
    assert np.mean(hit[240:]) >= 0.9 and np.mean(hit[:240]) >= 0.9


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 1000, "limit": 3000, "sample_rows": 2000}])
def test_no_pair_is_missed(spark, kw):
    """Groups of six: whoever misses one of five near ones loses all its pairs."""
    x = cluster(700, 6, 0.03, 21, alone=1800)
    df = spark.createDataFrame([(f"id{i:04d}", literal(v)) for i, v in enumerate(x)], "id string, embedding_text string")
    got = {tuple(r) for r in S.similar_pairs(df, "id", "embedding_text", **kw).collect()}
    true, s = brute(x, 5)
    want = {tuple(sorted((f"id{i:04d}", f"id{j:04d}"))) for i, t in enumerate(true) if s[i, t].min() >= 0.85 for j in t}
    assert len(want) > 10_000 and len(want - got) <= len(want) / 5000 and len(got - want) <= len(want) / 5000


@pytest.mark.parametrize("noise", [1e-8, 0.02])
def test_near_rows(noise):
    """All rows at the least similarity, in cells, in dense groups and among rounding, are found."""
    r = np.random.default_rng(6)
    x = np.vstack([cluster(300, 7, 0.04, 22, alone=2000), r.normal(size=(1, 64)) / 8 + noise * r.normal(size=(1500, 64))]).astype(np.float32)
    x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
    true, s = brute(x, 5)
    for cells in (100, 400, 10_000):
        near, sim = S.near_rows(x, 5, 0.85, cell_rows=cells)
        want = np.take_along_axis(s, true, 1)
        want[want < 0.85] = -2
        assert (np.abs(sim - want) < 1e-6).mean() > 0.9999
        found = near >= 0
        assert np.allclose(sim[found], s[np.nonzero(found)[0], near[found]], atol=1e-6) and (sim[~found] == -2).all()
        assert not (near == np.arange(len(x))[:, None]).any() and all(len(set(n[n >= 0])) == (n >= 0).sum() for n in near)
    assert S.near_rows(x[:1], 5, 0.85)[0].tolist() == [[-1] * 5] and S.near_rows(x[:0], 5, 0.85)[0].shape == (0, 5)

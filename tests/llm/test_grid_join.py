import random

import numpy as np
import pytest

from rosterlake.llm import grid_join as gj


def brute(rows, least=0.95):
    """(n_links, component) of each row, by comparing all."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    units = {i: gj.unit(np.array(rows[i][1], float)[None])[0] for i in good}
    for a in good:
        for b in good:
            if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least - 1e-15:
                links[a] += 1
                links[b] += 1
                label[max(root(a), root(b))] = min(root(a), root(b))
    smallest = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            smallest[root(i)] = min(smallest.get(root(i), k), k)
    return sorted(((k, links[i], smallest.get(root(i)), k == smallest.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def made(rng, n, dims, spread):
    """Vectors alone, in tight groups, in chains, and exact copies, some scaled."""
    rows = []
    while len(rows) < n:
        v = rng.normal(size=dims)
        kind = rng.integers(4)
        if kind == 1:
            rows += [v + rng.normal(size=dims) * spread for _ in range(rng.integers(2, 40))]
        elif kind == 2:
            for _ in range(30):
                rows.append(v)
                v = v / np.linalg.norm(v) + rng.normal(size=dims) * 0.25 / np.sqrt(dims)
        elif kind == 3:
            rows += [v, v, v * 2, -v]
        else:
            rows.append(v)
    return [v.astype(np.float32).tolist() for v in rows[:n]]


@pytest.mark.parametrize(("dims", "block_rows"), [(64, None), (3, 50), (16, 64)])
def test_like_brute_force(spark, dims, block_rows):
    rng = np.random.default_rng(dims)
    vectors = made(rng, 600, dims, 0.1)
    ids = rng.permutation(len(vectors)).tolist()
    rows = list(zip(ids, vectors, strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = gj.near_vectors(df, block_rows=block_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_intervals_skip_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(gj, "LEAF", 8)
    rng = np.random.default_rng(7)
    vectors = np.array(made(rng, 900, 6, 0.2), np.float32)
    eps = np.sqrt(0.1)
    basis = gj.principal(list(vectors), 3)
    units = gj.unit(vectors)
    order = np.lexsort(np.floor(gj.coordinates(units, basis) * 4 / eps).T[::-1])
    vectors, units = vectors[order], units[order]
    a, b = gj.Interval(vectors[:500], basis), gj.Interval(vectors[500:], basis)
    want = {(i, j) for i, j in np.argwhere(units @ units.T >= 0.95) if i < j}
    got = {(i, j) for x in a.links(a, 0.95, eps) for i, j in zip(*x, strict=True)} | {(i + 500, j + 500) for x in b.links(b, 0.95, eps) for i, j in zip(*x, strict=True)}
    got |= {(i, j + 500) for x in a.links(b, 0.95, eps) for i, j in zip(*x, strict=True)}
    assert got == want
    looked = sum(len(leaves) for _, leaves in a.beside(b, eps))
    assert looked < 0.7 * (500 / 8) * (400 / 8)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, nan, 3.0]), (7, [1.0, None, 3.0]), (8, [inf, 2.0, 3.0]), (9, [1.0, 2.0, 3.0, 0.0]), (10, [1.0]), (11, [5.0]), (12, [-5.0]), (12, v), (12, v), (None, v), (None, None), (0, [1e300, 2e300, 3e300]), (13, [1e-300, 2e-300, 3e-300]), (14, [-0.0, 1.0]), (15, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, Key string, place int").repartition(4)
    got = gj.near_vectors(df, block_rows=3)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = {(k, n, c, k == c) for k, n, c, _ in brute(rows)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert gj.near_vectors(df.filter("false")).count() == 0
    assert {tuple(r) for r in gj.near_vectors(df.filter("vec_id IN (3, 4, 5)")).collect()} == {(i, 0, i, True) for i in (3, 4, 5)}
    kept = gj.keep_one(df)
    assert kept.columns == df.columns and {r.vec_id for r in kept.collect()} >= {0, 3, None} and not {r.vec_id for r in kept.collect()} & {1, 2, 13}


def test_at_the_threshold():
    x = np.array([[3.0, 4.0, 0.0], [5.0, 0.0, 0.0]])
    a = gj.Interval(x, gj.principal(list(x), 2))
    assert [len(i) for i, _ in a.links(a, 0.6, 1.0)] == [1] and gj.exact_cosine(x[0], x[1]) == 0.6
    assert not sum(len(i) for i, _ in a.links(a, np.nextafter(0.6, 1), 1.0))


def test_one_group_holds_most(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=32)
    rows = [(i, (v + rng.normal(size=32) * 0.02).astype(np.float32).tolist()) for i in range(1500)] + [(1500 + i, v.astype(np.float32).tolist()) for i in range(1000)] + [(2500 + i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(500)]
    random.Random(1).shuffle(rows)
    got = gj.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), block_rows=200).collect()
    assert all((r.n_links, r.component_id) == (2499, 0) for r in got if r.vec_id < 2500)
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id >= 2500)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, gj.op11_embedding_near_dedup(spark, sf_dir).collect()), key=str) == brute(rows)

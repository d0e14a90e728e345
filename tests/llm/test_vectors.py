"""Centroid clustering and hard-negative mining against brute force in plain integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import rows

from sparkloom.llm import clusters, hardnegatives, queries
from sparkloom.llm.clusters import Tree, filtered
from sparkloom.llm.vectors import products


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(256 * float(x)) for x in vector]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_clusters(table, k=40, rounds=5, dim=64):
    kept = [(i, whole(v)) for i, v in table if v is not None and len(v) == dim and whole(v) is not None]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]

    def assign():
        return [min(range(len(centers)), key=lambda c: (far(v, centers[c]), c)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            centers[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    dist = [far(v, centers[c]) for (_, v), c in zip(kept, own)]
    spread = {c: sum(d for d, o in zip(dist, own) if o == c) for c in set(own)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, spread[c], sum(dist), digest[c]) for (i, _), c, d in zip(kept, own, dist)), key=repr)


def plain_negatives(table, positives=5, negatives=3):
    kept = [(i, lab, whole(v)) for i, lab, v in table if i is not None and lab is not None and whole(v) is not None]
    out = []
    for at, (i, lab, v) in enumerate(kept):
        if i % 50:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        pos = sorted(((-score(w), j) for b, (j, other, w) in enumerate(kept) if b != at and other == lab))[:positives]
        neg = sorted((-score(w), j) for j, other, w in kept if other != lab)
        for less, j in pos:
            hit = [(s, n) for s, n in neg if 50 * -less <= 100 * -s <= 95 * -less][:negatives]
            out += [(i, j, rank, n, -less, -s) for rank, (s, n) in enumerate(hit, 1)]
    return sorted(out, key=repr)


def odd_vectors(rng, dim, n):
    """Blobs, copies, ties, and vectors that are null, short, long, or hold nulls and numbers that aren't finite."""
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    made = [[x + rng.gauss(0, 0.3) for x in rng.choice(middles)] for _ in range(n)]
    made += [made[3]] * 40 + [[0.0] * dim] * 5 + [[1 / 256] * dim] * 3
    return [*made, None, [], [1.0] * (dim - 1), [1.0] * (dim + 1), [None] + [1.0] * (dim - 1), [float("nan")] * dim, [math.inf] + [0.5] * (dim - 1)]


ODD = "vec_id long, embedding array<double>, cluster int, id string, v int, `a.b` int"  # the last ones clash with names inside


@pytest.mark.parametrize(("dim", "k", "n"), [(64, 40, 300), (3, 5, 500), (2, 40, 9)])
def test_clusters_equal_brute_force(spark, dim, k, n):
    rng = random.Random(dim)
    table = list(enumerate(odd_vectors(rng, dim, n)))
    table += [(None, table[0][1]), table[1], table[1], (2, table[4][1])]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in table], ODD).repartition(3)
    assert rows(clusters.cluster_vectors(df, k=k, dim=dim)) == plain_clusters(table, k=k, dim=dim)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [0.5])], "vec_id long, embedding array<float>")
    got = clusters.cluster_vectors(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and rows(got) == []
    assert rows(clusters.cluster_vectors(df.limit(0))) == []


def test_components_beyond_exact_sums_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="don't fit a long"):
        clusters.cluster_vectors(df).collect()


def test_trees_split_and_filter_exactly():
    """Each point gets its nearest centroid although most nodes are assigned as a whole; equal centroids are the first."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(m, 3, (900, 2)) for m in (0, 60, 200)]).astype(np.int64)
    tree, order = Tree.build(points)
    assert (tree.points == points[order]).all() and tree.depth == 7 and (tree.sums[0] == points.sum(axis=0)).all()
    back = Tree.from_bytes(tree.to_bytes(), 2)
    centers = np.array([[0, 0], [60, 60], [60, 60], [200, 200], [1, 1]])
    found, whole_nodes = np.full(len(points), -1), []

    def node(place, begin, end, cluster):
        found[begin:end] = cluster
        whole_nodes.append(end - begin)

    def rest(places, own):
        found[places] = own

    filtered(back, centers, node, rest)
    want = ((tree.points[:, None, :] - centers) ** 2).sum(axis=2).argmin(axis=1)
    assert (found == want).all() and not (found == 2).any()
    assert max(whole_nodes) > 300 and sum(whole_nodes) > 1700


def test_products_are_exact_beyond_doubles():
    a = np.array([[1 << 27, 3], [-(1 << 27), 5]])
    assert products(a, a).tolist() == [[(1 << 54) + 9, 15 - (1 << 54)], [15 - (1 << 54), (1 << 54) + 25]]


@pytest.mark.parametrize("dim", [64, 6, 1])
def test_negatives_equal_brute_force(spark, dim):
    rng = random.Random(dim)
    vectors = odd_vectors(rng, dim, 400)
    table = [(10 * (i % 95), rng.choice([0, 1, 1, 2, None]), v) for i, v in enumerate(vectors)]  # ids repeat
    table += [(None, 1, vectors[0]), (50, 7, vectors[1]), (100, -3, [0.25] * dim), (150, -3, [0.25] * dim)]
    df = spark.createDataFrame([(i, v, lab, "x", 2, 3, 4) for i, lab, v in table], "vec_id long, embedding array<double>, label int, id string, v int, uid int, `a.b` int").repartition(3)
    want = plain_negatives(table)
    assert len(want) > 20
    assert sorted((tuple(r) for r in hardnegatives.mine(df, anchor=df["vec_id"] % 50 == 0).collect()), key=repr) == want


def test_negatives_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BLOCK", 3)
    monkeypatch.setattr(hardnegatives, "ROWS", 16)
    monkeypatch.setattr(hardnegatives, "ANCHORS", 2)
    rng = random.Random(9)
    table = [(i * 10, i % 3, v) for i, v in enumerate(odd_vectors(rng, 8, 80))]
    df = spark.createDataFrame([(i, lab, v) for i, lab, v in table], "vec_id long, label int, embedding array<float>")
    exact = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in table]
    assert sorted((tuple(r) for r in hardnegatives.mine(df, anchor=df["vec_id"] % 50 == 0).collect()), key=repr) == plain_negatives(exact)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, [0.5]), (50, None, [0.5])], "vec_id long, label int, embedding array<float>")
    assert rows(hardnegatives.mine(df, anchor=df["vec_id"] % 50 == 0)) == []
    assert rows(hardnegatives.mine(df.limit(0))) == []


def test_bounds_hold_and_filter():
    """No score lies outside its bounds, and on grouped vectors most rows are turned away without an exact score."""
    rng = np.random.default_rng(2)
    v = (rng.normal(0, 40, (1, 64)) * (rng.integers(0, 2, (2000, 1)) * 2 - 1) + rng.normal(0, 12, (2000, 64))).astype(np.int64)
    books = [hardnegatives._means(v[:, m * 4 : m * 4 + 4]) for m in range(16)]
    codes = np.stack([hardnegatives._codes(v[:, m * 4 : m * 4 + 4], b) for m, b in enumerate(books)], axis=1)
    left = np.stack([np.sqrt(((v[:, m * 4 : m * 4 + 4] - b[codes[:, m]]) ** 2).sum(axis=1)) for m, b in enumerate(books)], axis=1)
    block = hardnegatives.Anchors(np.arange(50), np.arange(50), np.zeros(50), v[:50], books)
    low, high = hardnegatives.bounds(block.tables(np.arange(50)), block.norms, codes, left)
    score = v @ v[:50].T
    assert (low <= score).all() and (score <= high).all()
    fifth = np.sort(score, axis=0)[-6]
    assert (high >= fifth).mean() < 0.5


def test_queries_equal_brute_force(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    shifted = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in table]
    assert sorted((tuple(r) for r in queries.op12_hard_negative_mining(spark, sf).collect()), key=repr) == plain_negatives(shifted)
    assert rows(queries.op13_centroid_clustering(spark, sf)) == plain_clusters([(i, v) for i, _, v in table])

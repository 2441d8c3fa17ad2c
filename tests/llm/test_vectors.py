from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm.vectors import Graph, adjacency, build, leads, near_vectors, robust_prune, search_shard, unit

ROWS = "vec_id long, embedding array<float>, label int, id string, v string"


def brute(x, ids):
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[link[i]].min(initial=label[i]), label[i]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, k in zip(ids, label):
        least[k] = min(least.get(k, i), i)
    return link.sum(1), np.array([least[k] for k in label])


def table(seed, n, d=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, n // 3, 3):  # pairs at cosines from 0.87 to 0.97
        c = rng.uniform(0.87, 0.97)
        o = rng.normal(size=d)
        o -= (o @ x[i]) * x[i]
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * o / np.linalg.norm(o)
    centre = x[0]
    for i in range(n - 60, n - 20):  # a dense group
        x[i] = centre + 0.03 * rng.normal(size=d)
    x[n - 20 :] = x[5]  # equal vectors
    return x.astype(np.float32)


@pytest.mark.parametrize("how", [Graph(shard_rows=150, sample=400), Graph(shard_rows=40, clusters=4), Graph(shard_rows=20, clusters=3, dealt=30, sample=200)])
def test_links_and_components(spark, how):
    x = table(1, 900)
    ids = np.random.default_rng(2).permutation(5000)[:900]
    rows = [(int(i), [float(y) for y in v], 0, "x", "y") for i, v in zip(ids, x)]
    got = {r["id"]: r for r in near_vectors(spark.createDataFrame(rows, ROWS), how=how).collect()}
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1))[:, None]
    links, parts = brute(y, ids)
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()
    assert (np.array([got[i]["component"] for i in ids]) == parts).mean() > 0.97


@pytest.mark.parametrize("block", [4096, 100])
def test_a_search_that_stays_below_the_recall_asked_for_is_made_exact(spark, block):
    x = table(3, 900)
    rows = [(i, [float(y) for y in v], 0, "x", "y") for i, v in enumerate(x)]
    how = Graph(shard_rows=40, sample=400, near=1, far=1, degree=1, beam=4, margin=0.0, probes=1, widenings=0, audit=8, block=block)
    got = {r["id"]: r for r in near_vectors(spark.createDataFrame(rows, ROWS), how=how).collect()}
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1))[:, None]
    links, parts = brute(y, np.arange(900))
    assert [got[i]["n_links"] for i in range(900)] == links.tolist()
    assert [got[i]["component"] for i in range(900)] == parts.tolist()


def test_troublesome_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [3e38, 3e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["id"] or 0, r["n_links"], r["component"]) for r in near_vectors(df).collect())
    assert got == [(0, 2, 7), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 2, 7), (8, 2, 7), (9, 1, 9), (9, 1, 9), (11, 0, 11)]
    assert near_vectors(df.limit(0)).count() == 0
    assert near_vectors(df.filter("vec_id = 3")).collect()[0]["n_links"] == 0
    assert near_vectors(df.filter("vec_id = 7").withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()[0]["component"] == 7


def test_pruned_edges_are_not_made_needless_by_shorter_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = x @ x.T
    cand = np.argsort(-sims, axis=1)[:, 1:20]
    out = robust_prune(x, 0, cand, 8, 1.2)
    for i in range(40):
        kept = [j for j in out[i] if j >= 0]
        assert kept[0] == cand[i][0]
        for a in range(len(kept)):
            for b in range(a + 1, len(kept)):
                assert 1.2 * np.linalg.norm(x[kept[a]] - x[kept[b]]) > np.linalg.norm(x[i] - x[kept[b]]) - 1e-9
    lists = build(x, Graph())
    assert len(lists) == 40 and all(i not in near for i, near in enumerate(lists))


def test_unit():
    assert unit([3.0, 4.0]).tolist() == pytest.approx([0.6, 0.8]) and unit([0.0]) is None and unit([None, 1.0]) is None


def test_a_search_goes_on_in_other_shards():
    how = Graph(near=3, far=1, degree=8, beam=4)
    rng = np.random.default_rng(1)
    x = np.array([0.0, 1.0, 0, 0]) + 0.05 * rng.normal(size=(8, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, near, to = np.arange(8), [np.array([(i + 1) % 8, 100 + i]) for i in range(8)], [np.array([3, 5 + i % 2]) for i in range(8)]
    adj, away, away_to = adjacency(ids, 3, near, to, 8)
    assert [a[a >= 0].tolist() for a in adj] == [[(i + 1) % 8] for i in range(8)]
    assert list(zip(away, away_to)) == [(i, 5 + i % 2) for i in range(8)]
    got = search_shard(ids, x, np.ones(8, bool), np.ones(8, np.int64), 3, near, to, np.array([500]), x[:1], how)
    assert sorted(got[got["hop"] >= 0]["hop"]) == [5, 6] and set(got[got["hop"] >= 0]["id"]) == {500}


def test_hops_find_what_the_routing_misses(spark):
    x = table(5, 900)
    rows = [(i, [float(y) for y in v], 0, "x", "y") for i, v in enumerate(x)]
    part = {}
    for hops in (0, 8):  # each vector is searched for in its home shard alone
        how = Graph(shard_rows=60, sample=400, probes=1, margin=0.0, widenings=0, recall=0.0, hops=hops)
        part[hops] = sum(r["n_links"] for r in near_vectors(spark.createDataFrame(rows, ROWS), how=replace(how, clusters=60)).collect())
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1))[:, None]
    assert part[0] <= part[8] <= brute(y, np.arange(900))[0].sum()


def test_edges_too_long_for_a_range_lead_nowhere():
    """A vector in whose range both ends of an edge are lies within one range of each: longer edges are no reason to go on."""
    how = Graph()
    low = how.threshold - how.slack
    a = np.arccos(low)
    angles = np.array([0.0, a, 1.99 * a, 2.01 * a, 3.0])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    home = np.array([3, 4, 5, 6, 7])
    lists = [np.array([1, 2, 3, 4]), np.array([0, 2, 3, 4])]
    assert [to.tolist() for to in leads(x, home, lists, how)] == [[4, 5, -1, -1], [3, 5, 6, -1 if 3.0 - a > 2 * a else 7]]
    rng = np.random.default_rng(2)
    y = rng.normal(size=(400, 3))
    y /= np.linalg.norm(y, axis=1)[:, None]
    to = np.stack(leads(y, np.arange(400), [np.arange(400)] * 400, how))
    sims = y @ y.T
    for q in y[:40]:  # no edge between two vectors of a range is cut
        near = np.flatnonzero(y @ q >= low)
        assert (to[np.ix_(near, near)] >= 0).all()
    assert (to < 0).any() and (sims[to < 0] < 2 * low * low - 1).all()

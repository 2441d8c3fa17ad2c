"""Near-duplicate embeddings over a robust-pruned flat graph built on overlapping cluster shards.

Equal vectors are collapsed first. Centroids fitted on a bounded sample give each vector a home shard and a
second one; a cluster too large for a shard is parted again by centroids of its own, fitted on a bounded sample of it, so
shards keep their size however many vectors there are. Each shard links its members to near neighbours, pruned so
that no edge is made needless by a shorter one, and to some far ones. The adjacency lists of a vector's shards are joined.
Every vector then searches the shards near it: greedily from the shard's medoids, then outward over everything in
range; where an edge of what is in range leads to another shard that it hasn't searched, it goes on there, unless the
edge is too long for both its ends to be in range. What is found is verified in double precision and counted in its home shard only, so no link counts twice. A sample
is audited against brute force after every round; below the recall asked for, the search is widened and repeated,
and after the last widening all vectors are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored
from veilspark.llm.components import connected_components


@dataclass(frozen=True)
class Graph:
    """sample bounds the vectors that centroids are fitted on, of all and of each cluster that is parted, clusters their number."""

    threshold: float = 0.9
    shard_rows: int = 1000
    clusters: int = 4096
    sample: int = 16384
    near: int = 24
    far: int = 8
    degree: int = 48
    candidates: int = 64
    alpha: float = 1.2
    beam: int = 32
    margin: float = 0.16
    probes: int = 12
    #: Nodes this far below the threshold are still walked over while the range is expanded.
    slack: float = 0.05
    #: Vectors first audited, linked ones that make an audit enough, vectors audited at most.
    audit: int = 256
    linked: int = 100
    audit_most: int = 16384
    #: Vectors of a block of the exact search.
    block: int = 4096
    #: Vectors of a large cluster that one task deals to its parts; rounds in which a search may go on in other shards.
    dealt: int = 8192
    hops: int = 8
    recall: float = 0.97
    widenings: int = 2
    seed: int = 9


def unit(v) -> np.ndarray | None:
    """v as a double-precision unit vector; None if null, empty, zero or with null or non-finite components."""
    if v is None or not len(v):
        return None
    x = np.array([np.nan if y is None else y for y in v] if isinstance(v, list) else v, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a cluster that runs empty is started again at random."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        norm = np.sqrt((s * s).sum(axis=1))
        empty = norm == 0
        s[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        norm[empty] = 1
        c = s / norm[:, None]
    return c


def build(x: np.ndarray, how: Graph) -> list[np.ndarray]:
    """Out-neighbours of each node: pruned near ones, pruned far ones, and edges back to those that chose it."""
    n = len(x)
    if n == 1:
        return [np.empty(0, np.int64)]
    rng, k = np.random.default_rng(how.seed), min(how.candidates, n - 1)
    lists = []
    for s in range(0, n, 512):
        sims = x[s : s + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -np.inf
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
        far = rng.integers(0, n, (len(sims), 4 * how.far))
        far = np.take_along_axis(far, np.argsort(-np.take_along_axis(sims, far, axis=1), axis=1, kind="stable"), axis=1)
        for cand, keep in ((near, how.near), (far, how.far)):
            lists.append(_edges(s, robust_prune(x, s, cand, keep, how.alpha)))
    e = np.concatenate(lists)
    e = np.unique(np.concatenate([e, e[:, ::-1]]), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    sim = np.einsum("nd,nd->n", x[e[:, 0]], x[e[:, 1]])
    e = e[np.lexsort((-sim, e[:, 0]))]
    return np.split(e[:, 1], np.searchsorted(e[:, 0], np.arange(1, n)))


def robust_prune(x: np.ndarray, s: int, cand: np.ndarray, keep: int, alpha: float) -> np.ndarray:
    """Of the candidates (nearest first) of nodes s, s+1, ..., those that no nearer kept one makes needless; -1 pads."""
    own = x[s : s + len(cand)]
    y = x[cand]
    d = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nkd->nk", own, y), 0))
    between = np.sqrt(np.maximum(2 - 2 * np.matmul(y, y.transpose(0, 2, 1)), 0))
    alive, out, rows = np.ones(cand.shape, bool), np.full((len(cand), keep), -1), np.arange(len(cand))
    for j in range(keep):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, j] = cand[rows, first][some]
        alive &= ~((alpha * between[rows, first] <= d) & some[:, None])
        alive[rows, first] = False
    return out


def _edges(s: int, out: np.ndarray) -> np.ndarray:
    r, c = np.nonzero(out >= 0)
    return np.stack([r + s, out[r, c]], axis=1)


def greedy(x: np.ndarray, adj: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once, `wide` nodes expanded a step: (nodes, similarities), -inf where a place is empty."""
    n, rows = len(q), np.arange(len(q))
    nodes = np.full((n, beam), 0)
    sims = np.full((n, beam), -np.inf, np.float32)
    nodes[:, : len(starts)], sims[:, : len(starts)] = starts, q @ x[starts].T
    opened = ~np.isfinite(sims)
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, starts] = True
    seen[:, -1] = True  # adjacency is padded with -1
    while True:
        open_sims = np.where(opened, -np.inf, sims)
        at = np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide]
        ok = np.take_along_axis(open_sims, at, axis=1) > -np.inf
        live = np.flatnonzero(ok.any(axis=1))
        if not len(live):
            return nodes, sims
        at, ok = at[live], ok[live]
        opened[live[:, None], at] = True
        near = np.where(ok[:, :, None], adj[nodes[live[:, None], at]], -1).reshape(len(live), -1)
        near.sort(axis=1)
        new = ~seen[live[:, None], near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        got = np.full(near.shape, -np.inf, np.float32)
        r, c = np.nonzero(new)
        got[r, c] = np.einsum("nd,nd->n", q[live[r]], x[near[r, c]])
        all_nodes, all_sims = np.concatenate([nodes[live], near], axis=1), np.concatenate([sims[live], got], axis=1)
        all_opened = np.concatenate([opened[live], ~new], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        nodes[live], sims[live], opened[live] = (np.take_along_axis(a, best, axis=1) for a in (all_nodes, all_sims, all_opened))


def leads(x: np.ndarray, home: np.ndarray, lists: list[np.ndarray], how: Graph) -> list[np.ndarray]:
    """The home shard of each neighbour, -1 where no vector has both ends of the edge in its range: angles to both add up to that between them at least."""
    low = how.threshold - how.slack
    least = 2 * low * low - 1 - 1e-9 if low > 0 else -np.inf
    return [np.where(x[near] @ x[i] >= least, home[near], -1) for i, near in enumerate(lists)]


def adjacency(ids: np.ndarray, shard: int, near: list, to: list, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The neighbours of each node of a shard by place, -1 where there are none; and (node, shard) of edges to home shards elsewhere. ids ascend."""
    lens = np.array([len(x) for x in near], np.int64)
    node, other, home = np.repeat(np.arange(len(ids)), lens), *(np.concatenate([np.asarray(x, np.int64) for x in a] or [np.empty(0, np.int64)]) for a in (near, to))
    at = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
    inside = ids[at] == other
    adj = np.full((len(ids), degree), -1)
    n, a = node[inside], at[inside]
    nth = np.arange(len(n)) - np.searchsorted(n, n)
    adj[n[nth < degree], nth[nth < degree]] = a[nth < degree]
    away = np.unique(np.stack([node, home], axis=1)[~inside & (home >= 0) & (home != shard)], axis=0)
    return adj, away[:, 0], away[:, 1]


def search_shard(ids: np.ndarray, x: np.ndarray, home: np.ndarray, weight: np.ndarray, shard: int, near: list, to: list, qid: np.ndarray, q: np.ndarray, how: Graph) -> pd.DataFrame:
    """(id, found, links, root, hop): the links of each query into the home members, by weight and distinct; stars that join what is
    linked; and other shards that edges of what is in a query's range lead to. ids ascend."""
    n = len(ids)
    adj, away, away_to = adjacency(ids, shard, near, to, how.degree)
    hops: list[np.ndarray] = []
    small = x.astype(np.float32)
    k = min(8, n, how.beam)
    medoids = np.unique((centroids(x, k, how.seed, 4) @ x.T).argmax(axis=1))
    everyone, back = np.unique(np.concatenate([qid, ids]), return_inverse=True)
    q_at, n_at = back[: len(qid)], back[len(qid) :]
    label, found, links = np.arange(len(everyone)), np.zeros(len(qid), np.int64), np.zeros(len(qid), np.int64)
    low = how.threshold - how.slack
    for s in range(0, len(q), 1024):
        part = q[s : s + 1024]
        nodes, sims = greedy(small, adj, medoids, part.astype(np.float32), how.beam)
        for i in np.flatnonzero((sims >= low).any(axis=1)):
            seen = np.zeros(n + 1, bool)
            seen[-1] = True
            front = np.unique(nodes[i][sims[i] >= low])
            seen[front] = True
            reached = [front]
            while len(front):
                near = np.unique(adj[front])
                near = near[~seen[near]]
                seen[near] = True
                front = near[small[near] @ part[i].astype(np.float32) >= low]
                reached.append(front)
            reached = np.concatenate(reached)
            if len(away):
                lo, hi = np.searchsorted(away, reached, "left"), np.searchsorted(away, reached, "right")
                if (shards := np.unique(np.concatenate([away_to[a:b] for a, b in zip(lo, hi)]))).size:
                    hops.append(np.stack([np.full(len(shards), qid[s + i]), shards]))
            hit = reached[(x[reached] @ part[i] >= how.threshold) & home[reached] & (ids[reached] != qid[s + i])]
            if len(hit):
                found[s + i], links[s + i] = weight[hit].sum(), len(hit)
                mine = np.append(n_at[hit], q_at[s + i])
                groups = np.unique(label[mine])
                if len(groups) > 1:
                    label[np.isin(label, groups)] = groups[0]
    stars = pd.DataFrame({"id": everyone, "found": 0, "links": 0, "root": everyone[label], "hop": -1})
    counted = pd.DataFrame({"id": qid, "found": found, "links": links, "root": qid, "hop": -1})
    onward = np.concatenate(hops, axis=1) if hops else np.empty((2, 0), np.int64)
    onward = pd.DataFrame({"id": onward[0], "found": 0, "links": 0, "root": onward[0], "hop": onward[1]})
    return pd.concat([stars[stars["id"] != stars["root"]], counted[counted["found"] > 0], onward])


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


ROUTED = "shard long, id long, home boolean, at long, n long, v binary"


def _routed(c: np.ndarray, parts: np.ndarray, how: Graph, queries: bool):
    """Rows (cluster, salt, shard, id, home, at, n, v): of members the two nearest clusters, of queries all near enough.

    A shard's number is its cluster's, where that isn't parted, else -1 and salt deals its rows out. at: the home shard, if known.
    """
    offset = np.concatenate([[0], np.cumsum(parts)])[:-1]
    shard_of = np.where(parts == 1, offset, -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 2048):
                p = b.iloc[s : s + 2048].reset_index(drop=True)
                sims = _matrix(p["v"]) @ c.T
                order = np.argsort(-sims, axis=1)[:, : how.probes if queries else 2]
                near = np.take_along_axis(sims, order, axis=1)
                take = near >= near[:, :1] - how.margin if queries else np.ones(near.shape, bool)
                r, j = np.nonzero(take)
                cluster = order[r, j]
                out = p.iloc[r].reset_index(drop=True)
                out["cluster"], out["shard"], out["home"], out["at"] = cluster, shard_of[cluster], j == 0, shard_of[order[r, 0]]
                ways = np.maximum(1, parts * how.shard_rows // how.dealt)
                out["salt"] = out["id"].to_numpy() * 2654435761 % 2147483647 % ways[cluster]
                yield out[["cluster", "salt", "shard", "id", "home", "at", "n", "v"]]

    return run


def _parted(parts: np.ndarray, how: Graph, queries: bool):
    """Rows of a large cluster with the shards of its own centroids near them: of members the nearest and, at home, the second."""
    offset = np.concatenate([[0], np.cumsum(parts)])[:-1]

    def run(p: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = ["shard", "id", "home", "at", "n", "v"]
        if p.empty or own.empty:
            return pd.DataFrame({c: [] for c in names})
        x = _matrix(p["v"])
        sims = x @ np.frombuffer(own["c"].iloc[0], np.float64).reshape(-1, x.shape[1]).T
        order = np.argsort(-sims, axis=1)[:, : how.probes if queries else 2]
        near = np.take_along_axis(sims, order, axis=1)
        home = p["home"].to_numpy()
        take = near >= near[:, :1] - how.margin if queries else np.arange(order.shape[1])[None, :] <= home[:, None]
        r, j = np.nonzero(take)
        first = offset[p["cluster"].iloc[0]]
        out = p.iloc[r].reset_index(drop=True)
        out["shard"] = first + order[r, j]
        out["at"] = np.where(home[r], first + order[r, 0], out["at"])
        out["home"] = home[r] & (j == 0)
        return out[names]

    return run


def _search(how: Graph):
    def search(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if m.empty or q.empty:
            return pd.DataFrame({"id": [], "found": [], "links": [], "root": [], "hop": []}).astype("int64")
        m, q = m.sort_values("id"), q.sort_values("id")
        return search_shard(m["id"].to_numpy(), _matrix(m["v"]), m["home"].to_numpy(), m["n"].to_numpy(), int(m["shard"].iloc[0]), list(m["near"]), list(m["to"]), q["id"].to_numpy(), _matrix(q["v"]), how)

    return search


def _one_dimension(reps: DataFrame, how: Graph) -> tuple[DataFrame, DataFrame]:
    """(id, found) and edges (id, root) of reps (id, n, v): distinct unit vectors of one dimension."""
    n = reps.count()
    below = lambda share: F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(1 << 30)) < share * (1 << 30)
    drawn = reps.filter(below(min(1.0, how.sample / max(1, n))))
    sample = _matrix(drawn.orderBy(F.xxhash64("id", F.lit(how.seed))).limit(2 * how.sample).select("v").toPandas()["v"]) if n > 1 else np.empty((0, 1))
    if len(sample) < 1:
        empty = reps.select("id", F.lit(0).cast("long").alias("found"), F.col("id").alias("root")).limit(0)
        return empty.select("id", "found"), empty.select("id", "root")
    c = centroids(sample, min(how.clusters, max(1, -(-n // how.shard_rows))), how.seed)
    schema = "cluster long, salt long, " + ROUTED
    one = np.ones(len(c), np.int64)
    sizes = reps.mapInPandas(_routed(c, one, how, False), schema).groupBy("cluster").count().collect()  # a row for each cluster
    parts = one.copy()
    for r in sizes:
        parts[r["cluster"]] = -(-r["count"] // how.shard_rows) if r["count"] > 4 * how.shard_rows else 1
    fine = None
    if (parts > 1).any():
        share = F.get(F.expr("array(" + ", ".join(f"{how.sample / (k * how.shard_rows):.9f}D" for k in parts) + ")"), F.col("cluster").cast("int"))

        def own(p: pd.DataFrame) -> pd.DataFrame:
            k = int(p["cluster"].iloc[0])
            x = _matrix(p.sort_values("id")["v"])
            got = centroids(x, int(parts[k]), how.seed)
            if len(got) < parts[k]:  # of a sample so small some are given twice
                got = got[np.arange(parts[k]) % len(got)]
            return pd.DataFrame({"cluster": [k], "c": [got.tobytes()]})

        inner = reps.mapInPandas(_routed(c, parts, how, False), schema).filter("home and shard < 0")
        fine = stored(inner.filter(below(share)).groupBy("cluster").applyInPandas(own, "cluster long, c binary"), "vector-centroids")
        ways = F.get(F.expr("array(" + ", ".join(str(max(1, int(k) * how.shard_rows // how.dealt)) for k in parts) + ")"), F.col("cluster").cast("int"))
        fine = fine.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (ways - 1).cast("long"))))

    def routed(how: Graph, queries: bool) -> DataFrame:
        rows = reps.mapInPandas(_routed(c, parts, how, queries), schema)
        if fine is None:
            return rows.drop("cluster", "salt")
        large = rows.filter("shard < 0").groupBy("cluster", "salt").cogroup(fine.groupBy("cluster", "salt")).applyInPandas(_parted(parts, how, queries), ROUTED)
        return rows.filter("shard >= 0").drop("cluster", "salt").unionByName(large)

    members = stored(routed(how, False), "vector-members")

    def link(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        ids, at = p["id"].to_numpy(), p["at"].to_numpy()
        lists = build(_matrix(p["v"]), how)
        return pd.DataFrame({"id": ids, "near": [ids[x] for x in lists], "to": leads(_matrix(p["v"]), at, lists, how)})

    lists = members.groupBy("shard").applyInPandas(link, "id long, near array<long>, to array<long>")
    union = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("near", "to")))).alias("e"))
    union = stored(union.select("id", F.col("e.near").alias("near"), F.col("e.to").alias("to")), "vector-graph")
    nodes = stored(members.join(union, "id"), "vector-nodes")
    how = replace(how, probes=max(how.probes, round(how.probes * (len(c) / 64) ** 0.5)))
    for widening in range(how.widenings + 1):
        got = _walk(nodes, stored(routed(how, True).select("shard", "id", "v"), "vector-queries"), reps, how)
        if recall(reps, got.groupBy("id").agg(F.sum("links").alias("links")), how, n) >= how.recall:
            break
        how = replace(how, beam=2 * how.beam, margin=2 * how.margin, probes=2 * how.probes)
    else:
        got = stored(_exact(reps, n, how), "vector-exact")
    return got.groupBy("id").agg(F.sum("found").alias("found")), got.select("id", "root")


def _walk(nodes: DataFrame, queries: DataFrame, reps: DataFrame, how: Graph) -> DataFrame:
    """What queries (shard, id, v) find there, and in the shards that edges lead to from what they found."""
    search = lambda q: nodes.groupBy("shard").cogroup(q.groupBy("shard")).applyInPandas(_search(how), LINKS)
    got = stored(search(queries), "vector-links")
    all_, asked, new = got, queries.select("shard", "id"), got
    for _ in range(how.hops):
        ahead = new.filter("hop >= 0").select(F.col("hop").alias("shard"), "id").distinct()
        ahead = stored(ahead.join(asked, ["shard", "id"], "left_anti"), "vector-hops")
        if not ahead.count():
            break
        new = stored(search(ahead.join(reps.select("id", "v"), "id").select("shard", "id", "v")), "vector-links")
        all_, asked = all_.unionByName(new), asked.unionByName(ahead)
    return all_.filter("hop < 0").drop("hop")


FOUND = "id long, found long, links long, root long"
LINKS = FOUND + ", hop long"


def _exact(reps: DataFrame, n: int, how: Graph) -> DataFrame:
    """All links and stars: every pair of blocks is compared in a task of its own."""
    k = max(1, -(-n // how.block))
    own = F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(k)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("other")
    dealt = reps.select("id", "n", "v", own.alias("own"), other).select("id", "n", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        ids, x, w = p["id"].to_numpy(), _matrix(p["v"]), p["n"].to_numpy()
        left = np.flatnonzero(p["own"] == p["lo"])
        right = np.flatnonzero(p["own"] == p["hi"])
        found, links, label = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.arange(len(p))
        same = p["lo"].iloc[0] == p["hi"].iloc[0]
        for s in range(0, len(left), 512):
            part = left[s : s + 512]
            near = (x[part] @ x[right].T >= how.threshold) & (part[:, None] != right[None, :])
            found[part] += near @ w[right]
            links[part] += near.sum(axis=1)
            if not same:
                found[right] += near.T @ w[part]
                links[right] += near.sum(axis=0)
            for i in np.flatnonzero(near.any(axis=1)):
                groups = np.unique(label[np.append(right[near[i]], part[i])])
                if len(groups) > 1:
                    label[np.isin(label, groups)] = groups[0]
        out = pd.DataFrame({"id": ids, "found": found, "links": links, "root": ids[label]})
        return out[(out["links"] > 0)]

    return dealt.groupBy("lo", "hi").applyInPandas(compare, FOUND)


def recall(reps: DataFrame, found: DataFrame, how: Graph, n: int) -> float:
    """Distinct links found of audited vectors over those of brute force: of all links or, if less, on average of the vectors.

    More vectors are drawn until enough have links. Where even the most of them have none, 0 unless these are all vectors.
    """
    size = how.audit
    while True:
        drawn = reps.orderBy(F.xxhash64("id", F.lit(how.seed + 1))).limit(size).select("id", "v").toPandas()
        ids, x = drawn["id"].to_numpy(), _matrix(drawn["v"])

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                there, other, v = np.zeros(len(ids), np.int64), b["id"].to_numpy(), _matrix(b["v"])
                for s in range(0, len(ids), 1024):
                    there[s : s + 1024] = ((x[s : s + 1024] @ v.T >= how.threshold) & (ids[s : s + 1024, None] != other[None, :])).sum(axis=1)
                yield pd.DataFrame({"id": ids[there > 0], "there": there[there > 0]})

        there = reps.select("id", "v").mapInPandas(count, "id long, there long").groupBy("id").agg(F.sum("there").alias("there"))
        own = F.coalesce("links", F.lit(0))
        r = there.join(found, "id", "left").agg(F.count("*"), F.sum("there"), F.sum(own), F.avg(own / F.col("there"))).first()
        if r[0] >= how.linked or size >= min(n, how.audit_most):
            break
        size = min(4 * size, max(how.audit, how.audit_most))
    if not r[0]:
        return 1.0 if size >= n else 0.0
    return min(r[2] / r[1], r[3])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", how: Graph | None = None) -> DataFrame:
    """(id, n_links, component) for each row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths (each length is a graph of its own). Equal vectors link with one another; a row without an id counts among their links and
    has a null component unless linked. Labels and other columns are not read. An empty table gives an empty one.
    """
    how = how or Graph()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e"))

    @F.pandas_udf("binary")
    def bytes_of(values: pd.Series) -> pd.Series:
        return pd.Series([None if (x := unit(v)) is None else x.tobytes() for v in values], dtype=object)

    rows = stored(rows.withColumn("v", bytes_of("e")).select("id", "v"), "vectors")
    # a group's number is made from its vector, as ids can repeat
    groups = rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    groups = stored(groups.select(F.xxhash64("v").alias("id"), "v", "least", "n"), "vector-groups")
    results = [_one_dimension(groups.filter(F.length("v") == r[0]).select("id", "n", "v"), how) for r in groups.select(F.length("v")).distinct().collect()]
    if not results:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found, edges = results[0]
    for f, e in results[1:]:
        found, edges = found.unionByName(f), edges.unionByName(e)
    parts = connected_components(edges, "id", "root")
    named = groups.join(found, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = stored(named.select("v", "least", "root", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("v", "n_links", "component")
    return rows.join(named, "v", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", F.col("id")).alias("component"))

import random

import numpy as np
import xxhash

from tests.llm.helpers import DOCS, clashing, documents, prose, words
from veilspark.llm.components import connected_components
from veilspark.llm.simhash import covering_masks, keep_one, near_duplicates, near_links


def plain(text):
    w = words(text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, links):
    at = {i: i for i in ids}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(2)
    docs = documents(9, 80)
    base = prose(rng, 400)
    for j in range(30):  # near copies, a word or two apart
        w = base.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(400)] = f"x{rng.randrange(50)}"
        docs.append((1000 + j, " ".join(w), "en", "s", 1))
    got = near_duplicates(clashing(spark.createDataFrame(docs, DOCS))).collect()
    fps = [(r[0], plain(r[1])) for r in docs]
    assert sorted((r["id"], r["fp"] & (2**64 - 1)) for r in got) == sorted(fps)
    links = [(a, b) for i, (a, x) in enumerate(fps) for b, y in fps[:i] if (x ^ y).bit_count() <= 3]
    want = groups([a for a, _ in fps], links)
    # one id may stand on two texts: each row is in the component of its own text
    once = {a for a, _ in fps if sum(a == c for c, _ in fps) == 1}
    assert all(r["component"] == want[r["id"]] for r in got if r["id"] in once and want[r["id"]] in once)


def test_covering_loses_no_pair():
    rng = random.Random(1)
    for masks in (covering_masks(), covering_masks(stride=4)):
        assert len(masks) == 15
        for _ in range(5000):
            diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3)))
            assert any(diff & m == 0 for m in masks)


def test_large_buckets_are_covered_again_and_chunked(spark):
    rng = random.Random(4)
    near = {0xABCDEF0123456789 ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)}
    fps = [x - (1 << 64) if x >> 63 else x for x in near] + [rng.getrandbits(63) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for bucket in (4096, 50, 8):
        links = [(r["a"], r["b"]) for r in near_links(df, bucket=bucket).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
        got = groups(fps, links)
        want = groups(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
        assert got == want


def test_every_bit_counts_alike(spark):
    rng = random.Random(6)
    fps, want = [], []
    for i in range(64):
        a = rng.getrandbits(64)
        fps += [a, a ^ (1 << i) ^ (1 << (i + 7) % 64)]
        want.append(tuple(sorted(fps[-2:])))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(sorted((r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)))) for r in near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == set(want)


def test_keep_one(spark):
    docs = [*documents(10, 20), (None, "a text without an id that is long enough", "en", None, 1), (None, "a text without an id that is long enough", "en", None, 1)]
    df = spark.createDataFrame(docs, DOCS)
    kept = keep_one(df).collect()
    assert keep_one(df).columns == df.columns
    ids = [r["doc_id"] for r in kept]
    assert ids.count(None) == 1 and len([i for i in ids if i]) == len({i for i in ids if i})
    assert 10 in ids and 16 not in ids and 19 not in ids  # copies of the fourth document
    assert keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000), (7, 7)]
    df = spark.createDataFrame(edges + [(None, 5)], "a long, b long")
    want = groups({x for e in edges for x in e}, edges)
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert connected_components(df.limit(0), "a", "b").count() == 0

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, WORD, clashing, documents
from veilspark.llm.mixing import Mix, mix, mixed_rows, split_quotas


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal = share * sum(sizes.values())
    full = set()
    while True:
        rest = goal - sum(cap * sizes[s] for s in full)
        level = rest / sum(w[s] for s in names if s not in full) if len(full) < len(names) else 0
        over = {s for s in names if s not in full and level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


@pytest.mark.parametrize("how", [Mix(), Mix(block_words=7, shard_words=64)])
def test_targets_and_words(spark, how):
    docs = documents(6)
    rows = mix(clashing(spark.createDataFrame(docs, DOCS), "id", "row", "h", "part", "a.b"), how=how).collect()
    assert len(rows) == len(docs)
    size, taken = Counter(), defaultdict(int)
    for r in docs:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets(size)
    for r in rows:
        got = sum(d["words"] for d in r["draws"])
        assert got <= 2 * r["size"] and r["source_size"] == size[r["row"]["source"]]
        assert r["target"] == pytest.approx(want[r["row"]["source"]])
        taken[r["row"]["source"]] += got
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


def test_reruns_agree_and_rows_are_cut(spark):
    df = spark.createDataFrame(documents(7), DOCS)
    shown = lambda: sorted(map(str, mixed_rows(mix(df)).collect()))
    assert shown() == shown()
    n = mixed_rows(mix(df)).agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    assert n == mix(df).agg(F.sum(F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"]))).first()[0]


@pytest.mark.parametrize("shards", [1, 8, 2048])
def test_quotas_are_exact_and_shards_even(spark, shards):
    slots = [100_000, 3, 0, 4567, 80]
    q = split_quotas(spark.createDataFrame(list(enumerate(slots)), "idx long, slots long"), shards, 1).collect()
    each, got = Counter(), Counter()
    for i in range(5):
        ranges = sorted((r["shard"], r["lo"], r["hi"]) for r in q if r["idx"] == i)
        assert all(a[2] == b[1] for a, b in zip(ranges, ranges[1:])) and all(lo < hi for _, lo, hi in ranges) and (not ranges or ranges[0][1] == 0)
        for shard, lo, hi in ranges:
            each[shard] += hi - lo
            got[i] += hi - lo
    assert [got[i] for i in range(5)] == slots and len(each) == shards
    assert max(each.values()) - min(each.values()) <= 1


def test_the_draw_follows_the_hypergeometric_distribution(spark):
    import math

    from veilspark.llm.mixing import hypergeometric

    n, k, m = 40, 12, 15
    rows = spark.range(4000).select(hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("x"))
    got = {r["x"]: r["count"] for r in rows.groupBy("x").count().collect()}
    for x in range(0, 13):
        p = math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)
        assert abs(got.get(x, 0) / 4000 - p) < 0.03


def test_blocks_are_disjoint_and_shards_differ(spark):
    rows = mix(spark.createDataFrame(documents(8), DOCS), how=Mix(block_words=5, shard_words=200)).collect()
    shards = {d["shard"] for r in rows for d in r["draws"]}
    assert len(shards) > 8
    for r in rows:
        assert len({d["pass"] for d in r["draws"]}) == len(r["draws"]) <= 3


def taken(rows):
    out = Counter()
    for r in rows:
        out[r["row"]["doc_id"], r["size"]] += sum(d["words"] for d in r["draws"])
    return out


def test_the_drawn_blocks_are_what_is_taken(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (5 + i % 7)), "en", f"s{i % 3}", 0) for i in range(600)], DOCS)
    one, two = (taken(mix(df, how=Mix(block_words=40, shard_words=300, seed=s)).collect()) for s in (1, 2))
    assert one != two and abs(sum(one.values()) - sum(two.values())) <= 3
    other = taken(mix(df, how=Mix(block_words=20, shard_words=300, seed=1)).collect())
    assert one != other  # other blocks, another mix
    # the partial pass doesn't take the beginning of the line: what it leaves lies among what it takes
    assert taken(mix(df, how=Mix(block_words=40, shard_words=300, seed=1)).collect()) == one


def test_rows_come_shard_by_shard(spark):
    df = spark.createDataFrame(documents(7), DOCS)
    parts = mixed_rows(mix(df, how=Mix(block_words=50, shard_words=400))).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "__shard", "__place").collect()
    assert len({r["__shard"] for r in parts}) > 4
    assert all(len({r["p"] for r in parts if r["__shard"] == s}) == 1 for s in {r["__shard"] for r in parts})
    seen = [(r["p"], r["__shard"], r["__place"]) for r in sorted(parts, key=lambda r: r["i"])]
    assert seen == sorted(seen)


def test_very_many_equal_rows(spark, monkeypatch):
    import veilspark.llm.mixing as M

    monkeypatch.setattr(M, "GROUP_ROWS", 50)
    rows = [(None, "a b c", "en", "x", 0)] * 700 + [(i, "d e", "en", "x" if i % 2 else None, 0) for i in range(300)]
    got = mix(spark.createDataFrame(rows, DOCS).repartition(4), how=Mix(block_words=30)).collect()
    want, words = targets({"x": 700 * 3 + 150 * 2, None: 300}), Counter()
    assert len(got) == 1000
    for r in got:
        t = sum(d["words"] for d in r["draws"])
        assert t <= 2 * r["size"]
        words[r["row"]["source"]] += t
    assert all(abs(words[s] - t) <= 1 for s, t in want.items())


def test_the_plan_has_no_array_of_shards_and_shuffles_rows_once(spark):
    m = mix(spark.createDataFrame(documents(8), DOCS))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "upto" not in plan and plan.count("Exchange hashpartitioning(source") == 1


def test_empty_and_wordless(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    r = mix(spark.createDataFrame([(1, None, None, None, 0), (None, "", None, "a", 0)], DOCS)).collect()
    assert [(x["size"], x["target"], x["draws"]) for x in r] == [(0, 0.0, []), (0, 0.0, [])]

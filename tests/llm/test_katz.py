import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, clashing, documents, words
from veilspark.llm.common import unpack, unpack_ints, words_of
from veilspark.llm.katz import END, MASK, Katz, Radix, _blocks, discounts, freeze, katz_ask, katz_fit, katz_scores, runs_of, thaw
from veilspark.llm.language import remainder

LEARN = lambda r: zlib.crc32(str(r[0]).encode()) % 7 != 2


def brute(docs, order=3, k=5, smooth=64, learn=LEARN, asked=None):
    """Scores of asked (docs), p(history, word), unigram counts, history totals and the mass of an unknown word, by plain loops."""
    texts = lambda rows: [["<start>", *words(r[1]), None] for r in rows]
    train = [t for t, r in zip(texts(docs), docs) if learn(r)]
    grams = {1: Counter((w,) for t in train for w in t[1:])}
    for m in range(2, order + 1):
        grams[m] = Counter(tuple(t[i - m + 1 : i + 1]) for t in train for i in range(m - 1, len(t)))

    def d_of(c):
        few = Counter(c.values())
        return discounts(np.array([0] + [few[i] for i in range(1, smooth + 2)]), k)[0]

    d = {m: d_of(c) for m, c in grams.items()}
    n, v = sum(grams[1].values()), len(grams[1])
    kept = lambda m, c: c * (d[m][c] if c <= k else 1)
    left = 1 - sum(kept(1, c) for c in grams[1].values()) / n if n else 1.0
    unseen = max(left, 1 / (n + 1))
    p1 = lambda w: kept(1, grams[1][w,]) / n * (1 - unseen) / (1 - left) if grams[1].get((w,)) else unseen
    total, mass, followers = Counter(), defaultdict(float), defaultdict(list)
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            total[g[:-1]] += c
            mass[g[:-1]] += kept(m, c)
            followers[g[:-1]].append(g[-1])
    weights = {}

    def weight(h):
        if h not in weights:
            rest, scale = 1 - mass[h] / total[h], 1.0
            if rest <= 1e-12:
                rest, scale = 1 / (total[h] + 1), total[h] / (total[h] + 1)
            weights[h] = scale, rest / (1 - sum(p(h[1:], w) for w in followers[h]))
        return weights[h]

    def p(h, w):
        if not h:
            return p1(w)
        if h not in total:
            return p(h[1:], w)
        scale, back = weight(h)
        c = grams[len(h) + 1].get((*h, w), 0)
        return scale * kept(len(h) + 1, c) / total[h] if c else back * p(h[1:], w)

    out = []
    for t in texts(docs if asked is None else asked):
        logs = [math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t))]
        out.append((len(t) - 1, sum((w,) in grams[1] for w in t[1:]), n, sum(math.log10((grams[1].get((w,), 0) + 1) / (n + v + 1)) for w in t[1:]), sum(logs)))
    return out, p, grams[1], total, unseen


def same(got, docs, want):
    key = lambda i, x: (i is None, i or 0, x[0], round(x[3], 4))
    a = sorted((key(r["id"], (r["n_tokens"], 0, 0, r["base_score"])), r["n_known"], r["train_tokens"], r["score"]) for r in got)
    b = sorted((key(d[0], w), w[1], w[2], w[4]) for d, w in zip(docs, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(
    "how",
    [Katz(), Katz(order=2, block_tokens=300, bucket_tokens=200, memory=10), Katz(block_tokens=500, bucket_tokens=900, fan=3), Katz(order=4, block_tokens=2000)],
    ids=["plain", "pairs in many buckets", "radix nodes", "order 4"],
)
def test_against_brute_force(spark, how):
    docs = documents(4)
    got = katz_scores(clashing(spark.createDataFrame(docs, DOCS)), remainder("doc_id", 7) != 2, how=how).collect()
    same(got, docs, brute(docs, how.order)[0])
    assert all(r["train"] == LEARN((r["id"],)) for r in got)


def test_a_stored_model_scores_other_texts(spark):
    docs, others = documents(4), [(i, t, None, None, 0) for i, t in enumerate(["w1 w2 w3 w4", "never w1 seen", None, documents(9)[3][1], documents(4)[2][1]])]
    how = Katz(block_tokens=3000, bucket_tokens=5000)
    model = katz_fit(spark.createDataFrame(docs, DOCS), remainder("doc_id", 7) != 2, how=how)
    assert model.table(spark, 3).count() > 1 and len(model.fitted.sources) == 3
    got = katz_ask(model, spark.createDataFrame(others, DOCS)).collect()
    same(got, others, brute(docs, asked=others)[0])


@pytest.mark.parametrize("order", [2, 3])
def test_the_model_adds_up_to_one(order):
    _, p, one, total, unseen = brute(documents(5), order)
    for h in [*list(total)[:40], *list(total)[-40:], ("never seen",), ("never", "seen")]:
        assert sum(p(h, w) for (w,) in one) + p(h, "unknown word") == pytest.approx(1, abs=1e-9)


def test_discounts():
    d, how = discounts(np.array([0, 100, 40, 20, 12, 8, 6]), 5)
    assert d[1] < 1 and how[0] == "turing"
    rest = 100 * 1 - sum(n * r * x for r, (n, x) in enumerate(zip([0, 100, 40, 20, 12, 8], d)))
    assert rest  # some mass is left for what was not seen
    for n in ([0] * 7, [0, 3, 0, 0, 0, 0, 0], [0, 1, 5, 9, 9, 9, 9]):
        d, how = discounts(np.array(n), 5)
        assert d[0] == 1 and ((d > 0) & (d <= 1)).all() and how[-1] == "half"
    line = np.array([0, *(int(1e6 * r**-2.2) for r in range(1, 66))])
    assert set(discounts(line, 5)[1]) == {"turing"}
    line[6] = 0  # no Turing estimate without it
    d, how = discounts(line, 5)
    assert set(how) == {"smoothed"} and (np.diff(d[1:]) > 0).all()


def test_empty_and_nothing_learned(spark):
    assert katz_scores(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0
    r = katz_scores(spark.createDataFrame([(1, "a b", None, None, 3), (None, None, None, None, None)], DOCS), F.lit(False)).collect()
    assert sorted((x["n_tokens"], x["n_known"], x["train_tokens"], x["score"]) for x in r) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_ids_of_any_size(spark):
    big = (1 << 62) + 1
    assert {r["id"] for r in katz_scores(spark.createDataFrame([(big, "a", None, None, 1), (None, "b", None, None, 1)], DOCS), F.lit(True)).collect()} == {big, None}


@pytest.mark.parametrize("buckets, fan", [(12, 256), (257, 256), (1728, 256), (300, 8), (65537, 256)])
def test_radix_nodes_hold_about_as_much_as_a_block(buckets, fan):
    """At every level the nodes that a block is split into are many enough: none gathers much more than a block asks."""
    radix = Radix(buckets, fan, buckets, 1)
    assert radix.width(radix.levels) == 1
    above = buckets
    for level in range(1, radix.levels + 1):
        width = radix.width(level)
        assert -(-above // width) <= fan + 1  # rows that a source is split into
        assert buckets / radix.groups(level) * width / buckets <= 2.1  # blocks of a node: its sources by its share of the buckets
        above = width


@pytest.mark.parametrize("top", [(5, 3), (1, 1 << 20, 1 << 20), (1 << 24, 1 << 24, 1 << 24), (1 << 62, 1 << 62), (7, 1 << 62, 9), (1, 1)])
@pytest.mark.parametrize("n", [0, 1, 3000])
def test_runs(top, n):
    rng = np.random.default_rng(n)
    columns = [rng.integers(t // 2, t, n)[rng.integers(0, max(1, n), n) // 3] for t in top]
    ids = np.arange(n) * 3 + 5
    for given in (None, ids):
        order, new = runs_of(columns, given)
        order = order if given is None else (order - 5) // 3
        assert sorted(order.tolist()) == list(range(n))
        rows = [tuple(int(c[i]) for c in columns) for i in order]
        assert rows == sorted(rows)
        assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(n)]


def test_runs_are_sorted_as_numbers():
    """The CPU seconds of op2_katz were mostly sorts of places: runs_of takes well under what those take."""
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 20, 1 << 20) for _ in range(2)]

    def least(f):
        took = []
        for _ in range(3):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: runs_of(columns)) < 0.7 * least(lambda: np.lexsort(columns[::-1]))


def test_frozen_pieces_thaw_together():
    rng = np.random.default_rng(2)
    rows = sorted(tuple(map(int, rng.integers(0, 1 << 62, 4) // (1 << 60, 1, 1, 1 << 60))) for _ in range(50))
    bucket, last, first, word = map(np.array, zip(*[(r[0], r[1], r[2], r[3]) for r in rows]))
    arrays, at = [bucket, first, last, word, rng.integers(0, 9, 50)], np.array([0, 7, 8, 30])
    got, sizes = thaw(list(freeze(arrays, 3, at)), 3)
    assert sizes.tolist() == [7, 1, 22, 20] and all((a == b).all() for a, b in zip(arrays, got))


ODD = ["", " ", None, " A b\tA\nÉ\x0b\x0cb ", "x\u0085y\u3000z\x1cq\x00", "a", "\r\n", "b" * 3000, "É é İ"]


@pytest.mark.parametrize("how", [Katz(), Katz(memory=1), Katz(memory=2, block_tokens=3)], ids=["one slice", "many slices", "many blocks"])
def test_blocks_hold_the_words_of_odd_texts(how, monkeypatch):
    calls = []
    digest = xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or digest(w))
    texts = ODD * 3
    batch = lambda s, e: pa.RecordBatch.from_pylist([{"id": None if i == 2 else i, "t": t, "train": i % 2 == 0} for i, t in enumerate(texts)][s:e], pa.schema([("id", pa.int64()), ("t", pa.string()), ("train", pa.bool_())]))
    got = []
    for b in _blocks(how)(iter([batch(0, 5), batch(5, 5), batch(5, len(texts))])):
        for r in b.to_pylist():
            vocab, codes, lens = np.cumsum(unpack_ints(r["vocab"])), unpack(r["codes"], np.uint32), unpack(r["lens"], np.int64)
            assert len(set(vocab.tolist())) == len(vocab) == len(set(codes.tolist()))
            by_code = vocab[np.argsort(unpack(r["code"], np.uint32))]
            cut = np.split(by_code[codes], np.cumsum(lens)[:-1])
            got += [(None if no else i, bool(t), x.tolist()) for i, no, t, x in zip(unpack_ints(r["ids"]).tolist(), unpack(r["nulls"], np.bool_), unpack(r["train"], np.uint8), cut)]
    assert got == [(None if i == 2 else i, i % 2 == 0, [digest(w) & MASK for w in words_of(t)] + [END & MASK]) for i, t in enumerate(texts)]
    if how == Katz():  # a word is hashed once in each batch, however often it comes
        assert sum(w != b"" for w in calls) == sum(len({w for t in texts[s:e] for w in words_of(t)}) for s, e in ((0, 5), (5, len(texts))))

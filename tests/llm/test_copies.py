import random

import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm.helpers import DOCS, clashing, documents, prose, words
from tests.llm.test_simhash import groups
from veilspark.llm import copies
from veilspark.llm.copies import Copies, keep_one_copy


def grams(text):
    w = words(text)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    """Rows that stay, by place: the first of each group of Jaccard 0.8 or more, ordered by id."""
    sets = [grams(r[1]) for r in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b) - 1e-9]
    return groups(range(len(rows)), links)


def near_copies(rng, base, edits):
    w = base.split()
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"x{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("how", [Copies(), Copies(small=3, chunk=8), Copies(small=3, chunk=8, sample=10)])
def test_against_brute_force(spark, how):
    rng = random.Random(5)
    rows = [r for r in documents(9, 40) if r[0] != 34]
    for g in range(12):  # pairs at similarities from about 0.7 to 0.95
        base = prose(rng, 150, 10**6)
        rows += [(2000 + 2 * g, base, "en", "s", 1), (2001 + 2 * g, near_copies(rng, base, rng.randint(1, 6)), "en", "s", 1)]
    base = prose(rng, 120, 10**6)
    rows += [(3000 + j, near_copies(rng, base, rng.randint(0, 4)), "en", "s", 1) for j in range(40)]  # a large group
    line = prose(rng, 20, 10**6)
    rows += [(4000 + j, line + " " + prose(rng, 12, 10**6), "en", "s", 1) for j in range(30)]  # a common passage
    want = brute(rows)
    least = {}
    for i, k in want.items():
        least[k] = min(least.get(k, rows[i][0]), rows[i][0])
    got = keep_one_copy(clashing(spark.createDataFrame(rows, DOCS), "g", "s", "k", "a.b"), how=how).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(least.values())


def test_stage_removes_near_copies_at_0_8(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for g in range(20):  # four words of 200 replaced: about 0.82
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
        rows += [(2 * g, base, "en", "s", 1), (2 * g + 1, near_copies(rng, base, 4), "en", "s", 1)]
    sets = [grams(r[1]) for r in rows]
    assert all(0.8 <= len(a & b) / len(a | b) < 0.95 for a, b in zip(sets[::2], sets[1::2]))
    got = P.near_duplicates(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 40, 2))


def test_two_texts_of_one_id_are_two_documents(spark, tmp_path):
    rng = random.Random(8)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(2))
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (2, b, "en", "s", 1), (None, a, "en", "s", 1), (None, None, "en", "s", 1)]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (1, a), (2, b)]
    assert P.near_duplicates(spark, spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0


@pytest.mark.parametrize("how", [Copies(small=3, chunk=8, dense=0), Copies(small=3, chunk=16, dense=1, shingle=2, similarity=0.6)])
def test_dense_groups_against_brute_force(spark, how):
    rng = random.Random(13)
    base, rows = prose(rng, 60, 10**6), []
    for j in range(60):  # about half of the pairs are similar
        rows.append((j, near_copies(rng, base, rng.randint(1, 8)), "en", "s", 1))
    shingles = [{tuple(words(r[1])[i : i + how.shingle]) for i in range(61 - how.shingle)} for r in rows]
    links = [(i, j) for i, a in enumerate(shingles) for j, b in enumerate(shingles[:i]) if len(a & b) >= how.similarity * len(a | b) - 1e-9]
    want = sorted(set(groups(range(len(rows)), links).values()))
    got = keep_one_copy(spark.createDataFrame(rows, DOCS), how=how).collect()
    assert sorted(r["doc_id"] for r in got) == want


def test_texts_of_a_common_passage_are_not_read_as_a_whole(spark):
    """Whole sets are for pairs that may be similar: what only shares a passage is told apart by a part of its shingles."""
    rng, how = random.Random(17), Copies(small=3, chunk=8)
    line = prose(rng, 20, 10**6)
    texts = [line + " " + prose(rng, 60, 10**6) for _ in range(30)]
    rows = spark.createDataFrame([(str(j), str(j), t) for j, t in enumerate(texts)], "k string, i string, t string")
    own = rows.mapInPandas(copies._prefixes(np.empty(0, np.uint64), np.empty(0, np.int64), how, False), "k string, i string, s long, n int, prefix array<long>, probe binary, fp long").cache()
    read = []

    def texts_of(who):
        read.append(who.count())
        return own.join(who, "s").join(rows.select("k", "t"), "k").select("s", "t")

    assert copies.similar_links(own.select("s", "n", "prefix", "probe"), texts_of, how).count() == 0
    assert sum(read) == 0, read

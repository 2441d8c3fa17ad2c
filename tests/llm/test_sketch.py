import hashlib

import numpy as np

from tests.llm.helpers import DOCS, clashing, documents, words
from veilspark.llm.sketch import Sketch, WordHashes, containment, edited_fingerprints, likeness, merge, retained, shingle_set, sketch, sketch_of, sketches, text_of


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edits_and_order(spark):
    docs = documents(12)
    got = edited_fingerprints(clashing(spark.createDataFrame(docs, DOCS))).collect()
    assert len(got) == len(docs)
    ordered = sorted(((r[0], hashlib.sha256((r[1] or "").encode()).digest(), r[1] or "") for r in docs), key=lambda x: x[:2])
    want = []
    for i, (key, _, t) in enumerate(ordered):
        nxt, half = ordered[(i + 1) % len(ordered)][2], len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want.append((key, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((r["id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        text.setdefault((r["id"], r["n_chars"]), r["fingerprint"])
    byid = {r[0]: r[1] for r in docs}
    same = {r["fingerprint"] for r in got if byid[r["id"]] == docs[3][1]}
    assert len(same) == 1  # equal texts


def test_small_tables(spark):
    assert edited_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    r = edited_fingerprints(spark.createDataFrame([(7, "abcd", None, None, 4)], DOCS)).collect()
    assert len(r) == 1 and r[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r[0]["near_next"] == 1.0
    r = edited_fingerprints(spark.createDataFrame([(None, None, None, None, None), (None, "x y", None, None, 3), (1, "", None, None, 0)], DOCS)).collect()
    assert sorted((x["id"] or 0, x["n_chars"]) for x in r) == [(0, 0), (0, 3), (1, 0)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likenesses_against_shingle_sets(spark):
    docs = [r for r in documents(17, 90) if r[0] != 34]
    got = {r["id"]: r for r in edited_fingerprints(spark.createDataFrame(docs, DOCS).dropDuplicates(["doc_id"])).collect()}
    ids = sorted(got)
    text = {r[0]: r[1] or "" for r in docs}
    for i, key in enumerate(ids):
        t, after = text[key], text[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        a, b, c = grams(t), grams(t[: len(t) - half] + after[:half]), grams(after)
        near = 1e-12 if max(len(a), len(b), len(c)) < 128 else 0.12
        assert abs(got[key]["near_edited"] - jaccard(a, b)) <= near and abs(got[key]["near_next"] - jaccard(a, c)) <= near
        if len(a) < 128 and c:
            assert got[key]["next_in_it"] == len(a & c) / len(c)
    assert any(0 < r["near_edited"] < 1 for r in got.values())


def test_estimates():
    how, seen = Sketch(scale=4), WordHashes(1000)
    a = " ".join(f"w{i}" for i in range(20_000))
    b = " ".join(f"w{i}" for i in range(10_000, 30_000))
    sa, sb = sketch(a, how, seen), sketch(b, how, seen)
    assert sa.scale == 4 and (sa.hashes < np.uint64(1 << 62)).all() and len(sa.hashes) == (shingle_set(a, how, seen) < np.uint64(1 << 62)).sum()
    true = jaccard(grams(a), grams(b))
    assert abs(likeness(sa, sb) - true) < 0.03 and likeness(sa, sa) == 1.0
    part = sketch(" ".join(f"w{i}" for i in range(500, 1500)), how, seen)  # short in long
    assert containment(part, sa) > 0.97 and containment(sa, part) < 0.1
    m = merge(sa, sb, how)
    assert abs(len(m.hashes) * 4 / len(grams(a) | grams(b)) - 1) < 0.05
    assert likeness(sketch(None, how, seen), sketch("", how, seen)) == 1.0 and likeness(sketch("", how, seen), sa) == 0.0
    assert sketch("Word", how, seen).hashes.tolist() == sketch("word\n", how, seen).hashes.tolist() and sketch("Word", how, seen).scale == 1


def test_short_texts_within_a_long_one():
    how, seen = Sketch(), WordHashes(1 << 18)
    long = [f"w{i}" for i in range(30_000)]
    whole = sketch(" ".join(long), how, seen)
    for n in (6, 10, 15, 40, 100):
        parts = [containment(sketch(" ".join(long[s : s + n]), how, seen), whole) for s in range(0, 29_000, 97)]
        assert set(parts) <= {1.0, None} and (n < 100 or None not in parts)  # unknown where no hash tells, never 0
        others = [containment(sketch(" ".join(f"v{i}" for i in range(s, s + n)), how, seen), whole) for s in range(0, 29_000, 97)]
        assert set(others) <= {0.0, None}


def test_merging_is_the_sketch_of_both():
    how, seen = Sketch(), WordHashes(1 << 18)
    for n, m in ((3, 5), (50, 60), (100, 100), (20, 500), (400, 900)):
        a, b = [f"w{i}" for i in range(n)], [f"w{i}" for i in range(n // 2, n // 2 + m)]
        x, y = (shingle_set(" ".join(w), how, seen) for w in (a, b))
        got, want = merge(retained(x, how), retained(y, how), how), retained(np.union1d(x, y), how)
        assert got.scale == want.scale and (got.hashes == want.hashes).all()
        assert sketch_of(text_of(got)).scale == got.scale and (sketch_of(text_of(got)).hashes == got.hashes).all()


def test_an_id_of_very_many_rows(spark):
    rows = [(None if i % 3 else i, f"text {i % 150}", None, None, 0) for i in range(400)]
    got = edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    ordered = sorted(((r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest(), r[1]) for r in rows))
    want = []
    for i, (some, key, _, t) in enumerate(ordered):
        nxt, half = ordered[(i + 1) % len(ordered)][3], len(t) // 2
        want.append((key if some else -1, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((-1 if r["id"] is None else r["id"], r["edited_sha256"]) for r in got) == sorted(want)


def test_sketch_column(spark):
    r = sketches(spark.createDataFrame([("a b c d e f", "x"), (None, "x")], "text string, fingerprint string")).collect()
    assert len(sketch_of(r[0]["fingerprint"]).hashes) == 2 and r[1]["fingerprint"] == "1:"

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import DOCS, clashing, documents
from veilspark.llm.packing import Packing, combinations, nnls, pack, plan
from veilspark.llm.tokens import encode, vocabulary_path


def check(rows, docs, window=2048):
    vocabulary = vocabulary_path("byte_bpe_50k.tiktoken")
    ids = defaultdict(list)
    for r in docs:
        ids[r[0]].append(np.append(encode(r[1], vocabulary), 1).astype("<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for key, whole in ids.items():
        for w in whole:
            same = [x for x in whole if len(x) == len(w)]
            got = sorted(pieces[key, len(w)], key=lambda r: r["start"])
            assert sum(r["length"] for r in got) == len(w) * len(same)
            for r in got:
                assert r["crc"] in {zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in same}
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return len(sequences)


def test_round_trip_of_all_kinds(spark):
    docs = documents()
    rows = pack(clashing(spark.createDataFrame(docs, DOCS))).collect()
    check(rows, docs)


def test_ids_and_small_windows(spark):
    docs = [r for r in documents(2, 30) if r[1] is not None]
    rows = pack(spark.createDataFrame(docs, DOCS), Packing(window=64, unit=4), keep_ids=True).collect()
    n = check(rows, docs, 64)
    assert all(zlib.crc32(r["ids"]) == r["crc"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert n * 64 < 1.1 * sum(r["length"] for r in rows)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def test_same_ids_as_the_tokenizers_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    vocabulary = vocabulary_path("byte_bpe_50k.tiktoken")
    texts = [r[1] for r in documents(3) if r[1]] + ["a  b\n\n\tc's 'll 123٤٥ ß\u00a0\u200b\x00 \ud7ff", "x" * 5000, " " * 3000, "…—“”🇩🇪👩‍👩‍👧"]
    for x in texts:
        assert t.encode(x, add_special_tokens=False).ids == encode(x, vocabulary).tolist()


def test_end_of_text_within_a_text_is_one_id():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for x in ("a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext", "x <|EndOfText|>"):
        assert t.encode(x, add_special_tokens=False).ids == encode(x, vocabulary_path("byte_bpe_50k.tiktoken")).tolist()
    assert max(encode("a<|endoftext|>b", vocabulary_path("byte_bpe_50k.tiktoken"), special=False)) < 50256  # for token files


@pytest.mark.parametrize("kind", ["log", "short", "mid", "uniform"])
def test_little_padding_for_any_lengths(kind):
    rng = np.random.default_rng(0)
    n = {"log": np.exp(rng.normal(6.8, 0.9, 20000)).astype(int) % 2048 + 1, "short": rng.normal(400, 120, 20000).clip(5, 2048).astype(int), "mid": rng.integers(1100, 1500, 20000), "uniform": rng.integers(1, 2049, 20000)}[kind]
    p = plan(np.bincount(-(-n // 8), minlength=257), Packing())
    assert n.sum() / (p.sequences * 2048) > 0.975
    taken = np.zeros(257, int)
    for k, a, b, *_ in p.segments:
        taken[k] += b - a
    assert (taken * np.arange(257)).sum() == (np.bincount(-(-n // 8), minlength=257) * np.arange(257)).sum()


def test_least_squares():
    rng = np.random.default_rng(1)
    a = rng.random((12, 20))
    x = np.where(rng.random(20) < 0.3, rng.random(20), 0)
    got = nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6
    assert nnls(np.eye(3), np.array([1.0, -1.0, 2.0])).tolist() == [1.0, 0.0, 2.0]
    assert set(combinations(4, 3)) == {(4,), (1, 3), (2, 2), (1, 1, 2)}

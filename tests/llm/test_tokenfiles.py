import numpy as np
import pytest

from tests.llm.helpers import DOCS, clashing, documents
from veilspark.llm.tokenfiles import SEPARATOR, scan_token_files, token_counts, write_token_files
from veilspark.llm.tokens import encode, vocabulary_path


def test_counts_of_all_kinds(spark):
    docs = documents(11)
    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    got = sorted((r["id"], r["n_tokens"]) for r in token_counts(clashing(spark.createDataFrame(docs, DOCS))).collect())
    assert got == sorted((r[0], len(encode(r[1], path))) for r in docs)
    assert token_counts(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for name in ("a", "b", "none", "only"):
        docs = {"a": [5, 0, 0, 40, 1, 3], "b": [0, 7], "none": [], "only": [9]}[name]
        ids = np.concatenate([np.append(rng.integers(0, 50000, n), SEPARATOR) for n in docs] or [[]])
        if name == "only":
            ids = ids[:-1]  # the last document isn't ended
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
        at = 0
        for i, n in enumerate(docs):
            want.append((name, i, at, n, name != "only"))
            at += n + 1
    got = scan_token_files(spark, f"file://{tmp_path}", ["a", "b", "none", "only"], block=block).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_broken_files_raise(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    for name in ("odd", "missing"):
        with pytest.raises(Exception, match="not whole ids"):
            scan_token_files(spark, f"file://{tmp_path}", [name]).collect()


def test_files_are_flat(spark, tmp_path):
    rows = write_token_files(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").coalesce(1), f"file://{tmp_path}/t").collect()
    ids = np.frombuffer((tmp_path / "t" / rows[0]["file"]).read_bytes(), "<u2")
    assert (ids == SEPARATOR).sum() == 2 and ids[-1] == ids[-2] == SEPARATOR

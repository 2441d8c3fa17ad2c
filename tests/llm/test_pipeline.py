from collections import Counter, defaultdict

import corpus_pipeline as P
from tests.llm.helpers import DOCS, clashing, documents
from tests.llm.test_mixing import targets
from tests.llm.test_packing import check
from tests.llm.test_simhash import groups, plain
from veilspark.llm.common import n_words


def test_stages_one_after_another(spark, tmp_path):
    docs = [r for r in documents(13)]
    df = spark.createDataFrame(docs, DOCS)
    kept = P.STAGES[0][1](spark, df, str(tmp_path))
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == df.columns
    gone = Counter(docs) - Counter(rows)
    # nothing goes but what has no letters, and perhaps lines of whose letters none was learned
    assert {None, "", "  \t\n "} <= {r[1] for r in gone} <= {None, "", "  \t\n ", "Été über 日本語 😀 mañana", "another text of the same id"}

    df = spark.createDataFrame(rows, DOCS)
    one = P.STAGES[1][1](spark, df, str(tmp_path))
    fps = [(r[0], plain(r[1])) for r in rows]
    want = groups([a for a, _ in fps], [(a, b) for i, (a, x) in enumerate(fps) for b, y in fps[:i] if (x ^ y).bit_count() <= 3])
    ids = [r["doc_id"] for r in one.collect()]
    assert sorted(ids) == sorted({k for k, v in want.items() if k == v}) and one.columns == df.columns

    rows = [tuple(r) for r in one.collect()]
    df = spark.createDataFrame(rows, DOCS)
    mixed = P.STAGES[2][1](spark, df, str(tmp_path))
    assert mixed.columns == df.columns
    size, got = Counter(), defaultdict(int)
    for r in df.select("source", n_words(df["text"]).alias("n")).collect():
        size[r["source"]] += r["n"]
    for r in mixed.select("source", n_words(mixed["text"]).alias("n")).collect():
        got[r["source"]] += r["n"]
    assert all(abs(got[s] - t) <= 1 for s, t in targets(size).items())

    rows = [tuple(r) for r in mixed.collect()]
    packed = P.STAGES[3][1](spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
    assert packed.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(packed.withColumnsRenamed({"doc_id": "id", "ids_crc32": "crc"}).collect(), rows)


def test_run(spark, tmp_path):
    clashing(spark.createDataFrame(documents(14), DOCS), "id", "t", "row", "__x", "__id", "__key", "__shard", "__row").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 50
    assert 4 <= len(P.STAGES) <= 5
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0

"""One query for each corpus operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    from veilspark.llm.packing import pack

    p = pack(docs)
    return p.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.katz import katz_scores
    from veilspark.llm.language import remainder

    s = katz_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return s.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.common import n_words, stored
    from veilspark.llm.mixing import mix

    sized = stored(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return mix(sized, size=F.col("size")).select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.simhash import near_duplicates

    named = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return named.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.tokenfiles import token_counts

    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").select("doc_id", "n_tokens")


#: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.urls import judge, prefix_rule

    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), [prefix_rule(*r) for r in URL_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH rules(verdict, h, p) AS (VALUES {rules}),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT u.page_id, u.host, u.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule,
  coalesce(arg_max(r.verdict, length(r.h || r.p)), 'allow') AS verdict
FROM u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
GROUP BY u.n, u.page_id, u.host, u.path
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.language import identify, remainder

    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    named = identify(table(spark, sf_dir, "documents"), ~held_out)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.sketch import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.vectors import near_vectors

    v = near_vectors(table(spark, sf_dir, "embeddings"))
    kept = F.col("id").eqNullSafe(F.col("component"))
    return v.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.common import new_path
    from veilspark.llm.warc import archive, read_archive

    path = new_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    r = read_archive(spark, path)
    key = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':([-0-9]*):[0-9a-f]*>$', 1) as bigint)")
    size = F.coalesce(F.length("payload"), F.col("http_length")).cast("long")
    return r.select(key("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", key("refers_to").alias("refers_to"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": OP6_SQL.format(rules=", ".join(map(str, URL_RULES)))}

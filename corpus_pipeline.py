"""The corpus pipeline: language ID, near-duplicate removal, mixing, packing. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import stored
from veilspark.llm.copies import keep_one_copy
from veilspark.llm.language import UNDETERMINED, identify, remainder
from veilspark.llm.mixing import mix, mixed_rows
from veilspark.llm.queries import packed

#: A document whose language has a lower score goes: hardly any of its letters fit a language learned.
LEAST_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; null, empty and letterless texts go, as do those of which hardly a letter was learned.

    Repeated rows are judged alike and all kept or gone; an empty table, and one that teaches nothing, gives an empty one.
    """
    learn_from = F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))
    named = identify(docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), learn_from)
    return named.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of least doc_id.

    Linked are texts of Jaccard similarity 0.8 or more in five-word shingles, and those of near SimHashes as in op4.
    Wordless texts are copies of one another. Of repeated rows one stays; of equal ids the least by a digest of the text; rows
    without an id stay only where no other of their group has one. An empty table gives an empty one.
    """
    return keep_one_copy(docs, fingerprints=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights, shard after shard and each in its shuffled order.

    A row for each time a document is taken, cut where a source's target ends within it, n_chars that of the text. A
    null source is one of its own; wordless texts are not taken; repeated rows are documents each; nothing gives nothing.
    """
    rows = mixed_rows(mix(docs))
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return rows.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in their sequences: a null text is its end id alone, repeated rows are packed each, nothing gives nothing."""
    return packed(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No stage but the first filter has a SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

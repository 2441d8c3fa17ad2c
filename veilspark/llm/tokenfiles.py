"""Token counts from flat unindexed token files: a vectorised search for the end-of-document id in blocks, stitched by a prefix scan.

A token file is nothing but unsigned 16-bit ids, each document ended by the separator. Files are read in blocks
by many tasks; a block tells where its separators are. A running maximum of the last separator and a running sum
of their number over a file's blocks give each block the document that is open where it starts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import new_path, partitions, stored
from veilspark.llm.tokens import encode, vocabulary_path
from veilspark.llm.warc import filesystem

#: The vocabulary leaves this id free.
SEPARATOR = 50256
BLOCK = 8 << 20


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """(file, doc_no, id): what was written where. Each task writes one file; those of lost tasks are in no row. Null text: no token."""
    path = path or vocabulary_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = filesystem(folder)
        where.create_dir(root, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.tokens", 0, None
        for b in batches:
            out = out or where.open_output_stream(f"{root}/{name}", compression=None)
            for t in b["t"]:
                ids = encode(t, path, special=False)  # the separator's id must not occur within
                if len(ids) and ids.max() >= separator:
                    raise ValueError("a token's id is not below the separator")
                out.write(np.append(ids, separator).astype("<u2").tobytes())
            yield pd.DataFrame({"file": name, "doc_no": np.arange(n, n + len(b)), "id": b["id"]})
            n += len(b)
        if out:
            out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"file string, doc_no long, id {kind}")


def scan_token_files(spark: SparkSession, folder: str, files: DataFrame | list[str], separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(file, doc_no, start, n_tokens, ended) for each document of the files, the separator not counted.

    files are names, or a table (file) of them; tasks look up their sizes. Tokens after a file's last separator are a
    document that is not ended; an empty file has none. A file of an odd number of bytes raises, as does one that
    isn't there. block is a number of bytes and may be smaller than a document.
    """

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = filesystem(folder)
        for b in batches:
            sizes = [fs.get_file_info(f"{top}/{n}").size for n in b["file"]]
            if odd := [n for n, s in zip(b["file"], sizes) if s is None or s % 2]:
                raise ValueError(f"not whole ids: {odd[0]}")
            yield pd.DataFrame({"file": b["file"], "size": sizes})

    if isinstance(files, list):
        files = spark.createDataFrame([(n,) for n in files], "file string")
    files = files.select("file").mapInPandas(sized, "file string, size long").filter("size > 0")
    blocks = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = filesystem(folder)
        for b in batches:
            rows = []
            for name, size, at in zip(b["file"], b["size"], b["at"]):
                with fs.open_input_file(f"{top}/{name}") as f:
                    f.seek(int(at))
                    ids = np.frombuffer(f.read(int(min(block, size - at))), "<u2")
                seps = np.flatnonzero(ids == separator) + int(at) // 2
                rows.append((name, int(at), int(size) // 2, seps, len(seps), int(seps[-1]) if len(seps) else -1, at + block >= size))
            yield pd.DataFrame(rows, columns=["file", "at", "ids", "seps", "n", "last", "final"])

    schema = "file string, at long, ids long, seps array<long>, n long, last long, final boolean"
    found = blocks.repartition(partitions(spark), "file", "at").mapInPandas(run, schema)
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).withColumn("no", F.coalesce(F.sum("n").over(before), F.lit(0)))
    tail = F.greatest(F.col("open"), F.col("last") + 1)
    ends = F.transform("seps", lambda x: F.struct(x.alias("end"), F.lit(True).alias("ended")))
    ends = F.when(F.col("final") & (tail < F.col("ids")), F.concat(ends, F.array(F.struct(F.col("ids").alias("end"), F.lit(False).alias("ended"))))).otherwise(ends)
    carried = carried.withColumn("ends", ends)
    starts = F.concat(F.array("open"), F.transform("seps", lambda x: x + 1))
    each = carried.select("file", "no", "ends", starts.alias("starts")).select("file", "no", "starts", F.posexplode("ends").alias("i", "e"))
    start = F.element_at("starts", F.col("i") + 1)
    return each.select("file", (F.col("no") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("e.end") - start).alias("n_tokens"), F.col("e.ended").alias("ended"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, doc_no, start) for each row of docs, counted in token files that are written for it.

    Nulls and empty texts count 0. Repeated rows, and rows of one id, are counted each on its own; null ids stay null.
    An empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    listed = stored(write_token_files(docs, folder, id_col, text_col, path), "token-files")
    counted = scan_token_files(spark, folder, listed.select("file").distinct())
    # both sides grow with the corpus: never broadcast, however well they compress
    return listed.join(counted.hint("merge"), ["file", "doc_no"]).select("id", "n_tokens", "doc_no", "start")

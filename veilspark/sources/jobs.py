"""Whole jobs over files: a document, an archive, a folder. Staged inputs are removed whatever happens."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.engine import Policy
from veilspark.plans.audit import certificate_counts, certificate_text
from veilspark.sources.files import KINDS, MOST_BYTES, discover, file_kind, key_of, masked_and_reported, no_reader, read_files, write_files, zip_archives, zip_members

#: The masked content of a file and the rows (text, pii_types) of its report.
Masker = Callable[[bytes], tuple[bytes, list[tuple[str, list[str]]]]]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def stage(spark: SparkSession, folder: str, name: str, data: bytes) -> str:
    """Where an upload waits: raw_<uuid>_<name>."""
    path = f"{folder}/raw_{uuid.uuid4()}_{posixpath.basename(name)}"
    put(spark, path, data)
    return path


def mask_archives(files: DataFrame, policy: Policy | None = None, maskers: dict[str, Masker] | None = None) -> DataFrame:
    """(archive, content, report): archives of the masked members, and the reports of all of them as (name, text, pii_types).

    maskers[kind](content) gives (masked content, [(text, pii_types)]) for kinds that aren't masked here. A member that fails,
    and one of a kind that nothing masks, becomes an error file; none is passed on as it was.
    """
    members = zip_members(files)
    kind = file_kind(F.col("name"))
    own = members.filter(kind.isin([k for k in ("docx", "pdf") if k not in (maskers or {})]) & F.col("error").isNull())
    done, report = masked_and_reported(own.select("path", "content"), policy)
    done, errors = done.select("path", "masked"), done.filter("error is not null").select("path", F.col("error").alias("broken"))
    if maskers:
        others = members.filter(kind.isin(*maskers) & F.col("error").isNull()).select("path", "name", "content").mapInPandas(_masked_by(maskers), "path string, masked binary, broken string, report array<struct<text:string,pii_types:array<string>>>")
        errors = errors.unionByName(others.filter("broken is not null").select("path", "broken"))
        done = done.unionByName(others.filter("broken is null").select("path", "masked"))
        report = report.unionByName(others.select("path", F.explode("report").alias("r")).select("path", "r.text", "r.pii_types"))
    out = members.filter("name is not null").join(done, "path", "left").join(errors, "path", "left")
    why = F.coalesce("error", "broken", F.when(F.col("masked").isNull(), no_reader(kind)))
    error = F.when(why.isNotNull(), F.concat(F.lit("Failed to process "), F.col("name"), F.lit(": "), why))
    zipped = zip_archives(out.select("archive", "name", F.when(why.isNull(), F.col("masked")).alias("masked"), error.alias("error")))
    rows = report.join(members.select("path", "archive", "name"), "path").groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("name", "text", "pii_types"))).alias("report"))
    return zipped.join(rows, "archive", "left").withColumn("report", F.coalesce("report", F.array().cast("array<struct<name:string,text:string,pii_types:array<string>>>")))


def _masked_by(maskers: dict[str, Masker]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, name, content in zip(b["path"], b["name"], b["content"]):
                try:
                    masked, report = maskers[KINDS[name.rsplit(".", 1)[-1].lower()]](content)
                    row = (path, masked, None, [{"text": t, "pii_types": list(k)} for t, k in report])
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    row = (path, None, f"{type(e).__name__}: {e}", [])
                yield pd.DataFrame([row], columns=["path", "masked", "broken", "report"])

    return run


def process_document(spark: SparkSession, raw: str, out: str, policy: Policy | None = None, organisation: str = "", when: str = "") -> dict:
    """Masks a staged DOCX or PDF to out, with a certificate of what was removed beside it; the staged file goes even on failure.

    The certificate counts a report's rows by type, as many as there are paragraphs or pages with it.
    """
    try:
        done, report = masked_and_reported(read_files(spark, raw), policy)
        masked = done.first()
        if masked is None or masked["masked"] is None:
            raise ValueError(f"Failed to process {posixpath.basename(raw)}: {masked['error'] if masked else 'no reader for this kind'}")
        counts = certificate_counts(report.select(F.explode("pii_types").alias("entity")))
        rows = sorted((tuple(r) for r in counts.collect()), key=lambda r: (r[0] == "Total", r[0]))
        put(spark, out, bytes(masked["masked"]))
        audit_id = uuid.uuid4().hex
        put(spark, f"{out}.certificate.txt", certificate_text(rows, organisation, posixpath.basename(raw), audit_id, when).encode())
        return {"output": out, "certificate": f"{out}.certificate.txt", "items": report.count(), "audit_id": audit_id}
    finally:
        delete(spark, raw)


def cloud_scan(spark: SparkSession, path: str, policy: Policy | None = None, mode: str = "discovery", prefix: str = "", out: str | None = None) -> dict:
    """Counts of files scanned and with findings; the report by key is out/report.json. In mode `sanitize` word-processor files and PDFs with
    findings are also written, masked, as out/sanitized/<key>, by the tasks that mask them."""
    report = discover(spark, path, policy, prefix).collect()  # one row for each listed file, whose number is capped
    hit = [r for r in report if r["items_found"]]
    if mode == "sanitize" and hit:
        files = read_files(spark, path, most=MOST_BYTES).filter(F.col("path").isin([r["path"] for r in hit]))
        masked = masked_and_reported(files, policy)[0].filter("masked is not null")
        write_files(masked.select(key_of(spark, path, F.col("path")).alias("key"), F.col("masked").alias("content")), f"{out or path}/sanitized").count()
    if out:
        rows = [{"file": r["file"], "pii_detected": r["pii_detected"], "items_found": r["items_found"]} if r["error"] is None else {"file": r["file"], "error": r["error"]} for r in report]
        put(spark, f"{out}/report.json", json.dumps(rows, indent=2).encode())
    return {"files_scanned": len(report), "files_with_pii": len(hit)}

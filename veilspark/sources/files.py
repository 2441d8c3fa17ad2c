"""Files in and out: datasets, word-processor files, archives, scans of folders. Parallel by file; sizes are guarded."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.persons import has_contact, name_line_tokens_ok, tokens_of
from veilspark.functions.spans import types_of
from veilspark.operators.documents import splice_runs
from veilspark.operators.engine import Policy, detect, sanitize
from veilspark.sources.pdf import read_words, redact

MAX_UPLOAD_BYTES = 100 << 20
MAX_UNZIPPED_BYTES = 500 << 20
MAX_LISTED = 50
KINDS = {"pdf": "pdf", "docx": "docx", "jpg": "image", "jpeg": "image", "png": "image", "webp": "image", "zip": "zip", "csv": "dataset", "jsonl": "dataset"}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    """What follows the last full stop, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_kind(path: Column) -> Column:
    """pdf, docx, image, zip or dataset; null for what isn't taken."""
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.try_element_at(kinds, extension(path))


def upload_status(length: Column, most: int = MAX_UPLOAD_BYTES) -> Column:
    """413 for too large, 400 for empty, else 202."""
    return F.when(length > most, 413).when(length == 0, 400).otherwise(202)


def read_files(spark: SparkSession, path: str, glob: str | None = None, most: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """(path, name, length, content) of the files under a path but for empty ones and those over `most` bytes, the upload cap."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path).filter(upload_status(F.col("length"), most) == 202)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def key_of(spark: SparkSession, root: str, path: Column) -> Column:
    """A listed path relative to the root that was listed; of a root that is a file or a pattern, the file's name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 20)).otherwise(F.element_at(F.split(path, "/"), -1))


def list_files(spark: SparkSession, path: str, prefix: str = "", most: int = MAX_LISTED) -> DataFrame:
    """(path, key, length) of the first files by key, the path below the root, that start with the prefix; the limit is the feature."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", key_of(spark, path, F.col("path")).alias("key"), "length")
    return df.filter(F.col("key").startswith(prefix)).orderBy("path").limit(most)


def read_dataset(spark: SparkSession, path: str, kind: str | None = None, force_string: bool = False, multiline: bool = True) -> DataFrame:
    """CSV with a header and inferred types, or one JSON object a line. Columns that infer as numbers are not scanned later, unless force_string.

    With multiline, quoted cells may hold line breaks, but a file is then read by one task; without, large files are split.
    """
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", not force_string).option("multiLine", multiline).option("escape", '"').csv(path)
    if kind == "jsonl":
        return spark.read.option("primitivesAsString", force_string).json(path)
    raise ValueError(f"no dataset: {path}")


def write_dataset(df: DataFrame, path: str, kind: str) -> None:
    """CSV with a header and nulls as empty, or JSON lines with nulls kept."""
    if kind == "csv":
        df.write.option("header", True).option("escape", '"').csv(path)
    elif kind == "jsonl":
        df.write.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(kind)


def sanitize_dataset(spark: SparkSession, path: str, out: str, policy: Policy | None = None, language: str | None = None, kind: str | None = None, force_string: bool = False, multiline: bool = True) -> int:
    """Rows processed, as counted by the write itself; an empty dataset writes nothing."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    df = read_dataset(spark, path, kind, force_string, multiline)
    if df.isEmpty():
        return 0
    rows = Observation()
    write_dataset(sanitize(df, policy, language).observe(rows, F.count(F.lit(1)).alias("n")), out, kind)
    return int(rows.get["n"])


# ---- word-processor files -------------------------------------------------------------------------------------


def _paragraphs(content: bytes) -> Iterator[tuple[str, str, int, object]]:
    """(part, label, number, element) of a file's paragraphs: body, table cells, headers and footers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = ["word/document.xml", *sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n))]
        for part in parts:
            root = ElementTree.fromstring(z.read(part))
            cells = {id(p) for t in root.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
            for i, p in enumerate(root.iter(f"{W}p")):
                yield part, "DOCX Header/Footer" if part != "word/document.xml" else "DOCX Table Cell" if id(p) in cells else "DOCX Paragraph", i, p


def _run_text(run) -> str:
    return "".join({f"{W}t": x.text or "", f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}.get(x.tag, "") for x in run)


def docx_runs(files: DataFrame) -> DataFrame:
    """(path, part, para, label, run_idx, text) of the runs of each file; what isn't in a plain run isn't seen. Files that can't be
    read give one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "part", "para", "label", "run_idx", "text", "error"]
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = []
                try:
                    for part, label, i, p in _paragraphs(content):
                        rows += [(path, part, i, label, j, _run_text(r), None) for j, r in enumerate(p.findall(f"{W}r"))]
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({"para": "Int64", "run_idx": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, part string, para long, label string, run_idx long, text string, error string")


def docx_paragraphs(runs: DataFrame) -> DataFrame:
    """(path, part, para, label, text, name_lines): texts of runs, and the header's name line as a candidate span of paragraph 0."""
    from pyspark.sql import Window

    ordered = F.array_sort(F.collect_list(F.struct("run_idx", "text")))
    paras = runs.filter("error is null").groupBy("path", "part", "para", "label").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))
    body = Window.partitionBy("path", "part", "label").orderBy("para")
    after = F.array_join(F.collect_list("text").over(body.rowsBetween(1, 3)), " ")
    first = (F.row_number().over(body) == 1) & (F.col("label") == "DOCX Paragraph")
    ok = first & name_line_tokens_ok(tokens_of(F.col("text"))) & has_contact(after)
    lines = F.when(ok, F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return paras.withColumn("name_lines", lines)


def docx_spans(paragraphs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(path, part, para, label, start, end, entity_type)."""
    found = paragraphs.withColumn("spans", detect(F.col("text"), policy, None, F.col("name_lines")))
    return found.select("path", "part", "para", "label", F.explode("spans").alias("s")).select("path", "part", "para", "label", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.entity_type").alias("entity_type"))


def docx_report(spans: DataFrame) -> DataFrame:
    """(path, text, pii_types): a row for each paragraph with a span, named by its label."""
    each = spans.groupBy("path", "part", "para", "label").agg(F.array_sort(F.collect_set("entity_type")).alias("pii_types"))
    return each.select("path", F.col("label").alias("text"), "pii_types")


def mask_docx(files: DataFrame, policy: Policy | None = None) -> DataFrame:
    """files (path, content) with `masked`: the file with its spans replaced run by run. Files without a span come back as they are."""
    policy = policy or Policy()
    runs = docx_runs(files)
    spans = docx_spans(docx_paragraphs(runs), policy)
    keys = ["path", "part", "para"]
    touched = runs.filter("error is null").join(spans.select(*keys).distinct(), keys, "left_semi").select(*keys, "run_idx", "text")
    new = splice_runs(touched, spans.select(*keys, "start", "end", "entity_type"), keys, policy.style)
    edits = new.groupBy("path").agg(F.collect_list(F.struct("part", "para", "run_idx", "text")).alias("edits"))

    @F.pandas_udf("binary")
    def rewrite(contents: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([c if e is None else _rewritten(c, e) for c, e in zip(contents, edits)], dtype=object)

    return files.join(edits, "path", "left").withColumn("masked", rewrite("content", "edits")).drop("edits")


def _rewritten(content: bytes, edits) -> bytes:
    texts: dict[str, dict[tuple[int, int], str]] = {}
    for e in edits:
        texts.setdefault(e["part"], {})[e["para"], e["run_idx"]] = e["text"]
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name in z.namelist():
            data = z.read(name)
            if name in texts:
                root = ElementTree.fromstring(data)
                for i, p in enumerate(root.iter(f"{W}p")):
                    for j, r in enumerate(p.findall(f"{W}r")):
                        if (i, j) in texts[name] and _run_text(r) != texts[name][i, j]:
                            for x in [x for x in r if x.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr")]:
                                r.remove(x)
                            t = ElementTree.SubElement(r, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                            t.text = texts[name][i, j]
                data = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            to.writestr(name, data)
    return out.getvalue()


# ---- pages with a text layer -----------------------------------------------------------------------------------


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page, words, head, after, error): the words of each page in order, its first line and the three after it. A file that can't be read
    in full is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page", "words", "head", "after", "error"]
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    pages: dict[int, list[tuple]] = {}
                    for w in read_words(bytes(content)):
                        pages.setdefault(w[0], []).append(w)
                    rows = []
                    for page, words in pages.items():
                        lines: dict[int, list[str]] = {}
                        for w in words:
                            lines.setdefault(w[7], []).append(w[5])
                        text = [" ".join(x) for x in lines.values()]
                        rows.append((path, page, [w[5] for w in words], text[0], " ".join(text[1:4]), None))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype({"page": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, page long, words array<string>, head string, after string, error string")


def pdf_spans(pages: DataFrame, policy: Policy | None = None) -> DataFrame:
    """pages with spans of the text that the words make, and gone: the places of the words that a span touches. One projection."""
    named = (F.col("page") == 0) & name_line_tokens_ok(tokens_of(F.col("head"))) & has_contact(F.col("after"))
    lines = F.when(named, F.array(F.struct(F.lit(0).alias("start"), F.length("head").alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    found = pages.filter("error is null").withColumn("text", F.array_join("words", " ")).withColumn("spans", detect(F.col("text"), policy, None, lines))
    start = "aggregate(words, named_struct('at', 0, 'out', cast(array() as array<struct<a:int,b:int>>)), (s, w) -> named_struct('at', s.at + length(w) + 1, 'out', concat(s.out, array(named_struct('a', s.at, 'b', s.at + length(w))))), s -> s.out)"
    placed = found.withColumn("places", F.when(F.size("spans") > 0, F.expr(start)).otherwise(F.expr("cast(array() as array<struct<a:int,b:int>>)")))
    hit = "transform(filter(transform(places, (p, i) -> named_struct('i', i, 'hit', exists(spans, s -> p.a < s.`end` and p.b > s.`start`))), x -> x.hit), x -> x.i)"
    return placed.withColumn("gone", F.expr(hit)).drop("places")


def pdf_report(spans: DataFrame) -> DataFrame:
    """(path, text, pii_types): a row for each page with a span."""
    return spans.filter(F.size("spans") > 0).select("path", F.lit("PDF Page Content").alias("text"), types_of(F.col("spans")).alias("pii_types"))


def mask_pdf(files: DataFrame, policy: Policy | None = None) -> DataFrame:
    """files (path, content) with `masked`, the file without the words that a span touches, and `error` where it can't be read or rewritten."""
    pages = pdf_pages(files)
    gone = pdf_spans(pages, policy).groupBy("path").agg(F.collect_list(F.struct("page", "gone")).alias("pages"))
    errors = pages.filter("error is not null").select("path", F.col("error").alias("unread"))

    @F.pandas_udf("struct<masked binary, error string>")
    def rewrite(contents: pd.Series, pages: pd.Series) -> pd.DataFrame:
        out = []
        for c, p in zip(contents, pages):
            try:
                out.append((None if p is None else redact(bytes(c), {int(x["page"]): {int(i) for i in x["gone"]} for x in p}), None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["masked", "error"])

    done = files.join(gone, "path", "left").join(errors, "path", "left").withColumn("r", rewrite("content", "pages"))
    return done.select(*files.columns, F.when(F.col("unread").isNull(), F.col("r.masked")).alias("masked"), F.coalesce("unread", "r.error").alias("error"))


def masked_and_reported(files: DataFrame, policy: Policy | None = None) -> tuple[DataFrame, DataFrame]:
    """Of files (path, content) of kinds that are masked here: (path, masked, error) and the report (path, text, pii_types)."""
    kind = file_kind(F.col("path"))
    docx, pdf = files.filter(kind == "docx").select("path", "content"), files.filter(kind == "pdf").select("path", "content")
    runs = docx_runs(docx)
    broken = runs.filter("error is not null").select("path", "error")
    one = mask_docx(docx, policy).select("path", "masked").join(broken, "path", "left")
    two = mask_pdf(pdf, policy).select("path", "masked", "error")
    report = docx_report(docx_spans(docx_paragraphs(runs), policy)).unionByName(pdf_report(pdf_spans(pdf_pages(pdf), policy)))
    return one.unionByName(two).withColumn("masked", F.when(F.col("error").isNull(), F.col("masked"))), report


# ---- words of pages and lines of images: the reader is given --------------------------------------------------


def page_words(files: DataFrame, extract: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(path, page, word_idx, x0, y0, x1, y1, word, block, line, word_no) of what extract(content) gives for each file: (page, x0, y0, x1,
    y1, word, block, line, word_no), put in order of position. Pages without words have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                words = sorted(extract(content), key=lambda w: (w[0], w[2], w[1]))
                pages: dict[int, int] = {}
                rows = []
                for w in words:
                    i = pages[w[0]] = pages.get(w[0], -1) + 1
                    rows.append((path, w[0], i, *w[1:]))
                yield pd.DataFrame(rows, columns=["path", "page", "word_idx", "x0", "y0", "x1", "y1", "word", "block", "line", "word_no"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, word_idx int, x0 double, y0 double, x1 double, y1 double, word string, block int, line int, word_no int")


def image_lines(files: DataFrame, read: Callable[[bytes], list[tuple[list[tuple[float, float]], str]]]) -> DataFrame:
    """(path, line, text, box) of what read(content) gives: (four corners, text) for each line. Nothing read: no row; an error is raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(path, i, text, [{"x": float(x), "y": float(y)} for x, y in box]) for i, (box, text) in enumerate(read(content))], columns=["path", "line", "text", "box"])

    return files.select("path", "content").mapInPandas(run, "path string, line int, text string, box array<struct<x:double,y:double>>")


# ---- archives and folders -------------------------------------------------------------------------------------


def zip_members(files: DataFrame, most: int = MAX_UNZIPPED_BYTES) -> DataFrame:
    """(archive, path, name, content, error): the members that can be processed. An archive over the cap when unpacked, or one that
    can't be read, is one row with an error; of a broken member the row has the error. Other kinds are left out."""
    kept = tuple(f".{k}" for k, v in KINDS.items() if v in ("pdf", "docx", "image"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["archive", "path", "name", "content", "error"]
        for b in batches:
            for archive, content in zip(b["path"], b["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    if sum(i.file_size for i in z.infolist()) > most:
                        raise ValueError("uncompressed size is over the cap")
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(archive, archive, None, None, f"{type(e).__name__}: {e}")], columns=names)
                    continue
                for i in z.infolist():
                    if i.is_dir() or not i.filename.lower().endswith(kept):
                        continue
                    try:
                        row = (archive, f"{archive}!{i.filename}", i.filename, z.read(i), None)
                    except Exception as e:  # noqa: BLE001
                        row = (archive, f"{archive}!{i.filename}", i.filename, None, f"{type(e).__name__}: {e}")
                    yield pd.DataFrame([row], columns=names)

    return files.select("path", "content").mapInPandas(run, "archive string, path string, name string, content binary, error string")


def zip_archives(members: DataFrame) -> DataFrame:
    """(archive, content) of members (archive, name, masked, error): masked_<name>, or error_<name>.txt with the error."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data, error in sorted(zip(p["name"], p["masked"], p["error"]), key=lambda x: str(x[0])):
                if error is not None:
                    z.writestr(f"error_{name}.txt", error)
                elif data is not None:
                    z.writestr(f"masked_{name}", data)
        return pd.DataFrame({"archive": [p["archive"].iloc[0]], "content": [out.getvalue()]})

    return members.select("archive", "name", "masked", "error").groupBy("archive").applyInPandas(of, "archive string, content binary")


#: The largest file that Spark gives as one value.
MOST_BYTES = (1 << 31) - 1


def discover(spark: SparkSession, path: str, policy: Policy | None = None, prefix: str = "", most: int = MAX_LISTED, extra_report: DataFrame | None = None) -> DataFrame:
    """(path, file, pii_detected, items_found, error) for each listed file, file being its key below the root.

    Word-processor files and PDFs with a text layer are scanned here; of images and other PDFs, extra_report (path, pii_types) has the
    items, and without it they have an error, as have files too large to be read: what wasn't looked at is never reported as
    clean. Datasets count as scanned and report nothing.
    """
    try:
        listed = list_files(spark, path, prefix, most)
        files = read_files(spark, path, most=MOST_BYTES).join(listed.select("path"), "path", "left_semi")
        listed.limit(1).count()
    except Exception as e:
        raise ValueError(f"Failed to connect: {e}") from e
    runs, pages = docx_runs(files.filter(file_kind(F.col("path")) == "docx")), pdf_pages(files.filter(file_kind(F.col("path")) == "pdf"))
    items = docx_report(docx_spans(docx_paragraphs(runs), policy)).unionByName(pdf_report(pdf_spans(pages, policy))).select("path", "pii_types")
    if extra_report is not None:
        items = items.unionByName(extra_report.select("path", "pii_types"))
    found = items.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pii_types")))).alias("pii_detected"), F.count("*").alias("items_found"))
    unread = pages if extra_report is None else pages.join(extra_report.select("path"), "path", "left_anti")
    broken = runs.select("path", "error").unionByName(unread.select("path", "error")).filter("error is not null").select("path", F.col("error").alias("broken"))
    kind = file_kind(F.col("path"))
    error = F.when(F.col("length") > MOST_BYTES, "too large to be read").when(kind.isin("docx", "pdf") & (F.col("length") == 0), "empty")
    error = error.otherwise(F.coalesce("broken", F.when((kind == "image") & F.lit(extra_report is None), no_reader(kind))))
    out = listed.join(found, "path", "left").join(broken, "path", "left")
    return out.select("path", F.col("key").alias("file"), F.coalesce("pii_detected", F.array().cast("array<string>")).alias("pii_detected"), F.coalesce("items_found", F.lit(0)).alias("items_found"), error.alias("error"))


def no_reader(kind: Column) -> Column:
    return F.concat(F.lit("no reader for this kind: "), kind)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.json(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (key, content) below the folder, each by the task that holds it and under its name only when whole; (key) of those written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        root = folder if "://" in folder else "file://" + re.sub("^file:", "", folder)
        where, top = fs.FileSystem.from_uri(root)
        for b in batches:
            for key, content in zip(b["key"], b["content"]):
                to = f"{top}/{key}"
                where.create_dir(to.rpartition("/")[0], recursive=True)
                draft = f"{to}.{uuid.uuid4().hex}.part"
                with where.open_output_stream(draft, compression=None) as out:
                    out.write(content)
                where.move(draft, to)
            yield b[["key"]]

    return files.select("key", "content").mapInPandas(run, "key string")

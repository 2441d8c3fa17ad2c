import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators.engine import Policy
from veilspark.sources import files as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(*runs):
    return "<w:p>" + "".join(f"<w:r><w:rPr>{'<w:b/>' if bold else ''}</w:rPr><w:t xml:space='preserve'>{t}</w:t></w:r>" for t, bold in runs) + "</w:p>"


def docx(body, header=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {W}>{header}</w:hdr>")
    return out.getvalue()


def test_docx_runs_keep_their_format(spark):
    content = docx(
        paragraph(("Priya Examplewala", False)) + paragraph(("Call me at +1 (", False), ("212) 555-", True), ("0100 today.", False)) + "<w:tbl><w:tr><w:tc>" + paragraph(("cell a@example.com", False)) + "</w:tc></w:tr></w:tbl>",
        paragraph(("head b@example.com", False)),
    )
    files = spark.createDataFrame([("x.docx", content), ("bad.docx", b"not a zip")], "path string, content binary")
    p = Policy(["PHONE_NUMBER", "EMAIL_ADDRESS", "PERSON"])
    runs = S.docx_runs(files)
    assert runs.filter("error is not null").select("path").collect()[0][0] == "bad.docx"
    report = {(r["text"], tuple(r["pii_types"])) for r in S.docx_report(S.docx_spans(S.docx_paragraphs(runs), p)).collect()}
    assert report == {("DOCX Paragraph", ("PHONE_NUMBER",)), ("DOCX Paragraph", ("PERSON",)), ("DOCX Table Cell", ("EMAIL_ADDRESS",)), ("DOCX Header/Footer", ("EMAIL_ADDRESS",))}
    out = S.mask_docx(files, p).filter("path = 'x.docx'").first()["masked"]
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        xml, head = z.read("word/document.xml").decode(), z.read("word/header1.xml").decode()
    assert "[PHONE_NUMBER_MASKED]" in xml and " today." in xml and "555" not in xml and "Priya" not in xml and xml.count("<ns0:b") + xml.count("<w:b") >= 1
    assert "[EMAIL_ADDRESS_MASKED]" in head


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in members.items():
            z.writestr(n, d)
    return out.getvalue()


def test_archives(spark):
    good = archive({"a.docx": docx(paragraph(("a@example.com", False))), "b.csv": "x", "c.docx": b"broken"})
    files = spark.createDataFrame([("good.zip", good), ("big.zip", archive({"a.docx": b"0" * 5000})), ("no.zip", b"?")], "path string, content binary")
    m = S.zip_members(files, most=4000).cache()
    assert m.filter("error is not null").count() == 2
    assert sorted(r[0] for r in m.filter("error is null").select("name").collect()) == ["a.docx", "c.docx"]
    done = m.select("archive", "name", F.col("content").alias("masked"), F.when(F.col("name") == "c.docx", "bad").alias("error")).filter("archive = 'good.zip'")
    z = zipfile.ZipFile(io.BytesIO(S.zip_archives(done).first()["content"]))
    assert sorted(z.namelist()) == ["error_c.docx.txt", "masked_a.docx"]


def test_datasets(spark, tmp_path):
    (tmp_path / "in.csv").write_text("name,card,note\nx,4111111111111111,mail a@example.com\ny,,\n")
    n = S.sanitize_dataset(spark, f"file://{tmp_path}/in.csv", f"file://{tmp_path}/out", Policy(["EMAIL_ADDRESS", "CREDIT_CARD"]), kind="csv")
    rows = {r["name"]: r for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out").collect()}
    assert n == 2 and rows["x"]["card"] == "4111111111111111" and "a@example.com" not in rows["x"]["note"]
    S.sanitize_dataset(spark, f"file://{tmp_path}/in.csv", f"file://{tmp_path}/all", Policy(["CREDIT_CARD"]), kind="csv", force_string=True)
    assert "4111111111111111" not in {r["card"] for r in spark.read.option("header", True).csv(f"file://{tmp_path}/all").collect()}
    (tmp_path / "in.jsonl").write_text('{"a": "b@example.com", "n": {"x": "c@example.com"}}\n{"a": null}\n')
    assert S.sanitize_dataset(spark, f"file://{tmp_path}/in.jsonl", f"file://{tmp_path}/outj", Policy(["EMAIL_ADDRESS"])) == 2
    text = "".join(r[0] for r in spark.read.text(f"file://{tmp_path}/outj").collect())
    assert "b@example.com" not in text and "c@example.com" in text and "null" in text
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert S.sanitize_dataset(spark, f"file://{tmp_path}/empty.csv", f"file://{tmp_path}/none") == 0 and not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        S.read_dataset(spark, "x.exe")


def test_discovery(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(paragraph(("a@example.com", False))))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.csv").write_text("a@example.com\n")
    r = {x["file"]: x for x in S.discover(spark, f"file://{tmp_path}", Policy(["EMAIL_ADDRESS"])).collect()}
    assert r["a.docx"]["pii_detected"] == ["EMAIL_ADDRESS"] and r["a.docx"]["items_found"] == 1
    assert r["b.docx"]["error"] and r["c.csv"]["pii_detected"] == [] and r["c.csv"]["error"] is None
    assert S.list_files(spark, f"file://{tmp_path}", prefix="a").count() == 1
    with pytest.raises(ValueError):
        S.discover(spark, f"file://{tmp_path}/nowhere")


def test_words_and_lines_by_a_given_reader(spark):
    files = spark.createDataFrame([("p", b"one two")], "path string, content binary")
    w = S.page_words(files, lambda c: [(0, 60.0, 0.0, 90.0, 10.0, "two", 0, 0, 1), (0, 0.0, 0.0, 30.0, 10.0, "one", 0, 0, 0)])
    assert [(r["word_idx"], r["word"]) for r in w.orderBy("word_idx").collect()] == [(0, "one"), (1, "two")]
    lines = S.image_lines(files, lambda c: [([(0, 0), (100, 0), (100, 10), (0, 10)], "mail a@example.com")])
    assert lines.first()["box"][1]["x"] == 100.0

import io
import json
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest

from tests.test_sources import archive, docx, paragraph
from veilspark.operators.engine import Policy
from veilspark.plans import policy as P
from veilspark.sources import jobs as J
from veilspark.sources.tables import append, read_table

MAIL = Policy(["EMAIL_ADDRESS"])


def test_document_job_cleans_up(spark, tmp_path):
    raw = J.stage(spark, f"file://{tmp_path}", "x.docx", docx(paragraph(("write a@example.com", False)) + paragraph(("b@example.com", False))))
    r = J.process_document(spark, raw, f"file://{tmp_path}/out.docx", MAIL, "Org", "today")
    assert r["items"] == 2 and not list(tmp_path.glob("raw_*"))
    text = zipfile.ZipFile(io.BytesIO(J.get(spark, r["output"]))).read("word/document.xml").decode()
    assert "example.com" not in text and "EMAIL_ADDRESS\t2" in J.get(spark, r["certificate"]).decode()
    bad = J.stage(spark, f"file://{tmp_path}", "y.docx", b"")
    with pytest.raises(Exception):  # noqa: B017
        J.process_document(spark, bad, f"file://{tmp_path}/o2", MAIL)
    assert not list(tmp_path.glob("raw_*"))


def test_archive_job(spark):
    pages = {"pdf": lambda content: (content.replace(b"b@example.com", b"*"), [("PDF Page Content", ["EMAIL_ADDRESS"])])}
    data = archive({"a.docx": docx(paragraph(("a@example.com", False))), "b.docx": b"broken", "c.csv": "left out", "d.pdf": b"write b@example.com", "e.png": b"b@example.com"})
    files = spark.createDataFrame([("x.zip", data)], "path string, content binary")
    r = J.mask_archives(files, MAIL).first()
    z = zipfile.ZipFile(io.BytesIO(r["content"]))
    assert sorted(z.namelist()) == ["error_b.docx.txt", "error_d.pdf.txt", "error_e.png.txt", "masked_a.docx"]
    assert z.read("error_d.pdf.txt") == b"Failed to process d.pdf: PdfError: not a PDF"
    assert z.read("error_e.png.txt") == b"Failed to process e.png: no reader for this kind: image"
    assert [tuple(x) for x in r["report"]] == [("a.docx", "DOCX Paragraph", ["EMAIL_ADDRESS"])]
    r = J.mask_archives(files, MAIL, pages).first()
    z = zipfile.ZipFile(io.BytesIO(r["content"]))
    assert sorted(z.namelist()) == ["error_b.docx.txt", "error_e.png.txt", "masked_a.docx", "masked_d.pdf"] and z.read("masked_d.pdf") == b"write *"
    assert not [n for n in z.namelist() if n.startswith("masked_") and b"b@example.com" in z.read(n)] and len(r["report"]) == 2


def test_cloud_scan(spark, tmp_path):
    for d in ("in/x", "in/y"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "in" / "x" / "a.docx").write_bytes(docx(paragraph(("a@example.com", False))))
    (tmp_path / "in" / "y" / "a.docx").write_bytes(docx(paragraph(("b@example.com", False))))
    (tmp_path / "in" / "b.docx").write_bytes(docx(paragraph(("nothing", False))))
    (tmp_path / "in" / "p.pdf").write_bytes(b"c@example.com")
    got = J.cloud_scan(spark, f"file://{tmp_path}/in", MAIL, "sanitize", out=f"file://{tmp_path}/out")
    assert got == {"files_scanned": 4, "files_with_pii": 2}
    report = {r["file"]: r for r in json.loads((tmp_path / "out" / "report.json").read_text())}
    assert sorted(report) == ["b.docx", "p.pdf", "x/a.docx", "y/a.docx"] and report["p.pdf"] == {"file": "p.pdf", "error": "PdfError: not a PDF"}
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.docx*")) == ["sanitized/x/a.docx", "sanitized/y/a.docx"]
    text = zipfile.ZipFile(tmp_path / "out" / "sanitized" / "y" / "a.docx").read("word/document.xml").decode()
    assert "example.com" not in text
    assert J.cloud_scan(spark, f"file://{tmp_path}/in", MAIL, prefix="y/") == {"files_scanned": 1, "files_with_pii": 1}


def test_a_file_over_the_upload_cap_is_scanned(spark, tmp_path):
    import numpy as np

    big = io.BytesIO(docx(paragraph(("a@example.com", False))))
    with zipfile.ZipFile(big, "a", zipfile.ZIP_STORED) as z:
        z.writestr("word/media/noise.bin", np.random.default_rng(0).bytes(101 << 20))
    (tmp_path / "big.docx").write_bytes(big.getvalue())
    assert J.read_files(spark, f"file://{tmp_path}").count() == 0  # uploads are capped
    assert J.cloud_scan(spark, f"file://{tmp_path}", MAIL) == {"files_scanned": 1, "files_with_pii": 1}


def test_tables(spark, tmp_path):
    assert read_table(spark, f"file://{tmp_path}", "dlp_policies").count() == 0
    append(spark.createDataFrame([(1, 1, "URL", True)], P.SCHEMAS["dlp_policies"]), f"file://{tmp_path}", "dlp_policies")
    append(spark.createDataFrame([(2, "PERSON")], "id int, pii_type string"), f"file://{tmp_path}", "dlp_policies")
    assert read_table(spark, f"file://{tmp_path}", "dlp_policies").filter("is_active").count() == 1
    with pytest.raises(ValueError):
        read_table(spark, f"file://{tmp_path}", "nothing")


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, pipeline):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mask_label' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_an_error_inside_the_corpus_operators_is_raised(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "veilspark" / "llm").mkdir()
    (tmp_path / "veilspark" / "llm" / "__init__.py").touch()
    (tmp_path / "veilspark" / "llm" / "queries.py").write_text("import nothing_of_that_name\n")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode and b"nothing_of_that_name" in done.stderr

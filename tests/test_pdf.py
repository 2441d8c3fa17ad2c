import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tests.test_sources import archive
from veilspark.operators.engine import Policy
from veilspark.sources import files as S
from veilspark.sources import jobs as J
from veilspark.sources.pdf import Pdf, PdfError, read_words, redact


def pdf(*pages, packed=False, fonts=b"<</F1 5 0 R>>", more=b"", trailer=b""):
    """A file of pages, each the operations of its content."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 612 792]>>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages))}
    objects[5] = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"
    for i, ops in enumerate(pages):
        body, how = (zlib.compress(ops), b"/Filter/FlateDecode") if packed else (ops, b"")
        objects[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Resources<</Font%s>>/Contents %d 0 R/Annots[<</A<</URI(mailto:support@corp.com)>>>>]>>" % (fonts, 11 + 2 * i)
        objects[11 + 2 * i] = b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(body), how, body)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + more + b"trailer\n<</Root 1 0 R/Info 3 0 R%s>>\nstartxref\n0\n%%%%EOF" % trailer


def lines(*texts):
    return b"BT /F1 12 Tf 72 720 Td " + b" 0 -24 Td ".join(b"(%s) Tj" % t.encode() for t in texts) + b" ET"


def text(content):
    return " ".join(w[5] for w in read_words(content))


@pytest.mark.parametrize("packed", [False, True])
def test_words_are_read_and_removed(packed):
    content = pdf(lines("Call +1 (212)", "555-0100 today"), lines("second page"), packed=packed)
    words = read_words(content)
    assert [(w[0], w[5]) for w in words] == [(0, "Call"), (0, "+1"), (0, "(212)"), (0, "555-0100"), (0, "today"), (1, "second"), (1, "page")]
    assert words[3][7] == 1 and words[0][2] < words[3][2] and words[0][1] < words[1][1]
    out = redact(content, {0: {1, 2, 3}})
    assert text(out) == "Call today second page" and out.count(b"Annots") == 1  # of the page that nothing is taken from
    left = {w[5]: w for w in read_words(out)}
    for w in (words[0], words[4]):  # what stays, stays where it was
        assert left[w[5]][1:5] == pytest.approx(w[1:5], abs=0.01)
    assert Pdf(out).contents(Pdf(out).pages[0][1]).count(b" re f") == 3


def test_ways_to_show_text():
    ops = b"q 2 0 0 2 0 0 cm BT /F1 6 Tf 36 360 Td [(Ja)-20(ne)-600(Doe)] TJ 14 TL (next \\(line\\)) ' 1 0.5 (third) \" T* <666f7572> Tj ET Q"
    content = pdf(ops)
    assert text(content) == "Jane Doe next (line) third four"
    for i, w in enumerate(read_words(content)):
        rest = text(redact(content, {0: {i}}))
        assert w[5] not in rest.split() and len(rest.split()) == 5


def test_maps_to_text_and_wide_fonts():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0003> <0005> <0041> endbfrange 1 beginbfchar <0001> <0020> endbfchar"
    more = b"6 0 obj <</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[7 0 R]/ToUnicode 8 0 R>> endobj 7 0 obj <</Type/Font/Subtype/CIDFontType2/DW 500/W[3[600 700] 5 5 800]>> endobj 8 0 obj <</Length %d>> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    content = pdf(b"BT /F2 10 Tf 50 700 Td <000300040001 0005> Tj ET", fonts=b"<</F1 5 0 R/F2 6 0 R>>", more=more)
    words = read_words(content)
    assert [w[5] for w in words] == ["AB", "C"] and words[0][3] - words[0][1] == pytest.approx(13)
    assert text(redact(content, {0: {0}})) == "C"


def test_objects_packed_in_streams():
    body = b"5 0 <</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding<</Differences[65/uni0042/at]>>>>"
    packed = zlib.compress(body)
    content = pdf(b"BT /F1 10 Tf 50 700 Td (AxB) Tj ET").replace(b"5 0 obj\n<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>\nendobj\n", b"")
    content = content.replace(b"trailer", b"30 0 obj\n<</Type/ObjStm/N 1/First 4/Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream\nendobj\ntrailer" % (len(packed), packed))
    assert text(content) == "Bx@" and text(redact(content, {})) == "Bx@"


def test_older_revisions_go():
    content = pdf(lines("now clean")) + b"\n11 0 obj\n<</Length 60>>\nstream\nBT /F1 12 Tf 72 720 Td (secret word) Tj ET                   \nendstream\nendobj\ntrailer <</Root 1 0 R>>"
    out = redact(content, {0: {0}})
    assert text(out) == "word" and b"clean" not in out and b"secret" not in out


def test_what_cannot_be_read_is_refused():
    for content, why in (
        (b"%PDF-1.4 nothing", "no pages"), (b"PK", "not a PDF"), (pdf(lines("x"), trailer=b"/Encrypt 9 0 R"), "encrypted"), (pdf(b"0 0 10 10 re f"), "no text layer"),
        (pdf(b"BT /F9 1 Tf (x) Tj ET"), "no font"), (pdf(lines("x"))[:200], "can't be read"),
    ):
        with pytest.raises(PdfError, match=why):
            read_words(content)
    with pytest.raises(PdfError, match="replacement"):
        redact(pdf(b"/Span <</ActualText (x)>> BDC " + lines("x") + b" EMC"), {0: {0}})


def test_text_in_forms():
    form = b"BT /F1 12 Tf 10 10 Td (inside) Tj ET"
    more = b"9 0 obj <</Type/XObject/Subtype/Form/BBox[0 0 1 1]/Resources<</Font<</F1 5 0 R>>>>/Length %d>> stream\n%s\nendstream endobj\n" % (len(form), form)
    content = pdf(lines("outside") + b" /X Do", more=more).replace(b"/Resources<</Font<</F1 5 0 R>>>>/Contents", b"/Resources<</Font<</F1 5 0 R>>/XObject<</X 9 0 R>>>>/Contents")
    assert text(content) == "outside inside" and text(redact(content, {0: {0}})) == "inside"
    with pytest.raises(PdfError, match="form"):
        redact(content, {0: {1}})


def test_files_are_masked(spark, tmp_path):
    p = Policy(["PHONE_NUMBER", "EMAIL_ADDRESS", "PERSON"])
    cv = pdf(lines("Priya Examplewala", "engineer", "Call +1 (212)", "555-0100 today"), lines("Contact support@corp.com", "support teams work here"), packed=True)
    rows = [("a.pdf", cv), ("clean.pdf", pdf(lines("nothing here"))), ("scan.pdf", pdf(b"0 0 1 1 re f"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    done = {r["path"]: r for r in S.mask_pdf(files, p).collect()}
    assert text(bytes(done["a.pdf"]["masked"])) == "engineer Call today Contact support teams work here"
    assert text(bytes(done["clean.pdf"]["masked"])) == "nothing here" and done["scan.pdf"]["masked"] is None and "no text layer" in done["scan.pdf"]["error"]
    assert b"corp.com" not in bytes(done["a.pdf"]["masked"])
    report = sorted(tuple(r["pii_types"]) for r in S.pdf_report(S.pdf_spans(S.pdf_pages(files), p)).collect())
    assert report == [("EMAIL_ADDRESS",), ("PERSON", "PHONE_NUMBER")]
    z = J.mask_archives(spark.createDataFrame([("x.zip", archive(dict(rows)))], "path string, content binary"), p).first()
    names = zipfile.ZipFile(io.BytesIO(z["content"]))
    assert sorted(names.namelist()) == ["error_scan.pdf.txt", "masked_a.pdf", "masked_clean.pdf"] and len(z["report"]) == 2
    raw = J.stage(spark, f"file://{tmp_path}", "cv.pdf", cv)
    r = J.process_document(spark, raw, f"file://{tmp_path}/out.pdf", p)
    assert r["items"] == 2 and "555" not in text(J.get(spark, r["output"])) and not list(tmp_path.glob("raw_*"))
    (tmp_path / "in").mkdir()
    for name, content in rows:
        (tmp_path / "in" / name).write_bytes(content)
    assert J.cloud_scan(spark, f"file://{tmp_path}/in", p, "sanitize", out=f"file://{tmp_path}/out") == {"files_scanned": 3, "files_with_pii": 1}
    assert "corp.com" not in text((tmp_path / "out" / "sanitized" / "a.pdf").read_bytes())
    assert S.discover(spark, f"file://{tmp_path}/in", p).filter(F.col("error").isNotNull()).select("file").collect()[0][0] == "scan.pdf"

"""Text out of small PDFs, and what extractors fail with."""

import zlib

from tallyrank.operators.parsing import LineParser
from tallyrank.sources.buckets import BucketStore
from tallyrank.sources.candidates import extract_text, pdf_text
from tallyrank.streaming import ingest


def pdf(page: bytes, deflate: bool = True, head: bytes = b"") -> bytes:
    body = zlib.compress(page) if deflate else page
    kind = b"/Filter /FlateDecode " if deflate else b""
    picture = b"7 0 obj << /Type /XObject /Filter /DCTDecode /Length 4 >> stream\nTj(x\nendstream endobj\n"
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj\n" + picture + b"4 0 obj << " + kind + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n" + head + b"%%EOF"


PAGE = rb"BT /F1 12 Tf 72 720 Td (Ann \(Lee\)) Tj 0 -14 Td [(Lead) -250 ( Dev\145loper)] TJ T* (Skills: Python, caf\351) Tj ET"


def test_pages():
    want = "Ann (Lee)\nLead Developer\nSkills: Python, café"
    assert pdf_text(pdf(PAGE)) == pdf_text(pdf(PAGE, False)) == want
    assert pdf_text(b"no pdf") is None and pdf_text(pdf(b"BT ET")) is None and pdf_text(b"%PDF-1.4") is None


def test_cascade_tells_its_errors(spark):
    def broken(data):
        raise ValueError("no")

    rows = spark.createDataFrame([(1, pdf(PAGE)), (2, b"x"), (3, None), (4, pdf(PAGE)[:-60].replace(b"x\x9c", b"??"))], "i int, content binary")
    got = {r["i"]: (r["text"], r["extract_errors"]) for r in extract_text(rows, [broken, pdf_text]).collect()}
    assert got[1][0].startswith("Ann (Lee)") and got[1][1] == ["broken: no"]
    assert got[2] == (None, ["broken: no"]) and got[3] == (None, [])


def test_pdfs_to_pool(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ann.pdf").write_bytes(pdf(PAGE))
    (tmp_path / "in" / "scan.pdf").write_bytes(pdf(b"q 1 0 0 1 0 0 cm Q"))
    store = BucketStore(spark, str(tmp_path / "pool"), 2)
    told = ingest.ingest_batch(store, ingest.parsed_resumes(LineParser())(spark.read.format("binaryFile").load(str(tmp_path / "in"))))
    row = ingest.pool_of(store).first()
    assert (told["parsed"], told["failed"]) == (1, 1) and (row["current_title"], row["skills_listed"]) == ("Lead Developer", ["Python", "café"])
    assert [r["source_file"] for r in ingest.failures(store).collect()] == ["scan.pdf"]

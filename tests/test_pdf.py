"""Text of PDF files put together here: plain and packed, with maps, object streams, forms and damage."""

from __future__ import annotations

import zlib

import pytest

from tessera.sources import parsers, pdf


def made(objects: dict[int, bytes], tail: bytes = b"trailer << /Root 1 0 R >>\nstartxref\n99999\n%%EOF") -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + tail


def stream(data: bytes, head: bytes = b"", packed: bool = True, length: bool = True) -> bytes:
    body = zlib.compress(data) if packed else data
    return b"<< " + head + (b"/Filter /FlateDecode " if packed else b"") + (b"/Length %d" % len(body) if length else b"") + b" >>\nstream\n" + body + b"\nendstream"


BASE = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> /XObject << /X 10 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 5: b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>"}
BASE |= {7: b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /fi 65 /B] >> >>", 8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>"}
BASE[9] = stream(b"1 beginbfchar <0001> <4E2D> endbfchar 2 beginbfrange <0002> <0004> <0061> <0010> <0011> [<0058> <00590059>] endbfrange")
BASE[10] = stream(b"BT /F1 9 Tf 0 -50 Td (in a form) Tj ET", b"/Type /XObject /Subtype /Form ")
FIRST = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (Hello \\(w\\157rld\\)) Tj 0 -14 Td [(sec) 20 (ond) -300 (line)] TJ T* (caf\\351 \\001t A) Tj ET q BI /W 1 ID \x00(\x01 EI Q /X Do"
SECOND = b"BT /F2 12 Tf <0001000200030004> Tj ET BT 100 0 Td <00100011> Tj ET"


@pytest.mark.parametrize("packed,length", [(True, True), (False, True), (True, False)])
def test_text_of_pages(packed, length):
    data = made(BASE | {4: stream(FIRST, packed=packed, length=length), 6: stream(SECOND, packed=packed, length=length)})
    assert pdf.pdf_markdown(data) == "<!-- page 1 -->\n\nHello (world)\nsecond line\ncafé ét B\nin a form\n\n<!-- page 2 -->\n\n中abc XYY"


def test_object_streams_and_later_objects():
    inner = {n: BASE[n] for n in (1, 2, 3, 5, 7, 8)}
    body, places = b"", []
    for n, o in inner.items():
        places.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    head = b" ".join(places) + b" "
    objects = {20: stream(head + body, b"/Type /ObjStm /N %d /First %d " % (len(inner), len(head)))} | {n: BASE[n] for n in (9, 10)} | {4: stream(b"BT (old) Tj ET"), 6: stream(b"")}
    data = made(objects) + b"\n4 0 obj\n" + stream(b"BT /F1 1 Tf (new) Tj ET") + b"\nendobj\n"  # written again
    assert pdf.pdf_markdown(data) == "<!-- page 1 -->\n\nnew"


def test_damaged_files_are_errors_of_their_rows(spark):
    good = made(BASE | {4: stream(FIRST), 6: stream(SECOND)})
    locked = made(BASE | {4: stream(FIRST), 6: stream(SECOND)}, b"trailer << /Root 1 0 R /Encrypt 30 0 R >>")
    image = made({1: BASE[1], 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: stream(b"x", b"/Filter /DCTDecode ", packed=False)})
    rows = [("a.pdf", good), ("b.pdf", b"no pdf"), ("c.PDF", locked), ("d.pdf", image), ("e.pdf", good[: len(good) // 3]), ("f.pdf", made(BASE | {4: stream(FIRST)[:-40], 6: stream(SECOND)})), ("g.pdf", None)]
    got = {r.name: r for r in parsers.parse(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.pdf"].markdown.startswith("<!-- page 1 -->\n\nHello") and got["a.pdf"].parser == "pdf" and got["a.pdf"].error is None
    assert "not a PDF" in got["b.pdf"].error and "encrypted" in got["c.PDF"].error and "DCTDecode" in got["d.pdf"].error and "not a PDF" in got["g.pdf"].error
    assert len(got) == 7 and (got["e.pdf"].error or got["e.pdf"].markdown is not None) and (got["f.pdf"].error or got["f.pdf"].markdown is not None)

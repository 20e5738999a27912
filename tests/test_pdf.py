"""Files made by hand, as the public format describes them."""

import zlib

from citelake.sources import pdf


def stream(data, packed=False, extra=b""):
    body = zlib.compress(data) if packed else data
    return b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", extra, body)


def made(objects):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"/CIDInit begincmap 1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0004> <0041> endbfrange endcmap"
TWO_PAGES = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>",
    4: b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>",
    5: stream(b"BT /F2 12 Tf <000100020003> Tj ET", True),
    6: stream(b"BT /F1 12 Tf 72 700 Td (Chapter \\(1\\)) Tj 0 -14 Td [(Ma) -20 (in) -250 (part\\056)] TJ T* (caf\\351) Tj ET BT (next) ' ET", True),
    7: b"<< /Type /Font /Subtype /Type1 >>",
    8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>",
    9: stream(CMAP),
}


def test_pages_in_order_of_the_tree():
    got = pdf.pdf_pages(made(TWO_PAGES))
    assert [[b["text"] for b in p["blocks"]] for p in got] == [["Chapter (1)", "Main part.", "café", "next"], ["中AB"]]
    assert [p["page_no"] for p in got] == [1, 2] and got[0]["blocks"][0]["type"] == "title" and got[0]["blocks"][1]["type"] == "paragraph"
    assert [len(p["blocks"]) for p in pdf.pdf_pages(made(TWO_PAGES), 1, 2)] == [2]


def test_objects_inside_a_stream():
    inner = {n: TWO_PAGES[n] for n in (1, 2, 3, 4, 7, 8)}
    bodies, places, at = b"", b"", 0
    for n, body in inner.items():
        places += b"%d %d " % (n, at)
        bodies += body + b" "
        at = len(bodies)
    packed = stream(places + bodies, True, b"/Type /ObjStm /N 6 /First %d" % len(places))
    got = pdf.pdf_pages(made({20: packed, **{n: TWO_PAGES[n] for n in (5, 6, 9)}}))
    assert [p["blocks"][-1]["text"] for p in got] == ["next", "中AB"]


def test_what_is_no_text_layer():
    assert pdf.pdf_pages(b"") is None and pdf.pdf_pages(b"%PDF-1.4 nothing") is None
    scan = dict(TWO_PAGES) | {5: stream(b"q /Im1 Do Q"), 6: b"<< /Filter /DCTDecode /Length 1 >>\nstream\nx\nendstream"}
    assert pdf.pdf_pages(made(scan)) is None
    assert pdf.lines_of("\n".join("abcdefghijklmnop")) == ["abcdefghijklmnop"] and pdf.lines_of("a\nbc") == ["a", "bc"]


def test_files_to_pages(spark):
    rows = [("a", bytearray(made(TWO_PAGES))), ("b", bytearray(b"plain\ntext")), ("c", None), ("d", bytearray(b"%PDF-1.4 broken"))]
    got = pdf.parse_pdfs(spark.createDataFrame(rows, "doc_id string, content binary")).orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.page_no, len(r.blocks)) for r in got] == [("a", 1, 4), ("a", 2, 1), ("b", 1, 2)]

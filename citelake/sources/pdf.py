"""Text of PDF files that bear a text layer: objects, page tree, content streams and fonts' Unicode maps, as the public format
describes them. No layout engine: lines follow the order in which a page draws them. Encrypted files and other filters
than Flate give no text; what is scanned has none and is left to recognition (parse.merge_repairs)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .parse import _rows, plain_pages

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s<>\[\]()/%{}]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9*]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in a text array (thousandths of the font size) that stands for a space.
SPACE_GAP = -180.0


class Pdf:
    """A file's objects by number; streams are inflated as they are asked for."""

    def __init__(self, data: bytes):
        self.objects: dict[int, bytes] = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        """Objects that lie inside a stream: pairs of number and place, then the objects."""
        inner, first = self.stream(body), re.search(rb"/First\s+(\d+)", body)
        if inner is None or first is None:
            return
        start = int(first[1])
        head = list(map(int, re.findall(rb"\d+", inner[:start])))
        places = sorted(zip(head[1::2], head[::2], strict=False))
        for (at, number), after in zip(places, [*(p for p, _ in places[1:]), len(inner) - start], strict=True):
            self.objects.setdefault(number, inner[start + at : start + after])

    def stream(self, body: bytes) -> bytes | None:
        found = _STREAM.search(body)
        if found is None:
            return None
        head = body[: found.start()]
        if b"/Filter" not in head:
            return found[1]
        if re.search(rb"/Filter\s*\[?\s*/FlateDecode\s*\]?", head) is None:
            return None
        try:
            return zlib.decompressobj().decompress(found[1])
        except zlib.error:
            return None

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """Numbers of the objects that a key names, alone or in an array."""
        found = re.search(rb"/" + key + rb"\b\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(n) for n in _REF.findall(found[1])] if found else []

    def part(self, body: bytes, key: bytes) -> bytes:
        """A dictionary under a key, given in place or by reference; empty where absent."""
        found = re.search(rb"/" + key + rb"\b\s*(<<|\d+\s+\d+\s+R)", body)
        if found is None:
            return b""
        if found[1] != b"<<":
            return self.objects.get(int(_REF.match(found[1])[1]), b"")
        depth, at = 0, found.start(1)
        for m in re.finditer(rb"<<|>>", body[at:]):
            depth += 1 if m[0] == b"<<" else -1
            if not depth:
                return body[at : at + m.end()]
        return body[at:]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, its resources) in reading order; pages that no tree names come by number."""
        out: list[tuple[bytes, bytes]] = []
        seen: set[int] = set()

        def walk(number: int, resources: bytes) -> None:
            body = self.objects.get(number, b"")
            if number in seen:
                return
            seen.add(number)
            own = self.part(body, b"Resources") or resources
            if re.search(rb"/Type\s*/Pages\b", body):
                for kid in self.refs(body, b"Kids"):
                    walk(kid, own)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append((body, own))

        roots = [n for n, b in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
        for root in (r for n in roots for r in self.refs(self.objects[n], b"Pages")):
            walk(root, b"")
        for number in sorted(self.objects):
            if re.search(rb"/Type\s*/Page\b", self.objects[number]):
                walk(number, b"")
        return out

    def unicode_map(self, font: bytes) -> dict[bytes, str]:
        """A font's codes as text, by its ToUnicode map."""
        table = next((self.stream(self.objects.get(n, b"")) for n in self.refs(font, b"ToUnicode")), None)
        out: dict[bytes, str] = {}
        said = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "ignore")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", table or b"", re.S):
            for code, value in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>", part):
                out[bytes.fromhex(code.decode())] = said(value)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", table or b"", re.S):
            for low, high, value in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                start, width = int(value, 16), len(value)
                for k in range(min(int(high, 16) - int(low, 16), 0xFFFF) + 1):
                    out[(int(low, 16) + k).to_bytes(len(low) // 2, "big")] = said(b"%0*x" % (width, start + k))
        return out


def _bytes_of(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in b"\r\n" else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.S)


def _said(token: bytes, font: dict[bytes, str]) -> str:
    raw = _bytes_of(token)
    if font:
        width = max(map(len, font))
        return "".join(font.get(raw[i : i + width], "") for i in range(0, len(raw), width))
    return raw.decode("utf-16", "ignore") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "ignore")


def content_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that a content stream shows; a move to another line, or a new text object, breaks the line."""
    out, held, font, row = [], [], {}, None
    for token in _TOKEN.findall(content):
        if not (token[:1].isalpha() or token in (b"'", b'"', b"T*")):
            held.append(token)
            continue
        numbers = [float(t) for t in held if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
        texts = [t for t in held if t[:1] in (b"(", b"<")]
        if token == b"Tf":
            font = fonts.get(next((t for t in held if t[:1] == b"/"), b""), {})
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and numbers[-1:] != [0.0]):
            out.append("\n")
        elif token == b"Tm" and len(numbers) >= 6:
            if row is not None and numbers[5] != row:
                out.append("\n")
            row = numbers[5]
        elif token in (b"Tj", b"'", b'"'):
            out += ["\n"] if token != b"Tj" else []
            out += [_said(t, font) for t in texts[-1:]]
        elif token == b"TJ":
            for t in held:
                if t[:1] in (b"(", b"<"):
                    out.append(_said(t, font))
                elif t not in (b"[", b"]") and t[:1] != b"/" and float(t) <= SPACE_GAP:
                    out.append(" ")
        held = []
    return "".join(out)


def page_texts(data: bytes) -> Iterator[str]:
    pdf = Pdf(data)
    for page, resources in pdf.pages():
        fonts = {b"/" + name: pdf.unicode_map(pdf.objects.get(int(n), b"")) for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R\b", pdf.part(resources, b"Font"))}
        streams = (pdf.stream(pdf.objects.get(n, b"")) for n in pdf.refs(page, b"Contents"))
        yield content_text(b"\n".join(s for s in streams if s), fonts)


def lines_of(said: str) -> list[str]:
    """Stripped lines; a page of at least 16 of which 70 % have one or two characters is joined and split at sentence ends."""
    rows = [x for x in map(str.strip, said.splitlines()) if x]
    if len(rows) >= 16 and sum(len(x) <= 2 for x in rows) >= 0.7 * len(rows):
        rows = [x for x in map(str.strip, re.split(r"(?<=[。！？；;])", "".join(rows))) if x]
    return rows


def pdf_pages(data: bytes, most_pages: int | None = None, most_lines: int | None = None) -> list[dict] | None:
    """Pages with text, numbered as in the file; None where there is none (no such file, scans). most_lines cuts a page (the
    reference's default is 240)."""
    out = []
    for number, said in enumerate(page_texts(data), start=1):
        rows = lines_of(said)[:most_lines]
        if rows and (most_pages is None or number <= most_pages):
            kinds = [{"type": "title" if i == 0 and len(x) <= 70 else "paragraph", "text": x} for i, x in enumerate(rows)]
            out.append({"page_no": number, "blocks": kinds, "tables": [], "images": []})
    return out or None


def parse_pdfs(df: DataFrame, column: str = "content") -> DataFrame:
    """Files (a binaryFile source) -> a row a page: the text layer, else the bytes read as text, as the last resort."""

    def parse(value):
        if value is None:
            return None
        data = bytes(value)
        return pdf_pages(data) or (None if data[:5] == b"%PDF-" else plain_pages(data.decode("utf-8", "ignore")))

    return _rows(df, column, parse)

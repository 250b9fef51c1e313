"""A restricted PDF reader on the standard library: page text, images and their coverage.

It reads uncompressed and Flate streams, classic files and object streams, text operators with simple encodings, and
image and form XObjects.  Encrypted files and fonts with their own character maps are not supported and say so.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

MAX_FORM_DEPTH = 12

_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*][A-Za-z0-9'\"*]*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


@dataclass
class Page:
    index: int
    text: str
    image_count: int = 0
    coverages: list[float] = field(default_factory=list)
    issue: str | None = None
    reliable: bool = True


def _stream(body: bytes) -> bytes | None:
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return None
    end = body.rfind(b"endstream")
    data = body[m.end() : end if end >= 0 else len(body)]
    if b"FlateDecode" in body[: m.start()]:
        return zlib.decompressobj().decompress(data)
    return data.rstrip(b"\r\n")


class Document:
    def __init__(self, content: bytes):
        if len(content) < 12 or b"%PDF-" not in content[:1024] or b"%%EOF" not in content[-65536:]:
            raise ValueError("PDF incompleto ou inválido")
        if b"/Encrypt" in content[-4096:]:
            raise ValueError("PDF cifrado")
        self.objects = {int(m[1]): m[3] for m in _OBJ.finditer(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        data = _stream(body) or b""
        first = int(re.search(rb"/First\s+(\d+)", body)[1])
        heads = list(map(int, data[:first].split()))
        spans = list(zip(heads[::2], heads[1::2]))
        for k, (number, at) in enumerate(spans):
            end = spans[k + 1][1] if k + 1 < len(spans) else len(data) - first
            self.objects.setdefault(number, data[first + at : first + end])

    def pages(self) -> list[int]:
        root = next((n for n, b in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        tree = re.search(rb"/Pages\s+(\d+)", self.objects.get(root, b"")) if root is not None else None
        return self._kids(int(tree[1]), 0) if tree else []

    def _kids(self, number: int, depth: int) -> list[int]:
        body = self.objects.get(number, b"")
        if depth > 50 or re.search(rb"/Type\s*/Page\b", body):
            return [number] if body else []
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        return [p for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1] if kids else b"") for p in self._kids(int(k), depth + 1)]

    def inherited(self, number: int, key: bytes) -> bytes:
        for _ in range(50):
            body = self.objects.get(number, b"")
            if re.search(re.escape(key) + rb"\b", body):
                return body
            up = re.search(rb"/Parent\s+(\d+)", body)
            if not up:
                return b""
            number = int(up[1])
        return b""

    def xobjects(self, body: bytes) -> dict[bytes, int]:
        """Names of a page's or form's XObjects; resources may be an object of their own."""
        ref = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", body)
        scope = self.objects.get(int(ref[1]), b"") if ref else body
        ref = re.search(rb"/XObject\s+(\d+)\s+\d+\s+R", scope)
        inner = self.objects.get(int(ref[1]), b"") if ref else (m[1] if (m := re.search(rb"/XObject\s*<<(.*?)>>", scope, re.S)) else b"")
        return {m[1]: int(m[2]) for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", inner)}

    def contents(self, body: bytes) -> bytes:
        many = re.search(rb"/Contents\s*\[(.*?)\]", body, re.S)
        one = re.search(rb"/Contents\s+(\d+)", body)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", many[1]) if many else [one[1]] if one else []
        return b"\n".join(_stream(self.objects.get(int(r), b"")) or b"" for r in refs)


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: b"" if m[1].strip() == b"" else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def operations(data: bytes):
    """(operands, operator) of a content stream."""
    stack: list = []
    for m in _TOKEN.finditer(data):
        t = m[0]
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            stack.append(t)
        else:
            yield stack, t
            stack = []


def page_text(data: bytes) -> str:
    out: list[str] = []
    for operands, op in operations(data):
        if op in (b"Td", b"TD", b"T*", b"'", b'"', b"ET", b"Tm") and out and out[-1] != "\n":
            out.append("\n")
        if op in (b"Tj", b"TJ", b"'", b'"'):
            for t in operands:
                if t[:1] in b"(<":
                    out.append(_string(t))
                elif op == b"TJ" and t[:1] not in b"[]/" and float(t) < -200:
                    out.append(" ")
    return "".join(out).strip()


def _scale(numbers: list[bytes]) -> float:
    try:
        a, b, c, d = map(float, numbers[:4])
    except ValueError:
        return 1.0
    return abs(a * d - b * c)


def coverages(doc: Document, body: bytes, data: bytes, area: float, scale: float = 1.0, active: frozenset[int] = frozenset()) -> list[float]:
    """Share of the page of every drawn image; forms are followed, never into themselves and not deeper than the limit."""
    if area <= 0 or len(active) > MAX_FORM_DEPTH:
        return []
    names, kept, out = doc.xobjects(body), [], []
    for operands, op in operations(data):
        if op == b"q":
            kept.append(scale)
        elif op == b"Q":
            scale = kept.pop() if kept else scale
        elif op == b"cm" and len(operands) >= 6:
            scale *= _scale(operands[-6:])
        elif op == b"Do" and operands:
            number = names.get(operands[-1][1:])
            inner = doc.objects.get(number, b"")
            if re.search(rb"/Subtype\s*/Image\b", inner):
                out.append(max(0.0, min(1.0, scale / area)))
            elif re.search(rb"/Subtype\s*/Form\b", inner) and number not in active:
                m = re.search(rb"/Matrix\s*\[(.*?)\]", inner, re.S)
                own = inner if b"/Resources" in inner else body
                out += coverages(doc, own, _stream(inner) or b"", area, scale * (_scale(m[1].split()) if m else 1.0), active | {number})
    return out


def count_images(doc: Document, body: bytes, seen: set[int]) -> int:
    """Distinct image objects reachable through forms."""
    n = 0
    for number in doc.xobjects(body).values():
        if number in seen:
            continue
        seen.add(number)
        inner = doc.objects.get(number, b"")
        if re.search(rb"/Subtype\s*/Image\b", inner):
            n += 1
        elif re.search(rb"/Subtype\s*/Form\b", inner):
            n += count_images(doc, inner, seen)
    return n


def read_pdf(content: bytes):
    """The pages of a file, one at a time.

    A page whose text cannot be read by its operators is read by its strings alone, and one that has none of these says so
    in its issue.  A page whose images cannot be inspected makes the file's inspection unreliable.
    """
    doc = Document(content)
    for index, number in enumerate(doc.pages()):
        body = doc.objects[number]
        page = Page(index, "")
        data = b""
        try:
            data = doc.contents(body)
            page.text = page_text(data)
        except Exception as e:  # noqa: BLE001
            page.text = "\n".join(filter(None, (_try_string(m[0]) for m in _STRINGS.finditer(data)))).strip()
            page.issue = f"texto lido sem posições: {e}" if page.text else f"página ilegível: {e}"
        try:
            owner = body if b"/Resources" in body else doc.inherited(number, b"/Resources")
            page.image_count = count_images(doc, owner, set())
        except Exception:  # noqa: BLE001
            page.reliable = False
        else:
            try:
                box = re.search(rb"/(?:CropBox|MediaBox)\s*\[(.*?)\]", doc.inherited(number, b"/CropBox") or doc.inherited(number, b"/MediaBox"), re.S)
                x0, y0, x1, y1 = map(float, box[1].split()) if box else (0.0, 0.0, 0.0, 0.0)
                page.coverages = coverages(doc, owner, data, abs((x1 - x0) * (y1 - y0)))
            except Exception:  # noqa: BLE001
                page.coverages = []  # placements unknown: a reason for OCR, and a warning
        yield page


_STRINGS = re.compile(rb"\((?:\\.|[^\\()])*\)")


def _try_string(token: bytes) -> str:
    try:
        return _string(token)
    except Exception:  # noqa: BLE001
        return ""

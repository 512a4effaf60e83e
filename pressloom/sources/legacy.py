"""Readers for formats of old: PDF text layers, RTF, OLE2 Word files, workbooks, without any
library of theirs. A reader takes bytes and returns (number of the part or None, text)."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

Parts = list[tuple[int | None, str]]
#: Fixed: least characters of a page, and the rows of a sheet that are kept.
PAGE_CHARS, SHEET_ROWS = 12, 200

# --- PDF ------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unpacked(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"FlateDecode" not in body[: m.start()]:
        return m.group(1)
    d = zlib.decompressobj()
    try:
        return d.decompress(m.group(1))
    except zlib.error:
        return b""


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    unescape = lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1).isdigit() else _ESCAPES.get(m.group(1), b"" if m.group(1) in b"\r\n" else m.group(1))
    return re.sub(rb"\\([0-7]{1,3}|.)", unescape, token[1:-1], flags=re.S)


def _character_map(data: bytes) -> dict[bytes, str]:
    """Code -> text of a ToUnicode map."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(a.decode())] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, width = int(a, 16), len(a) // 2
            for k in range(min(int(z, 16) - first + 1, 65536)):
                out[(first + k).to_bytes(width, "big")] = text(b)[:-1] + chr(ord(text(b)[-1]) + k)
        for a, _, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*\[(.*?)\]", block, re.S):
            for k, b in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many)):
                out[(int(a, 16) + k).to_bytes(len(a) // 2, "big")] = text(b)
    return out


def _decoded(raw: bytes, cmap: dict[bytes, str] | None) -> str:
    if not cmap:
        return raw.decode("cp1252", "replace")
    width = max(map(len, cmap))
    return "".join(cmap.get(raw[i : i + width], "") for i in range(0, len(raw), width))


class _Pdf:
    def __init__(self, content: bytes) -> None:
        if b"%PDF" not in content[:1024]:
            raise ValueError("no PDF")
        if b"/Encrypt" in content:
            raise ValueError("encrypted PDF")
        self.objects: dict[int, bytes] = {int(n): body for n, body in _OBJECT.findall(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                data = _unpacked(body)
                first = int(re.search(rb"/First\s+(\d+)", body).group(1))
                heads = [int(x) for x in data[:first].split()]
                places = sorted(zip(heads[1::2], heads[::2]))
                for (at, n), (end, _) in zip(places, [*places[1:], (len(data) - first, 0)]):
                    self.objects.setdefault(n, data[first + at : first + end])

    def value(self, body: bytes, key: bytes) -> bytes:
        """What stands behind a key: an object referred to, a dictionary or an array."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := _REF.match(rest):
            return self.objects.get(int(ref.group(1)), b"")
        if rest[:2] == b"<<":
            depth = 0
            for t in re.finditer(rb"<<|>>", rest):
                depth += 1 if t.group() == b"<<" else -1
                if not depth:
                    return rest[: t.end()]
        return rest[: rest.find(b"]") + 1] if rest[:1] == b"[" else rest

    def pages(self) -> Iterator[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        todo, seen = [self.value(root, b"Pages")], 0
        while todo and seen < 1_000_000:
            node, seen = todo.pop(0), seen + 1
            if re.search(rb"/Type\s*/Pages", node):
                kids = [self.objects.get(int(n), b"") for n in _REF.findall(self.value(node, b"Kids"))]
                inherited = self.value(node, b"Resources")
                todo = [k if b"/Resources" in k or not inherited else k + b" /Resources " + inherited for k in kids] + todo
            elif node:
                yield node

    def text(self, page: bytes) -> str:
        fonts = self.value(self.value(page, b"Resources"), b"Font")
        maps = {name: _character_map(_unpacked(m)) if (m := self.value(self.objects.get(int(n), b""), b"ToUnicode")) else None for name, n in re.findall(rb"(/[^\s/<>]+)\s+(\d+)\s+\d+\s+R", fonts)}
        own = self.value(page, b"Contents")
        data = b"\n".join(_unpacked(self.objects.get(int(n), b"")) for n in _REF.findall(own)) if own[:1] == b"[" else _unpacked(own)
        out: list[str] = []
        stack: list[bytes] = []
        cmap = None
        for m in _TOKEN.finditer(data):
            t = m.group()
            if t[:1] in b"(<[]/" or t[:1] in b"-+." or t[:1].isdigit():
                stack.append(t)
                continue
            if t == b"Tf":
                cmap = next((maps.get(x) for x in stack if x[:1] == b"/"), None)
            elif t in (b"Tj", b"TJ", b"'", b'"'):
                if t in (b"'", b'"'):
                    out.append("\n")
                for x in stack:
                    if x[:1] in b"(<":
                        out.append(_decoded(_literal(x), cmap))
                    elif t == b"TJ" and x[:1] not in b"[]/" and float(x) < -200:  # a wide gap is a space
                        out.append(" ")
            elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                moved = len(stack) >= 2 and t in (b"Td", b"TD") and float(stack[-1]) == 0
                out.append(" " if moved else "\n")
            stack.clear()
        lines = [" ".join(x.split()) for x in "".join(out).split("\n")]
        return "\n".join(x for x in lines if x)


def read_pdf(content: bytes) -> Parts:
    """Text layers of the pages that have one."""
    pdf = _Pdf(content)
    return [(i, t) for i, t in ((i, pdf.text(p)) for i, p in enumerate(pdf.pages(), 1)) if len(t.strip()) >= PAGE_CHARS]


def pdf_reader(ocr: Callable[[bytes], Parts] | None = None) -> Callable[[bytes], Parts]:
    """A PDF reader that asks the recogniser first and takes the text layer where that fails or
    finds nothing; a failure is one only where there is no text layer either."""

    def read(content: bytes) -> Parts:
        failed = None
        if ocr is not None:
            try:
                found = sorted((n, t.strip()) for n, t in ocr(content) if len((t or "").strip()) >= PAGE_CHARS)
                if found:
                    return found
            except Exception as e:
                failed = f"{type(e).__name__}: {e}"
        parts = read_pdf(content)
        if not parts and failed:
            raise RuntimeError(f"recognition failed and there is no text layer: {failed}")
        return parts

    return read


# --- Word -----------------------------------------------------------------------------------

_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
#: Fixed: groups of an RTF file that hold no text of the document.
_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr generator listtable listoverridetable themedata datastore xmlnstbl rsidtbl latentstyles".split())


def rtf_text(content: bytes) -> str:
    out: list[str] = []
    groups: list[bool] = []
    hidden = starred = False
    for m in _RTF.finditer(content.decode("latin-1")):
        code, uni, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            groups.append(hidden)
            starred = False
        elif brace == "}":
            hidden = groups.pop() if groups else False
        elif sign == "*":
            starred = True
        elif word:
            if starred or word in _HIDDEN:
                hidden, starred = True, False
            elif not hidden:
                out.append({"par": "\n", "line": "\n", "row": "\n", "cell": "\t", "tab": "\t", "page": "\f"}.get(word, ""))
        elif not hidden:
            out.append(bytes.fromhex(code).decode("cp1252", "replace") if code else chr(int(uni) % 65536) if uni else sign if sign in ("\\", "{", "}") else {"~": " ", "_": "-"}.get(sign or "", "") if sign else plain or "")
    return "".join(out)


def ole_stream(content: bytes, name: str) -> bytes:
    """A stream of an OLE2 compound file, by its sector chains."""
    sector, small = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    at = lambda n: content[(n + 1) * sector : (n + 2) * sector]
    first_dir, cutoff, first_mini = struct.unpack_from("<I", content, 48)[0], struct.unpack_from("<I", content, 56)[0], struct.unpack_from("<I", content, 60)[0]
    heads = [n for n in struct.unpack_from("<109I", content, 76) if n < 0xFFFFFFFA]
    table = [x for n in heads for x in struct.unpack(f"<{sector // 4}I", at(n))]

    def chain(n: int, links: list[int]) -> list[int]:
        out: list[int] = []
        while n < 0xFFFFFFFA and n < len(links) and len(out) <= len(links):
            out.append(n)
            n = links[n]
        return out

    entries = b"".join(at(n) for n in chain(first_dir, table))
    found = {}
    for i in range(0, len(entries), 128):
        e = entries[i : i + 128]
        if size := struct.unpack_from("<H", e, 64)[0]:
            found[e[: size - 2].decode("utf-16-le", "replace")] = struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0]
    if name not in found:
        raise ValueError(f"no stream {name}")
    start, length = found[name]
    if length >= cutoff:
        return b"".join(at(n) for n in chain(start, table))[:length]
    whole = b"".join(at(n) for n in chain(found["Root Entry"][0], table))
    mini = [x for n in chain(first_mini, table) for x in struct.unpack(f"<{sector // 4}I", at(n))]
    return b"".join(whole[n * small : (n + 1) * small] for n in chain(start, mini))[:length]


def ole_text(content: bytes) -> str:
    """The text range of a Word file; marks of cells, lines and pages become line breaks."""
    data = ole_stream(content, "WordDocument")
    a, z = struct.unpack_from("<II", data, 0x18)
    if not 0 < a < z <= len(data):
        raise ValueError("text range out of bounds")
    text = re.sub(r"[\r\x07\x0b\x0c]", "\n", data[a:z].decode("cp1252", "replace"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[\x00-\x08\x0e-\x1f]", "", text))


def read_doc(content: bytes) -> Parts:
    """A file called .doc, by what it begins with."""
    if content.startswith(b"{\\rtf"):
        return [(None, rtf_text(content))]
    if content.startswith(b"\xd0\xcf\x11\xe0"):
        return [(None, ole_text(content))]
    raise ValueError(f"unknown container {content[:4]!r}")


# --- workbooks ------------------------------------------------------------------------------


def read_xlsx(content: bytes) -> Parts:
    """The sheets of a workbook, the first rows of each joined by tabs."""
    s = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(content))
    flat = lambda e: "".join(t.text or "" for t in e.iter(f"{s}t"))
    shared = [flat(i) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{s}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{s}sheet")] if "xl/workbook.xml" in z.namelist() else []
    files = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    out: Parts = []
    for i, (_, file) in enumerate(files, 1):
        lines = []
        for row in list(ElementTree.fromstring(z.read(file)).iter(f"{s}row"))[:SHEET_ROWS]:
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{s}c")):
                column = 0
                for letter in re.match(r"[A-Z]*", c.get("r") or "").group():
                    column = column * 26 + ord(letter) - 64
                v = c.find(f"{s}v")
                value = flat(c) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells[column - 1 if column else k] = shared[int(value)] if c.get("t") == "s" and value else value
            lines.append("\t".join(cells.get(j, "") for j in range(max(cells, default=-1) + 1)))
        out.append((i, f"# Sheet: {names[i - 1] if i <= len(names) else i}\n" + "\n".join(lines)))
    return out

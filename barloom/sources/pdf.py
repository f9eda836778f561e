"""Two readers of PDF text in plain Python, for files whose fonts use single-byte codes or say their Unicode.

``by_page_tree`` follows the page tree, the contents of each page and the character maps of its fonts; ``by_streams``
takes the text of every content stream in the order of the file, for damaged files.  Scanned pages have no text: that is
for a reading service (see files.batched_pages).  Encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from barloom.sources.files import with_fallback

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in a TJ array of more than this many thousandths of the font size is a blank.
GAP = 200


def unescaped(raw: bytes) -> bytes:
    """The bytes of a literal string, without its parentheses."""
    plain = lambda m: _ESCAPES.get(m[1], m[1]) if not m[1].isdigit() else bytes([int(m[1], 8) & 255])
    return re.sub(rb"\\([0-7]{1,3}|.)", plain, re.sub(rb"\\\r?\n", b"", raw), flags=re.S)


def bytes_of(token: bytes) -> bytes:
    if token[:1] == b"(":
        return unescaped(token[1:-1])
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def character_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes a code, and the text of each code, of a ToUnicode map."""
    width, out = 1, {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width = len(code) // 2
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width, first = len(low) // 2, int(to, 16)
            for i in range(min(int(high, 16) - int(low, 16) + 1, 65536)):
                out[int(low, 16) + i] = chr(first + i) if first + i < 0x110000 else ""
    return width, out


class File:
    """Objects of a PDF, those in object streams too."""

    def __init__(self, content: bytes):
        if not content.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise ValueError("the PDF is encrypted")
        self.objects = {int(n): body for n, _, body in _OBJECT.findall(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                count, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
                data = self.stream(body)
                head = list(map(int, data[:first].split()[: 2 * count]))
                ends = [*head[3::2], len(data) - first]
                for number, at, end in zip(head[::2], head[1::2], ends):
                    self.objects.setdefault(number, data[first + at : first + end])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """Objects that a key refers to, one or an array."""
        m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def pages(self) -> Iterator[bytes]:
        """Page objects in the order of the tree; of a file without a tree, in that of their numbers."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        stack = [n for b in roots for n in self.refs(b, b"Pages")][::-1]
        seen: set[int] = set()
        found = False
        while stack:
            n = stack.pop()
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            if re.search(rb"/Type\s*/Page\b", body):
                found = True
                yield body
            stack += self.refs(body, b"Kids")[::-1]
        if not found:
            yield from (b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b))

    def fonts(self, page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Character maps by the name of a page's font, of the page's own resources or those above it."""
        body, hops = page, 0
        while not re.search(rb"/Resources\b", body) and hops < 32 and (up := self.refs(body, b"Parent")):
            body, hops = self.objects.get(up[0], b""), hops + 1
        own = b"".join(self.objects.get(n, b"") for n in self.refs(body, b"Resources")) or body
        own = b"".join(self.objects.get(n, b"") for n in self.refs(own, b"Font")) or own
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", own):
            maps = self.refs(self.objects.get(int(number), b""), b"ToUnicode")
            if maps:
                out[name] = character_map(self.stream(self.objects.get(maps[0], b"")))
        return out


def shown(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]] | None = None) -> str:
    """The text that a content stream shows; moves to another line end a line."""
    out: list[str] = []
    operands: list[bytes] = []
    table: tuple[int, dict[int, str]] | None = None

    def said(token: bytes) -> str:
        raw = bytes_of(token)
        if not table:
            return raw.decode("cp1252", "replace")
        codes = (int.from_bytes(raw[i : i + table[0]], "big") for i in range(0, len(raw), table[0]))
        return "".join(table[1].get(c, "") for c in codes)

    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/+-.0123456789":
            operands.append(token)
            continue
        texts = [t for t in operands if t[:1] in (b"(", b"<")]
        if token == b"Tf" and fonts is not None:
            names = [t[1:] for t in operands if t[:1] == b"/"]
            table = fonts.get(names[-1]) if names else None
        elif token in (b"Tj", b"'", b'"'):
            out += ["\n"] * (token != b"Tj") + [said(t) for t in texts[-1:]]
        elif token == b"TJ":
            for t in operands:
                if t[:1] in (b"(", b"<"):
                    out.append(said(t))
                elif t[:1] not in b"[]/" and float(t) < -GAP:
                    out.append(" ")
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and len(operands) >= 2 and float(operands[-1]) != 0) or token == b"Tm":
            out.append("\n")
        operands = []
    lines = (line.strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def by_page_tree(content: bytes) -> list[str]:
    """Text of each page."""
    f = File(content)
    return [shown(b"\n".join(f.stream(f.objects.get(n, b"")) for n in f.refs(page, b"Contents")), f.fonts(page)) for page in f.pages()]


def by_streams(content: bytes) -> list[str]:
    """Text of each stream that shows any, whether pages lead to it or not."""
    out = []
    for m in _STREAM.finditer(content):
        try:
            data = zlib.decompressobj().decompress(m[1])
        except zlib.error:
            data = m[1]
        if re.search(rb"\bBT\b", data) and (text := shown(data)):
            out.append(text)
    return out


#: Pages by the first of both readers that finds text; further readers, for scanned files, can be added.
read_pdf = with_fallback([by_page_tree, by_streams])

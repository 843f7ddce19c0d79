"""PDF: the pictures of a document as entries, named by page; objects are found by their marks, also in object streams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

from ...functions.filters import ascii85, ascii_hex, lzw, palette_colors, png, png_rows, run_lengths, tiff_rows
from ...functions.kernels import Damaged, Unsupported, expand
from ..source import Source
from .entry import Corrupt, Entry

_SPACE, _STOP = b" \t\r\n\x0c\0", b" \t\r\n\x0c\0()<>[]{}/%"


class Ref(int):
    """The number of another object."""


class _Parser:
    """Values of a document's syntax: names as str, strings as bytes, numbers, lists, dictionaries, references."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 37:
                while self.at < len(d) and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self, depth: int = 0) -> Any:
        self.skip()
        d, at = self.data, self.at
        if depth > 50 or at >= len(d):
            raise Corrupt("no value")
        if d[at : at + 2] == b"<<":
            self.at += 2
            out: dict = {}
            while True:
                self.skip()
                if d[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                out[key if isinstance(key, str) else repr(key)] = self.value(depth + 1)
        if d[at] == 91:
            self.at += 1
            items: list = []
            while True:
                self.skip()
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.value(depth + 1))
        if d[at] == 47:
            stop = at + 1
            while stop < len(d) and d[stop] not in _STOP:
                stop += 1
            self.at = stop
            return re.sub(r"#([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), d[at + 1 : stop].decode("latin-1"))
        if d[at] == 60:
            stop = d.find(b">", at)
            self.at = stop + 1
            return ascii_hex(d[at + 1 : stop])
        if d[at] == 40:
            return self._string()
        m = re.compile(rb"(\d+)[\s\0]+(\d+)[\s\0]+R(?![A-Za-z])").match(d, at)
        if m:
            self.at = m.end()
            return Ref(m[1])
        stop = at
        while stop < len(d) and d[stop] not in _STOP:
            stop += 1
        word, self.at = d[at:stop], max(stop, at + 1)
        try:
            return float(word) if b"." in word else int(word)
        except ValueError:
            return {b"true": True, b"false": False}.get(word)

    def _string(self) -> bytes:
        out, level, d = bytearray(), 0, self.data
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 92:
                m = re.compile(rb"[0-7]{1,3}").match(d, self.at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                else:
                    out += {110: b"\n", 114: b"\r", 116: b"\t", 10: b""}.get(d[self.at], d[self.at : self.at + 1])
                    self.at += 1
                continue
            if c == 40:
                level += 1
                if level == 1:
                    continue
            elif c == 41:
                level -= 1
                if not level:
                    break
            out.append(c)
        return bytes(out)


class Document:
    def __init__(self, data: bytes) -> None:
        self.data, self.objects = data, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)[\s\0]+\d+[\s\0]+obj", data):
            p = _Parser(data, m.end())
            try:
                value = p.value()
            except (Corrupt, Damaged, ValueError, IndexError):
                continue
            stream = None
            if isinstance(value, dict) and (s := re.compile(rb"[\s\0]*stream\r?\n").match(data, p.at)):
                stream = s.end()
            self.objects[int(m[1])] = (value, stream)
        for value, stream in list(self.objects.values()):
            if stream is not None and value.get("Type") == "ObjStm":
                try:
                    body = self.content(value, stream)
                    head = _Parser(body)
                    pairs = [(head.value(), head.value()) for _ in range(self.told(value["N"]))]
                    for number, place in pairs:
                        self.objects.setdefault(number, (_Parser(body, self.told(value["First"]) + place).value(), None))
                except (Corrupt, Damaged, Unsupported, ValueError, IndexError, KeyError, TypeError):
                    continue

    def told(self, value: Any) -> Any:
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value), (None, None))[0]
        return value

    def raw(self, value: dict, stream: int) -> bytes:
        n = self.told(value.get("Length"))
        if isinstance(n, int) and re.compile(rb"[\s\0]*endstream").match(self.data, stream + n):
            return self.data[stream : stream + n]
        stop = self.data.find(b"endstream", stream)
        return self.data[stream : stop if stop >= 0 else len(self.data)].rstrip(b"\r\n")

    def filters(self, value: dict) -> list[tuple[str, dict]]:
        names, parms = self.told(value.get("Filter", [])), self.told(value.get("DecodeParms", {}))
        names = names if isinstance(names, list) else [names]
        parms = parms if isinstance(parms, list) else [parms]
        return [(self.told(n), self.told(parms[i]) or {} if i < len(parms) else {}) for i, n in enumerate(names)]

    def content(self, value: dict, stream: int) -> bytes:
        """A stream with its filters undone, but for those of pictures of their own."""
        data = self.raw(value, stream)
        for name, parm in self.filters(value):
            if name in ("FlateDecode", "Fl"):
                try:
                    d = zlib.decompressobj()
                    data = expand(d, data) + d.flush()
                except zlib.error as e:
                    raise Damaged(str(e)) from e
            elif name in ("LZWDecode", "LZW"):
                data = lzw(data, self.told(parm.get("EarlyChange", 1)) != 0)
            elif name in ("ASCII85Decode", "A85"):
                data = ascii85(data)
            elif name in ("ASCIIHexDecode", "AHx"):
                data = ascii_hex(data)
            elif name in ("RunLengthDecode", "RL"):
                data = run_lengths(data)
            elif name in ("DCTDecode", "JPXDecode"):
                return data
            else:
                raise Unsupported(str(name))
            predictor = self.told(parm.get("Predictor", 1))
            columns, colors, depth = (self.told(parm.get(k, d)) for k, d in (("Columns", 1), ("Colors", 1), ("BitsPerComponent", 8)))
            if predictor >= 10:
                data = png_rows(data, columns, colors, depth)
            elif predictor == 2:
                data = tiff_rows(data, columns, colors)
        return data

    def pages(self) -> dict[int, int]:
        """The last page that refers to each object."""
        out: dict[int, int] = {}
        leaves = sorted(k for k, (v, _) in self.objects.items() if isinstance(v, dict) and v.get("Type") == "Page")
        order = self._ordered() or leaves
        for n, k in enumerate(order):
            own, seen = [self.objects[k][0].get("Resources")], set()
            parent = self.told(self.objects[k][0].get("Parent"))
            if own[0] is None and isinstance(parent, dict):
                own = [parent.get("Resources")]
            while own:
                resources = self.told(own.pop())
                for ref in (self.told((resources or {}).get("XObject")) or {}).values():
                    out[int(ref)] = n + 1
                    inner = self.objects.get(int(ref), (None, None))[0]
                    if isinstance(inner, dict) and inner.get("Subtype") == "Form" and int(ref) not in seen:
                        seen.add(int(ref))
                        own.append(inner.get("Resources"))
        return out

    def _ordered(self) -> list[int]:
        root = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        out, seen = [], set()

        def walk(ref: Any) -> None:
            if not isinstance(ref, Ref) or int(ref) in seen:
                return
            seen.add(int(ref))
            node = self.told(ref)
            if isinstance(node, dict) and node.get("Type") == "Page":
                out.append(int(ref))
            elif isinstance(node, dict):
                for k in self.told(node.get("Kids")) or []:
                    walk(k)

        if root:
            walk(root.get("Pages"))
        return out


def _picture(doc: Document, value: dict, stream: int) -> tuple[str, Any]:
    """Ending and function of a picture: JPEG as it is, plain samples as PNG."""
    kinds = [name for name, _ in doc.filters(value)]
    if kinds[-1:] == ["DCTDecode"]:
        return ".jpg", lambda: doc.content(value, stream)
    if kinds[-1:] == ["JPXDecode"]:
        return ".jp2", lambda: doc.content(value, stream)
    space = doc.told(value.get("ColorSpace"))
    depth = 1 if value.get("ImageMask") else doc.told(value.get("BitsPerComponent", 8))
    width, height = doc.told(value["Width"]), doc.told(value["Height"])

    def made() -> bytes:
        data = doc.content(value, stream)
        kind = doc.told(space[0]) if isinstance(space, list) and space else space
        if kind == "Indexed" and depth == 8:
            table = space[3]
            if isinstance(table, Ref):
                inner, place = doc.objects[int(table)]
                table = doc.content(inner, place) if place is not None else inner
            return png(palette_colors(data, table), width, height, 3)
        if kind == "ICCBased":
            inner = doc.told(space[1])
            kind = {1: "DeviceGray", 3: "DeviceRGB"}.get(doc.told(inner.get("N")))
        if kind in ("DeviceGray", "CalGray", "G", None) and depth in (1, 2, 4, 8):
            return png(data, width, height, 1, depth)
        if kind in ("DeviceRGB", "CalRGB", "RGB") and depth == 8:
            return png(data, width, height, 3)
        raise Unsupported(f"pictures in {kind} of {depth} bits")

    return ".png", made


def pdf(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Pictures sorted by the last page that refers to each, then by object; those of no page come last."""
    doc = Document(src.at(0, src.size))
    locked = re.search(rb"/Encrypt[\s\0]", doc.data) is not None
    pages = doc.pages()
    found = [(pages.get(k, 1 << 30), k, v, s) for k, (v, s) in doc.objects.items() if s is not None and v.get("Subtype") == "Image"]
    for page, number, value, stream in sorted(found, key=lambda f: f[:2]):
        try:
            ending, made = _picture(doc, value, stream)
        except (KeyError, TypeError):
            yield Entry(f"Object {number}", corrupted=True)
            continue
        title = f"Page {page}, object {number}{ending}" if page < 1 << 30 else f"Object {number}{ending}"

        def decode(_: bytes | None, made=made) -> bytes:
            if locked:
                raise Unsupported("encrypted PDF")
            return made()

        yield Entry(title, packed=len(doc.raw(value, stream)), method="+".join(n for n, _ in doc.filters(value)) or "None", encrypted=locked or None, decode=decode, extras={"PDFPage": str(page if page < 1 << 30 else 0), "PDFObject": str(number)})

"""Files that are one compressed stream: Gzip, Bzip2, XZ, LZMA_Alone, Compress, Squeeze, Crunch."""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import zlib
from collections.abc import Iterator

from ...functions.kernels import LIMIT, Damaged, TooLarge, Unsupported, byte_sum, expand, rle90, squeeze, unix_compress
from ..source import Source
from .entry import Entry, unix_time

#: What a name's ending becomes without its compression; others are dropped.
ENDINGS = {"tgz": "tar", "taz": "tar", "adz": "adf", "cpgz": "cpio", "tbz": "tar", "tbz2": "tar", "tb2": "tar", "txz": "tar", "tlz": "tar"}
ARCHIVES = re.compile(r"\.(?:tar|cpio|pax|warc|xar|iso|adf|cpt|zip|ar)$", re.I)


def content_name(name: str) -> str:
    stem, dot, end = name.rsplit("/", 1)[-1].rpartition(".")
    if not dot or not stem:
        return name
    return f"{stem}.{ENDINGS[end.lower()]}" if end.lower() in ENDINGS else stem


def _one(src: Source, name: str, method: str, decode, **more) -> Entry:
    inner = content_name(name)
    return Entry(inner, packed=src.size, method=method, archive=bool(ARCHIVES.search(inner)) or None, decode=lambda _: decode(src.at(0, src.size)), **more)


def _members(data: bytes) -> bytes:
    """All members one after another; the length behind each isn't looked at, its CRC is."""
    out = bytearray()
    while data:
        if data[:2] not in (b"\x1f\x8b", b"\x1f\x9e", b"\x1f\xa1"):
            raise Damaged("no header where a member should start")
        at, flags = (2, 0) if data[:2] == b"\x1f\xa1" else (10, data[3])
        if flags & 4:
            at += 2 + int.from_bytes(data[at : at + 2], "little")
        for bit in (8, 16):
            if flags & bit:
                at = data.index(0, at) + 1
        at += 2 if flags & 2 else 0
        d = zlib.decompressobj(-15)
        try:
            part = expand(d, data[at:]) + d.flush()
        except zlib.error as e:
            raise Damaged(str(e)) from e
        if not d.eof or len(d.unused_data) < 8 or zlib.crc32(part) != int.from_bytes(d.unused_data[:4], "little"):
            raise Damaged("checksum differs")
        out += part
        if len(out) > LIMIT.get():
            raise TooLarge("too many bytes come out")
        data = d.unused_data[8:]
    return bytes(out)


def gzip(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    head = src.need(base, 2)
    e = _one(src, name, "Deflate", lambda data: _members(data[base:]))
    if head != b"\x1f\xa1":
        flags, stamp, extra, system = src.get("<BIBB", base + 3)
        e.modified = unix_time(stamp) if stamp else None
        e.extras |= {"GzipExtraFlags": str(extra), "GzipOS": str(system)}
        at = base + 10
        if flags & 4:
            at += 2 + src.get("<H", at)[0]
        if flags & 8:
            stop = src.find(b"\0", at)
            e.extras["GzipFilename"] = src.at(at, stop - at).decode("latin-1")
            at = stop + 1
        if flags & 16:
            e.comment = src.at(at, src.find(b"\0", at) - at).decode("latin-1")
    yield e


def _all(open_one, error):
    def run(data: bytes) -> bytes:
        out = bytearray()
        try:
            while data:
                d = open_one()
                out += expand(d, data)
                if not d.eof:
                    raise Damaged("data end too soon")
                data = d.unused_data.lstrip(b"\0") if open_one is lzma.LZMADecompressor else d.unused_data
        except error as e:
            raise Damaged(str(e)) from e
        return bytes(out)

    return run


def bzip2(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    yield _one(src, name, "Bzip2", _all(bz2.BZ2Decompressor, OSError))


def xz(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    yield _one(src, name, "LZMA2", _all(lzma.LZMADecompressor, lzma.LZMAError))


def lzma_alone(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    size = src.need(5, 8)
    e = _one(src, name, "LZMA", _all(lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), lzma.LZMAError))
    e.size = None if size == b"\xff" * 8 else int.from_bytes(size, "little")
    yield e


def compress(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    yield _one(src, name, "LZW", unix_compress)


def squeezed(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """CP/M squeeze: a sum of the bytes, the name, then the tree and the codes of run-length data."""
    total = src.get("<H", 2)[0]
    stop = src.find(b"\0", 4)
    body = src.at(stop + 1, src.size)

    def decode(_: bytes | None) -> bytes:
        try:
            return rle90(squeeze(body))
        except (struct.error, IndexError) as e:
            raise Damaged(str(e)) from e

    yield Entry(src.at(4, stop - 4), packed=len(body), method="Squeeze", decode=decode, check=lambda data: byte_sum(data) == total)


def crunched(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """CP/M crunch, listed only: a name of three letters behind its dot, a comment in brackets, then four bytes of versions."""
    stop = src.find(b"\0", 2)
    kind, head = src.need(1, 1)[0], src.need(2, stop - 2)
    revision, version, unchecked, _ = src.need(stop + 1, 4)
    found = re.match(rb"([^.]*\..{0,3})(?: \[(.*)\]$)?", head, re.S)
    title, note = (found[1].rstrip(b" "), found[2]) if found else (head, None)
    method = f"{'LZW' if kind == 0xFE else 'LZHUF'} {'1.0' if version & 0xF0 == 0x10 else '2.0'}"

    def decode(_: bytes | None) -> bytes:
        raise Unsupported(method)

    extras = {"CrunchType": str(kind), "CrunchReferenceRevision": str(revision), "CrunchSignificantRevision": str(version), "CrunchErrorDetection": str(unchecked)}
    yield Entry(title, packed=src.size - stop - 7, method=method, archive=title.lower().endswith(b".lbr") or None, comment=note.decode("latin-1") if note else None, offset=stop + 5, separators="", extras=extras, decode=decode)

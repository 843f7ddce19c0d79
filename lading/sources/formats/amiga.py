"""LZX of the Amiga: files in groups that share a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from ...functions.codecs import amiga_lzx as unpacked
from ...functions.kernels import Unsupported
from ..source import Source
from .entry import Entry, crc32_is

#: Methods, and systems by number.
METHODS = {0: "None", 2: "LZX"}
SYSTEMS = {0: "MSDOS", 1: "Windows", 2: "OS/2", 10: "Amiga", 20: "Unix"}
#: An attribute's bit, and what it is among the protection bits of the Amiga; the first four are denied there.
PROTECTION = {0x01: 0x08, 0x02: 0x04, 0x04: 0x01, 0x08: 0x02, 0x10: 0x10, 0x20: 0x80, 0x40: 0x40, 0x80: 0x20}


def _time(stamp: int) -> datetime | None:
    """Packed fields; programs wrote years after 1999 in ways of their own."""
    year = (stamp >> 17 & 63) + 1970
    year = year - 28 if year >= 2028 else year + 64 if year < 1978 else year
    try:
        return datetime(year, (stamp >> 23 & 15) + 1, stamp >> 27, stamp >> 12 & 31, stamp >> 6 & 63, stamp & 63, tzinfo=UTC)
    except ValueError:
        return None


class _Group:
    """A stream with the files that lie in it one after another; what comes out is kept for the next of them."""

    def __init__(self) -> None:
        self.size, self.body, self.method, self.held = 0, b"", 0, None

    def add(self, size: int):
        start = self.size
        self.size += size

        def decode(_: bytes | None) -> bytes:
            if self.method not in METHODS:
                raise Unsupported(f"method {self.method}")
            if self.held is None:
                self.held = unpacked(self.body, self.size) if self.method else self.body
            out = self.held[start : start + size]
            if start + size == self.size:
                self.held = None
            return out

        return decode


def amiga_lzx(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Files in order. Those up to one with packed bytes share these; of a last group without any, nothing is told."""
    at, group, held = base + 10, _Group(), []
    while at + 31 <= src.size:
        attributes, size, packed, system, method, flags, m, version, _, stamp, crc, _, n = src.get("<HIIBBHBBHIIIB", at)
        raw, note, place = src.need(at + 31, n), src.need(at + 31 + n, m), at + 31 + n + m
        e = Entry(raw, size, None, METHODS.get(method), modified=_time(stamp), comment=note.decode("latin-1") or None, offset=place, check=crc32_is(crc))
        e.extras = {"LZXOS": str(system), "LZXMethod": str(method), "LZXFlags": str(flags), "LZXVersion": str(version), "LZXCRC32": str(crc)}
        if system in SYSTEMS:
            e.extras["LZXOSName"] = SYSTEMS[system]
        if system == 10:
            e.extras["AmigaProtectionBits"] = str(sum(bit for k, bit in PROTECTION.items() if bool(attributes & k) != (k < 16)))
        e.solid, e.solid_offset, e.decode = at, group.size, group.add(size)
        held.append(e)
        if packed:
            group.body, group.method, first = src.need(place, packed), method, held[0].solid
            for e in held:
                e.solid, e.packed = first, packed * e.size // group.size if group.size else 0
                yield e
            group, held = _Group(), []
        at = place + packed

"""Which format a file has: 62 recognisers in their order of trial, and what the reader does with each."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import inf

from ..functions.kernels import crc16

#: Bytes that recognisers may look at.
HEADER = 0x80000


@dataclass(frozen=True)
class Format:
    """find: the offset of the format's signature in the first bytes, or None. floating: it competes with its like by
    the smallest offset, once formats before it have failed. parser: what reads it, "" if it is only recognised."""

    name: str
    header: int
    find: Callable[[bytes, str], int | None]
    parser: str = ""
    floating: bool = False


def _magic(*heads: bytes, at: int = 0):
    return lambda h, name: 0 if any(h[at : at + len(m)] == m for m in heads) else None


def _anywhere(what: bytes, within: int, start: int = 0):
    def find(h: bytes, name: str) -> int | None:
        i = h.find(what, start, within)
        return i if i >= 0 else None

    return find


def _named(pattern: str):
    return lambda h, name: 0 if re.fullmatch(pattern, name.rsplit("/", 1)[-1], re.I) else None


def _both(first, second):
    return lambda h, name: second(h, name) if first(h, name) is not None else None


def _exe(h: bytes, name: str) -> int | None:
    return 0 if h[:2] == b"MZ" else None


def _tar(h: bytes, name: str) -> int | None:
    if len(h) < 512:
        return None
    if h[257:262] == b"ustar":
        return 0
    if name.lower().endswith(".tar"):
        return 0
    try:
        want = int(h[148:156].replace(b"\0", b" ").strip() or b"x", 8)
    except ValueError:
        return None
    plain = h[:148] + b" " * 8 + h[156:512]
    return 0 if h[0] and want in (sum(plain), sum(b - 256 if b > 127 else b for b in plain)) else None


def _lzma_alone(h: bytes, name: str) -> int | None:
    if len(h) < 13 or h[0] >= 225:
        return None
    window, size = int.from_bytes(h[1:5], "little"), h[5:13]
    power = window and any(window == 1 << k or window == 3 << k for k in range(32))
    return 0 if power and size != bytes(8) and size[6:8] in (b"\0\0", b"\xff\xff") else None


def _lha(h: bytes, name: str) -> int | None:
    return 0 if re.match(rb"-(?:lh[0-9a-z]|lz[0-9s]|pm[0-9])-", h[2:7]) else None


def _compact_pro(h: bytes, name: str) -> int | None:
    return 0 if len(h) >= 8 and h[0] == 1 and h[1] <= 1 and int.from_bytes(h[4:8], "big") < 1 << 31 and name.lower().endswith((".cpt", ".sea")) else None


def _arj(h: bytes, name: str) -> int | None:
    i = h.find(b"\x60\xea", 0, 0x8000)
    while i >= 0:
        size = int.from_bytes(h[i + 2 : i + 4], "little")
        if 30 <= size <= 2600 and len(h) >= i + 8 + size:
            import zlib

            if zlib.crc32(h[i + 4 : i + 4 + size]) == int.from_bytes(h[i + 4 + size : i + 8 + size], "little"):
                return i
        i = h.find(b"\x60\xea", i + 1, 0x8000)
    return None


def _arc(h: bytes, name: str) -> int | None:
    if len(h) < 29 or h[0] != 0x1A or not 1 <= h[1] & 0x7F <= 0x20:
        return None
    title = h[2:15].split(b"\0")[0]
    return 0 if title and all(31 < b < 127 for b in title) and b"\0" in h[2:15] else None


def _macbinary(h: bytes, name: str) -> int | None:
    if len(h) < 128 or h[0] or h[74] or not 1 <= h[1] <= 63:
        return None
    from ..functions.kernels import crc16_ccitt

    if crc16_ccitt(h[:124]) == int.from_bytes(h[124:126], "big") or h[102:106] == b"mBIN":
        return 0
    return 0 if not h[82] and not any(h[99:126]) and int.from_bytes(h[83:87], "big") < 1 << 23 and name.lower().endswith((".bin", ".macbin")) else None


def _iso(h: bytes, name: str) -> int | None:
    return 0 if any(h[base + 1 : base + 6] == b"CD001" or h[base + 9 : base + 14] == b"CDROM" for base in (0x8000, 0x8000 // 2048 * 2352 + 16, 0x8000 // 2048 * 2352 + 24, 0x8000 // 2048 * 2336 + 8)) else None


def _nds(h: bytes, name: str) -> int | None:
    return 0 if len(h) >= 0x160 and crc16(h[:0x15E], 0xFFFF) == int.from_bytes(h[0x15E:0x160], "little") and crc16(h[0xC0:0x15C], 0xFFFF) == int.from_bytes(h[0x15C:0x15E], "little") else None


def _nsis(h: bytes, name: str) -> int | None:
    for i in range(0, min(len(h), 0x10000), 512):
        if h[i + 4 : i + 20] == b"\xef\xbe\xad\xdeNullsoftInst" or h[i + 4 : i + 16] == b"\xef\xbe\xad\xdenlsft" or h[i + 4 : i + 20] == b"\xed\xbe\xad\xdeNullSoftInst":
            return i
    return None


def _now(h: bytes, name: str) -> int | None:
    return 0 if len(h) >= 24 and h[:2] == b"\0\2" and 0 < int.from_bytes(h[2:4], "big") < 0x4000 and name.lower().endswith((".nc", ".now")) else None


def _crunch(h: bytes, name: str) -> int | None:
    return 0 if re.match(rb"\x76[\xfd\xfe][^\0]+\0[\x10-\x2f]{2}", h[:1024]) else None


def _never(h: bytes, name: str) -> int | None:
    return None


#: In the order of trial, more certain ones first.
FORMATS: tuple[Format, ...] = (
    Format("Zip", 8, lambda h, n: 0 if h[:4] in (b"PK\3\4", b"PK\5\6") or h[4:8] == b"PK\3\4" else None, "zip"),
    Format("RAR", 7, _magic(b"Rar!\x1a\7\0", b"RE~^"), "rar"),
    Format("RAR 5", 8, _magic(b"Rar!\x1a\7\1\0"), "rar5"),
    Format("7-Zip", 32, _magic(b"7z\xbc\xaf\x27\x1c"), "sevenzip"),
    Format("Gzip", 3, _magic(b"\x1f\x8b\x08", b"\x1f\x9e\x08", b"\x1f\xa1"), "gzip"),
    Format("Bzip2", 10, lambda h, n: 0 if h[:3] == b"BZh" and h[3:4].isdigit() and h[4:10] in (b"1AY&SY", b"\x17rE8P\x90") else None, "bzip2"),
    Format("Tar", 512, _tar, "tar"),
    Format("StuffIt", 22, lambda h, n: 0 if h[10:14] == b"rLau" and (h[:4] == b"SIT!" or h[:2] == b"ST") else None, "stuffit"),
    Format("StuffIt 5", 100, lambda h, n: 0 if re.match(rb"StuffIt \(c\)1997-.{4} Aladdin Systems, Inc\., http://www\.aladdinsys\.com/StuffIt/\r\n", h[:100], re.S) else None, "stuffit5"),
    Format("StuffIt 5 (self-extracting)", 8192, lambda h, n: 0x1A000 if h[:2] == b"MZ" and h[4100:4104] == b"\x42\x03\xe8\x53" else None, "stuffit5"),
    Format("StuffIt split file", 100, _magic(b"\xb0\x56\0")),
    Format("StuffIt X", 10, _magic(b"StuffIt!", b"StuffIt?")),
    Format("BinHex", 8192, _anywhere(b"(This file must be converted with BinHex", 8192), "binhex"),
    Format("MacBinary", 128, _macbinary, "macbinary"),
    Format("AppleSingle", 8, _magic(b"\0\5\x16\0", b"\0\5\x16\7", b"\0\x16\5\0", b"\7\x16\5\0"), "applesingle"),
    Format("DiskDoubler", 124, _magic(b"\xab\xcd\0\x54", b"DDAR", b"DDA2")),
    Format("PackIt", 4, _magic(b"PMag", b"PMa4", b"PMa5", b"PMa6"), "packit"),
    Format("Now Compress", 24, _now),
    Format("PPMd", 16, _magic(b"\x8f\xaf\xac\x84", b"\x84\xac\xaf\x8f"), "ppmd"),
    Format("XAR", 4, _magic(b"xar!"), "xar"),
    Format("Compress", 3, _magic(b"\x1f\x9d"), "compress"),
    Format("RPM", 96, _magic(b"\xed\xab\xee\xdb"), "rpm"),
    Format("XZ", 6, _magic(b"\xfd7zXZ\0"), "xz"),
    Format("SWF", 6, lambda h, n: 0 if h[:3] in (b"FWS", b"CWS") and h[3:4] and h[3] < 32 else None, "swf"),
    Format("PDF", 53, _magic(b"%PDF-"), "pdf"),
    Format("ALZip", 8, _magic(b"ALZ\1"), "alzip"),
    Format("CAB", 4, _magic(b"MSCF"), "cab"),
    Format("CFBF", 512, _magic(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), "cfbf"),
    Format("Self-extracting CAB", 65536, _both(_exe, _anywhere(b"MSCF\0\0\0\0", 65536)), "cab"),
    Format("LZH", 7, _lha, "lha"),
    Format("Self-extracting Amiga LhA", 48, lambda h, n: 44 if h[:4] == b"\0\0\3\xf3" and re.match(rb"-lh.-", h[46:51]) else None, "lha"),
    Format("Self-extracting Commodore 64 LhA", 0xE90, lambda h, n: next((i for i in (0xE87, 0xE89, 0xE8B) if h[:2] == b"\1\x08" and re.match(rb"-lh.-", h[i + 2 : i + 7])), None), "lha"),
    Format("Self-extracting LZH", 84, lambda h, n: next((i for i in (32, 36, 64, 79) if h[:2] == b"MZ" and re.match(rb"-lh.-", h[i + 2 : i + 7])), None), "lha"),
    Format("Zoo", 0x22, _magic(b"\xdc\xa7\xc4\xfd", at=0x14), "zoo"),
    Format("LZX", 10, lambda h, n: 0 if len(h) >= 10 and h[:3] == b"LZX" else None, "amiga_lzx"),
    Format("PowerPacker", 4, _magic(b"PP20"), "powerpacker"),
    Format("NDS", 0x200, _nds, "nds"),
    Format("NSA", 6, _named(r"arc[0-9]*\.nsa"), "nsa"),
    Format("SAR", 6, _named(r"arc[0-9]*\.sar"), "sar"),
    Format("Ar", 8, _magic(b"!<arch>\n"), "ar"),
    Format("WARC", 10, _magic(b"WARC/1.0\r\n", b"WARC/1.1\r\n"), "warc"),
    Format("WinZip Self-Extractor", 20480, _both(_exe, _anywhere(b"WinZip Self-Extractor", 20480)), "zip"),
    Format("ZipIt SEA", 4, lambda h, n: 0 if h[:4] == b"\0\0\0\0" and h[4:8] == b"PK\3\4" else None, "zip"),
    Format("Self-extracting Zip", 0x10000, _anywhere(b"PK\3\4", 0x10000, 1), "zip", True),
    Format("Embedded RAR", 0x80000, _anywhere(b"Rar!\x1a\7\0", 0x80000, 1), "rar", True),
    Format("Embedded RAR 5", 0x80000, _anywhere(b"Rar!\x1a\7\1\0", 0x80000, 1), "rar5", True),
    Format("7-Zip (self-extracting)", 0x40000, _both(_exe, _anywhere(b"7z\xbc\xaf\x27\x1c", 0x40000)), "sevenzip"),
    Format("NSIS", 0x10000, _nsis),
    Format("Gzip (self-extracting)", 5000, _both(lambda h, n: 0 if h[:2] in (b"#!", b"MZ") else None, _anywhere(b"\x1f\x8b\x08", 5000)), "gzip"),
    Format("Compact Pro", 8, _compact_pro, "compact_pro"),
    Format("ARJ", 0x8000, _arj, "arj"),
    Format("Zip (multi-part)", 8, lambda h, n: 0 if n.lower().endswith(".zip") and h[:4] == b"PK\7\x08" else None, "zip"),
    Format("ARC", 0x1D, _arc, "arc"),
    Format("Self-extracting ARC", 0x10000, lambda h, n: next((m.start() for m in re.finditer(rb"\x1a[\1-\x09][ -~]{1,12}\0", h[:0x10000]) if h[:2] == b"MZ" and n.lower().endswith((".exe", ".com"))), None), "arc"),
    Format("Squeeze", 1024, _magic(b"\x76\xff"), "squeezed"),
    Format("Crunch", 1024, _crunch, "crunched"),
    Format("LBR", 128, lambda h, n: 0 if len(h) >= 128 and h[:14] == b"\0" + b" " * 11 + b"\0\0" and h[14:16] != b"\0\0" else None, "lbr"),
    Format("LZMA_Alone", 13, _lzma_alone, "lzma_alone"),
    Format("Cpio", 6, lambda h, n: 0 if h[:6] in (b"070707", b"070701", b"070702") or h[:2] in (b"\x71\xc7", b"\xc7\x71") else None, "cpio"),
    Format("Split file", 0, _named(r".*\.[0-9]{3}"), "split"),
    Format("ISO 9660", 0x80000, _iso, "iso"),
    Format("Amiga client", 0, _never),
)


def detect(header: bytes, name: str = "") -> tuple[Format, int] | None:
    """The format and its signature's offset, or None.

    The first in order that matches, but for floating ones: the first of these stands for all, and of those that match
    the one with the smallest offset is it. A recogniser that fails on the data counts as no match."""
    best: tuple[float, Format] = (inf, FORMATS[0])
    floating_seen = False
    for f in FORMATS:
        if f.floating and floating_seen:
            continue
        for g in [x for x in FORMATS if x.floating] if f.floating else [f]:
            try:
                at = g.find(header, name)
            except (ValueError, IndexError):
                at = None
            if at is not None and at < best[0]:
                best = (at, g)
        floating_seen |= f.floating
        if best[0] < inf:
            return best[1], int(best[0])
    return None

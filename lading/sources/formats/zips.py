"""Zip: the central directory if it is found, else a scan of local headers."""

from __future__ import annotations

import bz2
import lzma
import struct
from collections.abc import Iterator
from itertools import accumulate

from ...functions.codecs import implode, shrink
from ...functions.kernels import Damaged, Unsupported, WrongPassword, expand, inflate, inflate64, zip_aes, zip_cipher
from ..source import Source
from .entry import Corrupt, Entry, crc32_is, dos_time, file_time, unix_time

#: Names of methods and of host systems.
METHODS = {0: "None", 1: "Shrink", 2: "Reduce 1", 3: "Reduce 2", 4: "Reduce 3", 5: "Reduce 4", 6: "Implode", 8: "Deflate", 9: "Deflate64", 12: "Bzip2", 14: "LZMA", 93: "Zstandard", 95: "XZ", 96: "WinZip JPEG", 97: "WavPack", 98: "PPMd", 99: "AES"}
SYSTEMS = ("MS-DOS", "Amiga", "OpenVMS", "Unix", "VM/CMS", "Atari ST", "OS/2", "Classic Mac OS", "Z-System", "CP/M", "Windows NTFS", "MVS", "VSE", "Acorn RISC OS", "VFAT", "alternate MVS", "BeOS", "Tandem", "OS/400", "OS X")


def _inflated(method: int, data: bytes, size: int, flags: int = 0) -> bytes:
    try:
        if method == 0:
            return data
        if method == 1:
            return shrink(data, size)
        if method == 6:
            return implode(data, size, flags)
        if method == 8:
            return inflate(data)
        if method == 9:
            return inflate64(data)
        if method == 12:
            return expand(bz2.BZ2Decompressor(), data)
        if method == 95:
            return expand(lzma.LZMADecompressor(), data)
        if method == 14:
            n = struct.unpack_from("<H", data, 2)[0]
            props = data[4 : 4 + n]
            d = props[0]
            spec = {"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": struct.unpack_from("<I", props, 1)[0]}
            return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[spec]).decompress(data[4 + n :], size)
        if method == 93:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(data, size)
    except (OSError, lzma.LZMAError, struct.error, IndexError) as e:
        raise Damaged(str(e)) from e
    raise Unsupported(METHODS.get(method, f"method {method}"))


def _extras(data: bytes, e: Entry, wide: list[int]) -> dict[str, int]:
    """Reads tagged fields into e; wide: which of size, packed and offset stand in the 64-bit field, in that order."""
    at, out = 0, {}
    while at + 4 <= len(data):
        tag, n = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if tag == 0x0001:
            for i, k in enumerate(wide):
                if len(body) >= 8 * i + 8:
                    out[("size", "packed", "offset")[k]] = struct.unpack_from("<Q", body, 8 * i)[0]
            e.extras["Zip64"] = "true"
        elif tag == 0x5455 and body:
            stamps = [t for k, t in zip((1, 2, 4), ("modified", "accessed", "created"), strict=True) if body[0] & k]
            for i, k in enumerate(stamps):
                if len(body) >= 5 + 4 * i:
                    setattr(e, k, unix_time(struct.unpack_from("<i", body, 1 + 4 * i)[0]))
        elif tag == 0x5855 and len(body) >= 8:
            e.accessed, e.modified = (unix_time(t) for t in struct.unpack_from("<ii", body))
            if len(body) >= 12:
                e.uid, e.gid = struct.unpack_from("<HH", body, 8)
        elif tag == 0x7855 and len(body) >= 4:
            e.uid, e.gid = struct.unpack_from("<HH", body)
        elif tag == 0x7875 and len(body) >= 3 and body[0] == 1:
            u = body[1]
            e.uid = int.from_bytes(body[2 : 2 + u], "little")
            e.gid = int.from_bytes(body[3 + u : 3 + u + body[2 + u]], "little") if len(body) > 2 + u else None
        elif tag == 0x000A and len(body) >= 32:
            e.modified, e.accessed, e.created = (file_time(t) for t in struct.unpack_from("<QQQ", body, 8))
        elif tag == 0x7075 and len(body) > 5 and body[0] == 1:
            import zlib

            if zlib.crc32(e.name if isinstance(e.name, bytes) else e.name.encode()) == struct.unpack_from("<I", body, 1)[0]:
                e.extras["ZipRegularFilename"] = (e.name if isinstance(e.name, bytes) else e.name.encode()).decode("windows-1252", "replace")
                e.name = body[5:].decode("utf-8", "replace")
        elif tag == 0x9901 and len(body) >= 7:
            version, vendor, strength, method = struct.unpack_from("<H2sBH", body)
            out |= {"aes": version, "strength": strength, "method": method}
            e.extras |= {"WinZipAESVersion": str(version), "WinZipAESVendor": vendor.decode("latin-1"), "WinZipAESKeySize": str(64 * (strength + 1)), "WinZipAESCompressionMethod": str(method)}
    return out


def _entry(src: Source, base: int, local: int, central: dict | None) -> tuple[Entry, int]:
    """The entry at a local header, and where its data end. Name and extra fields are the local header's, what the
    central record tells wins otherwise."""
    head = src.need(local, 30)
    if head[:4] != b"PK\3\4":
        raise Damaged("no local header")
    version, flags, method, stamp, crc, packed, size, n, m = struct.unpack("<HHHIIIIHH", head[4:])
    raw, extra = src.need(local + 30, n), src.at(local + 30 + n, m)
    if central:
        flags, method, stamp, crc, packed, size = (central[k] for k in ("flags", "method", "stamp", "crc", "packed", "size"))
    e = Entry(raw.decode("utf-8", "replace") if flags & 0x800 else raw, modified=dos_time(stamp), separators="/\\" if central and central["system"] == 0 and b"/" not in raw and b"\\" in raw else "/")
    wide = [k for k, v in enumerate((size, packed)) if v == 0xFFFFFFFF]
    more = _extras(extra, e, wide)
    size, packed = (central or {}).get("size64", more.get("size", size)), (central or {}).get("packed64", more.get("packed", packed))
    start = local + 30 + n + m
    if flags & 8 and not central:
        size, packed, crc = _descriptor(src, start)
    real = more.get("method", method)
    e.size, e.packed, e.method, e.offset = size, packed, METHODS.get(real, f"Method {real}"), start
    e.encrypted = bool(flags & 1) or None
    e.extras |= {"ZipExtractVersion": str(version), "ZipFlags": str(flags), "ZipCompressionMethod": str(method), "ZipCRC32": str(crc), "ZipLocalDate": str(stamp)}
    if central:
        e.comment = central["comment"] or None
        e.extras |= {"ZipOS": str(central["system"]), "ZipFileAttributes": str(central["attributes"])}
        if central["system"] < len(SYSTEMS):
            e.extras["ZipOSName"] = SYSTEMS[central["system"]]
        if central["system"] in (0, 11, 14):
            e.dos = central["attributes"] & 255
        if central["system"] in (3, 19) and central["attributes"] >> 16:
            e.mode = central["attributes"] >> 16
    name = e.name if isinstance(e.name, str) else e.name.decode("latin-1")
    if name.endswith("/") and not size:
        e.directory = True
    def decode(password: bytes | None) -> bytes:
        data = src.need(start, packed)
        if flags & 1:
            if password is None:
                raise WrongPassword("a password is needed")
            if method == 99:
                data = zip_aes(data, password, more.get("strength", 3))
            else:
                data = zip_cipher(data, password)
                if data[11] != (stamp >> 8 & 255 if flags & 8 else crc >> 24):
                    raise WrongPassword("wrong password")
                data = data[12:]
        return _inflated(real, data, size, flags)

    if e.mode is not None and e.mode & 0xF000 == 0xA000 and not flags & 1 and size <= 65536:
        e.link = decode(None).decode("utf-8", "replace")
    e.decode = decode
    e.check = None if more.get("aes") == 2 else crc32_is(crc)
    return e, start + packed + ((16 if src.at(start + packed, 4) == b"PK\7\x08" else 12) if flags & 8 and not central else 0)


def _descriptor(src: Source, start: int) -> tuple[int, int, int]:
    """Size, packed size and CRC of data whose descriptor comes after them: with or without its signature, sizes of 32
    or 64 bits; the packed size must be where it is, and another header must follow."""
    at = start
    while (at := src.find(b"PK", at)) >= 0:
        for lead in (4, 0):
            if lead and src.at(at, 4) != b"PK\7\x08":
                continue
            for layout, width in (("<III", 12), ("<IQQ", 20)):
                place = at if lead else at - width
                body = src.at(place + lead, width)
                if place < start or len(body) < width:
                    continue
                crc, packed, size = struct.unpack(layout, body)
                after = src.at(place + lead + width, 4)
                if packed == place - start and (after[:2] == b"PK" or not after):
                    return size, packed, crc
        at += 1
    raise Corrupt("data of unknown length without a descriptor")


def parse(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """A directory that can't be had leads to a scan of local headers, from the first on."""
    tail_at = max(0, src.size - 65536 - 22)
    tail = src.at(tail_at, src.size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0 or len(tail) - end < 22:
        yield from _inferred(_scan(src, base))
        return
    end += tail_at
    count, size, start, n = src.get("<HIIH", end + 10)
    parts = src.volumes()
    bases = [0, *accumulate(v.size for v in parts)][: len(parts)] if len(parts) > 1 else []
    start += _base(bases, src.get("<H", end + 6)[0])
    if src.at(end - 20, 4) == b"PK\6\7":
        where = src.get("<Q", end - 12)[0]
        if src.at(where, 4) == b"PK\6\6":
            count, size, start = src.get("<QQQ", where + 32)
    shift = 0
    if src.at(start, 4) != b"PK\1\2" and count and end - size >= 0 and src.at(end - size, 4) == b"PK\1\2":
        shift = end - size - start
    yield from _inferred(_listed(src, start + shift, count, shift, end, bases))


def _base(bases: list[int], disk: int) -> int:
    """Where a volume starts among all; places of a single file need nothing added."""
    return bases[disk] if disk < len(bases) else 0


def _listed(src: Source, at: int, count: int, shift: int, end: int, bases: list[int]) -> Iterator[Entry]:
    k = 0
    while k < count or (count == 0xFFFF and k >= count and src.at(at, 4) == b"PK\1\2" and at < end):
        head = src.need(at, 46)
        if head[:4] != b"PK\1\2":
            raise Corrupt("no central record")
        made, _, flags, method, stamp, crc, packed, size, n, m, c, disk, _, attributes, local = struct.unpack("<HHHHIIIIHHHHHII", head[4:])
        central = {"system": made >> 8, "flags": flags, "method": method, "stamp": stamp, "crc": crc, "packed": packed, "size": size, "attributes": attributes, "comment": src.at(at + 46 + n + m, c).decode("utf-8", "replace")}
        more = _extras(src.at(at + 46 + n, m), Entry(b""), [i for i, v in enumerate((size, packed, local)) if v == 0xFFFFFFFF])
        central |= {"size64": more.get("size", size), "packed64": more.get("packed", packed)}
        try:
            yield _entry(src, 0, more.get("offset", local) + shift + _base(bases, disk), central)[0]
        except Damaged:
            yield Entry(src.at(at + 46, n), size, packed, METHODS.get(method), corrupted=True)
        at += 46 + n + m + c
        k += 1


def _scan(src: Source, base: int) -> Iterator[Entry]:
    at = src.find(b"PK\3\4", base)
    while 0 <= at:
        try:
            e, at = _entry(src, base, at, None)
            yield e
            if src.at(at, 4) != b"PK\3\4":
                if src.at(at, 2) == b"PK" or at >= src.size:
                    return
                at = src.find(b"PK\3\4", at)
        except Damaged:
            at = src.find(b"PK\3\4", at + 4)


def _inferred(entries: Iterator[Entry]) -> Iterator[Entry]:
    """An empty entry is a directory too if the next name goes on below it."""
    held: Entry | None = None
    plain = lambda e: e.name if isinstance(e.name, bytes) else e.name.encode()
    try:
        for e in entries:
            if held:
                if not held.directory and not held.size and plain(e).startswith(plain(held) + b"/"):
                    held.directory = True
                yield held
            held = e
    finally:
        last = held
    if last:
        yield last

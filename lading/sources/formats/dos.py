"""LHA, ARC, Zoo, ARJ, CAB, ALZip, RAR and RAR 5 headers, NDS, CFBF, PPMd headers and PowerPacker."""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Iterator

from ...functions.codecs import arc_crunch, arj_fastest, lh1, lzx, quantum
from ...functions.kernels import LIMIT, Bits, Damaged, TooLarge, Unsupported, WrongPassword, aes_cbc, crc16, expand, inflate, larc_lz5, larc_lzs, lzh_static, lzw, ms_zip, rle90, squeeze, unix_compress
from ...functions.rar import Rar2, Rar3, Rar5, rar3_plain, rar5_checksum, rar5_key
from ..source import Source
from .entry import Corrupt, Entry, crc32_is, dos_time, file_time, unix_time

#: Names of methods and systems.
ARC = {1: "None", 2: "None", 3: "RLE", 4: "Squeeze", 5: "Crunch", 6: "Crunch", 7: "Crunch", 8: "Crunch", 9: "Squash", 10: "Crush", 11: "Distill"}
ARJ = {0: "None", 1: "LZH", 2: "LZH", 3: "LZH", 4: "Fastest"}
RAR_SYSTEMS = {0: "MS-DOS", 1: "OS/2", 2: "Windows", 3: "Unix", 4: "Mac OS", 5: "BeOS"}
RAR_METHODS = {0x30: "None", 0x31: "Fastest", 0x32: "Fast", 0x33: "Normal", 0x34: "Good", 0x35: "Best"}
RAR5_METHODS = ("None", "Fastest", "Fast", "Normal", "Good", "Best")


def _not_here(what: str):
    def decode(_: bytes | None) -> bytes:
        raise Unsupported(what)

    return decode


def lha(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Headers of levels 0 to 3; extended headers give names, folders, modes and times."""
    at = base
    while at + 22 <= src.size and src.at(at, 1) not in (b"\0", b"") or src.at(at + 20, 1) == b"\3":
        method, packed, size, stamp, attributes, level = src.get("<5sIIIBB", at + 2)
        if method[:1] != b"-":
            raise Corrupt("no method")
        e = Entry(b"", size, packed, method.decode("latin-1"), dos=attributes, extras={"LHHeaderLevel": str(level)})
        folder, title = b"", b""
        if level < 2:
            first, n = src.need(at, 1)[0], src.need(at + 21, 1)[0]
            title = src.need(at + 22, n)
            crc = src.get("<H", at + 22 + n)[0]
            body, e.modified = at + 2 + first, dos_time(stamp)
            more = src.get("<H", body - 2)[0] if level == 1 else 0
            place = body
        else:
            whole, crc = (src.get("<H", at)[0], src.get("<H", at + 21)[0]) if level == 2 else (src.get("<I", at + 24)[0], src.get("<H", at + 21)[0])
            e.modified, wide = unix_time(stamp), 4 if level == 3 else 2
            place = at + 24 + (4 if level == 3 else 0) + wide
            more = int.from_bytes(src.need(place - wide, wide), "little")
            body = at + whole
        wide = 4 if level == 3 else 2
        while more:
            kind, data = src.need(place, 1)[0], src.need(place + 1, more - 1 - wide)
            if kind == 1:
                title = data
            elif kind == 2:
                folder = data.replace(b"\xff", b"/")
            elif kind == 0x40:
                e.dos = data[0]
            elif kind == 0x50:
                e.mode = int.from_bytes(data[:2], "little")
            elif kind == 0x51:
                e.gid, e.uid = struct.unpack("<HH", data[:4])
            elif kind == 0x53:
                e.user = data.decode("latin-1")
            elif kind == 0x52:
                e.group = data.decode("latin-1")
            elif kind == 0x54:
                e.modified = unix_time(struct.unpack("<I", data[:4])[0])
            place += more
            if level == 1:
                e.packed -= more
                body += more
            more = int.from_bytes(src.need(place - wide, wide), "little")
        e.name = folder + (b"/" if folder and not folder.endswith(b"/") else b"") + title
        e.separators, e.offset = "/\\", body
        if method == b"-lhd-":
            e.directory, e.size = True, 0
        else:

            def decode(_, body=body, n=e.packed, size=size, method=method) -> bytes:
                data = src.need(body, n)
                if method in (b"-lh0-", b"-lz4-", b"-pm0-"):
                    return data
                if method in (b"-lh4-", b"-lh5-", b"-lh6-", b"-lh7-"):
                    return lzh_static(data, size, {b"-lh4-": 12, b"-lh5-": 13, b"-lh6-": 15, b"-lh7-": 16}[method])
                if method == b"-lh1-":
                    return lh1(data, size)
                if method == b"-lzs-":
                    return larc_lzs(data, size)
                if method == b"-lz5-":
                    return larc_lz5(data, size)
                raise Unsupported(method.decode("latin-1"))

            e.decode, e.check = decode, lambda d, crc=crc: crc16(d) == crc
        yield e
        at = body + e.packed


def arc(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    at, above = base, []
    while src.at(at, 1) == b"\x1a":
        method = src.need(at + 1, 1)[0] & 0x7F
        if method in (0, 31):
            if above:
                above.pop()
                at += 2
                continue
            return
        packed, day, clock, crc = src.get("<IHHH", at + 15)
        size, body = (packed, at + 25) if method == 1 else (src.get("<I", at + 25)[0], at + 29)
        title = src.need(at + 2, 13).split(b"\0")[0]
        path = b"/".join([*above, title])
        if method == 30:
            above.append(title)
            yield Entry(path, directory=True, modified=dos_time(day << 16 | clock))
            at = body
            continue

        def decode(_, method=method, body=body, packed=packed, size=size) -> bytes:
            data = src.need(body, packed)
            try:
                if method in (1, 2):
                    return data
                if method == 3:
                    return rle90(data)
                if method == 4:
                    return rle90(squeeze(data))
                if method in (5, 6, 7):
                    plain = arc_crunch(data, method == 7)
                    return plain if method == 5 else rle90(plain)
                if method == 8:
                    return rle90(unix_compress(b"\x1f\x9d" + bytes([data[0] | 0x80]) + data[1:]))
                if method == 9:
                    return unix_compress(b"\x1f\x9d\x8d" + data)
            except (struct.error, IndexError) as e:
                raise Damaged(str(e)) from e
            raise Unsupported(ARC.get(method, f"method {method}"))

        yield Entry(path, size, packed, ARC.get(method, f"Method {method}"), modified=dos_time(day << 16 | clock), offset=body, decode=decode, check=lambda d, crc=crc: crc16(d) == crc, extras={"ARCMethod": str(method)})
        at = body + packed


def zoo(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    at = src.get("<I", 24)[0]
    while at:
        tag, _, method, after, body, day, clock, crc, size, packed, _, _, deleted = src.get("<IBBIIHHHIIBBB", at)
        if tag != 0xFDC4A7DC:
            raise Corrupt("no header")
        if not after:
            return
        if after <= at:
            raise Corrupt("headers go back")
        title = src.need(at + 38, 13).split(b"\0")[0]
        if src.need(at + 4, 1)[0] >= 2:
            n, m = src.need(at + 56, 2)
            long, folder = src.at(at + 58, n).rstrip(b"\0"), src.at(at + 58 + n, m).rstrip(b"\0")
            title = (folder + b"/" if folder else b"") + (long or title)
        if not deleted:

            def decode(_, method=method, body=body, packed=packed, size=size) -> bytes:
                data = src.need(body, packed)
                if method == 0:
                    return data
                if method == 1:
                    return lzw(data)
                if method == 2:
                    return lzh_static(data, size, 13)
                raise Unsupported(f"Zoo method {method}")

            yield Entry(title, size, packed, {0: "None", 1: "LZW", 2: "LZH"}.get(method, f"Method {method}"), modified=dos_time(day << 16 | clock), offset=body, decode=decode, check=lambda d, crc=crc: crc16(d) == crc)
        at = after


def arj(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    at, first = base, True
    while True:
        mark, n = src.get("<HH", at)
        if mark != 0xEA60:
            raise Corrupt("no header")
        if not n:
            return
        h = src.need(at + 4, n)
        if zlib.crc32(h) != src.get("<I", at + 4 + n)[0]:
            raise Corrupt("header checksum differs")
        at += 8 + n
        while (more := src.get("<H", at)[0]) != 0:
            at += 6 + more
        at += 2
        if first:
            first = False
            continue
        head, system, flags, method, kind, stamp, packed, size, crc = h[0], h[3], h[4], h[5], h[6], *struct.unpack_from("<IIII", h, 8)
        title, _, comment = h[head:].partition(b"\0")
        mode = struct.unpack_from("<H", h, 26)[0]

        def decode(_, method=method, body=at, packed=packed, size=size, locked=flags & 1) -> bytes:
            if locked:
                raise Unsupported("ARJ encryption")
            data = src.need(body, packed)
            if method == 0:
                return data
            if method in (1, 2, 3):
                return _arj_lzh(data, size)
            if method == 4:
                return arj_fastest(data, size)
            raise Unsupported(f"ARJ method {method}")

        unix = system in (2, 8)
        yield Entry(title, size, packed, ARJ.get(method, f"Method {method}"), directory=kind == 3 or None, modified=unix_time(stamp) if unix else dos_time(stamp), mode=mode if unix else None, dos=None if unix else mode & 255, comment=comment.split(b"\0")[0].decode("latin-1") or None, encrypted=bool(flags & 1) or None, offset=at, decode=None if kind == 3 else decode, check=crc32_is(crc))
        at += packed


def _arj_lzh(data: bytes, size: int) -> bytes:
    """The same blocks as -lh6-, with a window of 26,624 bytes and up to 17 classes of distance."""
    return lzh_static(data, size, 16)


def cab(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Folders are runs of blocks, files are slices of a folder's plain bytes."""
    files_at, minor, major, nfolders, nfiles, flags = src.get("<IxxxxBBHHH", base + 16)
    at, lead_folder, lead_data = base + 36, 0, 0
    if flags & 4:
        lead, lead_folder, lead_data = src.get("<HBB", at)
        at += 4 + lead
    for bit in (1, 2):
        if flags & bit:
            for _ in range(2):
                at = src.find(b"\0", at) + 1
    folders = []
    for _ in range(nfolders):
        folders.append(src.get("<IHH", at))
        at += 8 + lead_folder
    plain: dict[int, bytes] = {}

    def folder(k: int) -> bytes:
        if k not in plain:
            place, count, kind = folders[k]
            place, blocks, sizes_ = base + place, [], []
            for _ in range(count):
                _, packed, plain_size = src.get("<IHH", place)
                blocks.append(src.need(place + 8 + lead_data, packed))
                sizes_.append(plain_size)
                place += 8 + lead_data + packed
            if kind & 15 == 0:
                out = b"".join(blocks)
            elif kind & 15 == 1:
                out = ms_zip(blocks)
            elif kind & 15 == 2:
                out = quantum(blocks, sizes_, kind >> 8 & 31)
            elif kind & 15 == 3:
                out = lzx(b"".join(blocks), sum(sizes_), kind >> 8 & 31)
            else:
                raise Unsupported(f"method {kind & 15}")
            plain.clear()
            plain[k] = out
        return plain[k]

    at = base + files_at
    sizes: dict[int, int] = {}
    for _ in range(nfiles):
        size, place, k, day, clock, attributes = src.get("<IIHHHH", at)
        stop = src.find(b"\0", at + 16)
        raw = src.at(at + 16, stop - at - 16)
        at = stop + 1
        known = k < nfolders
        kind = folders[k][2] & 15 if known else 0
        sizes[k] = sizes.get(k, 0) + size
        yield Entry(raw.decode("utf-8", "replace") if attributes & 0x80 else raw, size, None, {0: "None", 1: "MSZIP", 2: "Quantum", 3: "LZX"}.get(kind, f"Method {kind}"), modified=dos_time(day << 16 | clock), dos=attributes & 0x27, separators="\\", solid=k if known else None, solid_offset=place if known else None, decode=(lambda _, k=k, place=place, size=size: folder(k)[place : place + size]) if known else _not_here("other volumes"))


def alzip(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    at = 8
    while src.at(at, 4) == b"BLZ\1":
        n, attributes, stamp, flags = src.get("<HBIH", at + 4)
        at += 13
        e = Entry(b"", dos=attributes, modified=dos_time(stamp), directory=bool(attributes & 16) or None, separators="/\\")
        wide = flags >> 4 & 15
        if wide:
            method, _, crc = src.get("<BBI", at)
            e.packed, e.size = (int.from_bytes(src.need(at + 6 + i * wide, wide), "little") for i in (0, 1))
            at += 6 + 2 * wide
            e.method = {0: "None", 1: "Bzip2", 2: "Deflate", 3: "Obfuscated deflate"}.get(method, f"Method {method}")
        e.name = src.need(at, n)
        at += n
        if flags & 1:
            e.encrypted = True
            at += 12
        e.offset = at
        if wide:

            def decode(_, method=method, body=at, n=e.packed, locked=flags & 1) -> bytes:
                if locked:
                    raise Unsupported("ALZip encryption")
                data = src.need(body, n)
                if method == 0:
                    return data
                if method == 1:
                    return expand(bz2.BZ2Decompressor(), data)
                if method == 2:
                    return inflate(data)
                raise Unsupported("ALZip method 3")

            e.decode, e.check = decode, crc32_is(crc)
        yield e
        at += e.packed or 0


class _Run:
    """The files of a solid run: each is decoded once those before it are, and kept until the next one is wanted."""

    def __init__(self, unpacker) -> None:
        self.new, self.files, self.at, self.engine, self.held = unpacker, [], 0, None, b""

    def add(self, data, size: int):
        self.files.append((data, size))
        k = len(self.files) - 1

        def decode(password: bytes | None) -> bytes:
            if self.engine is None or k < self.at - 1:
                self.engine, self.at = self.new(), 0
            while self.at <= k:
                data, size = self.files[self.at]
                self.held = self.engine.decode(data(password), size)
                self.at += 1
            return self.held

        return decode


def rar(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Blocks of RAR 1.5 to 4, also over volumes, whose parts of a file are put together; methods of RAR 2.9 and later
    are decoded."""
    pending: tuple | None = None
    run, count = _Run(Rar3), 0
    for volume, part in enumerate(src.volumes()):
        at = (base if not volume else max(0, part.find(b"Rar!\x1a\7\0"))) + 7
        while at + 7 <= part.size:
            _, kind, flags, n = part.get("<HBHH", at)
            more = part.get("<I", at + 7)[0] if flags & 0x8000 or kind == 0x74 else 0
            if kind == 0x73 and flags & 0x80:
                raise Unsupported("encrypted headers")
            if kind == 0x7B or n < 7:
                break
            if kind == 0x74:
                packed, size, system, crc, stamp, version, method, m, attributes = part.get("<IIBIIBBHI", at + 7)
                place = at + 32
                if flags & 0x100:
                    high = part.get("<II", place)
                    packed, size, place = packed | high[0] << 32, size | high[1] << 32, place + 8
                raw = part.need(place, m)
                salt = part.need(place + m, 8) if flags & 0x400 else b""
                more = packed
                if flags & 1 and pending:
                    e, places = pending
                else:
                    e, places = Entry(raw.split(b"\0")[0], size, 0, f"{RAR_METHODS.get(method, method)} v{version // 10}.{version % 10}", modified=dos_time(stamp), directory=flags & 0xE0 == 0xE0 or None, encrypted=bool(flags & 4) or None, separators="\\/", offset=at + n, extras={"RARFlags": str(flags), "RAROS": str(system), "RAROSName": RAR_SYSTEMS.get(system, str(system))}), []
                    if system == 3:
                        e.mode = attributes & 0xFFFF
                    else:
                        e.dos = attributes & 255
                    if not flags & 0x10:
                        run, count = _Run(Rar2 if version in (20, 26) else Rar3), count + 1
                    e.solid = count
                places.append((part, at + n, packed))
                e.packed += packed
                e.extras["RARCRC32"] = str(crc)
                pending = (e, places) if flags & 2 else None
                if not pending:
                    if not e.directory:
                        e.check = crc32_is(crc)

                        def data(password: bytes | None, places=places, flags=flags, salt=salt) -> bytes:
                            body = b"".join(p.need(a, k) for p, a, k in places)
                            if not flags & 4:
                                return body
                            if password is None:
                                raise WrongPassword("a password is needed")
                            return rar3_plain(body, password.decode(), salt)

                        if method == 0x30:
                            e.decode = lambda password, data=data, size=size: data(password)[:size]
                        elif version not in (20, 26) and version < 29 or flags & 4 and version < 29:
                            e.decode = _not_here("compression or ciphers before RAR 2.0")
                        else:
                            e.decode = run.add(data, size)
                    yield e
            at += n + more
    if pending:
        e = pending[0]
        e.corrupted, e.decode = True, _not_here("volumes that are missing")
        yield e


def vint(src: Source, at: int) -> tuple[int, int]:
    """Seven bits a byte, the least significant first; a set top bit goes on. The value, and where it ends."""
    value = shift = 0
    while True:
        b = src.need(at, 1)[0]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if not b & 128:
            return value, at
        if shift > 63:
            raise Corrupt("number too long")


def rar5(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Blocks of RAR 5, also over volumes, whose parts of a file are put together."""
    pending: tuple | None = None
    run, count = _Run(Rar5), 0
    for volume, part in enumerate(src.volumes()):
        at = (base if not volume else max(0, part.find(b"Rar!\x1a\7\1\0"))) + 8
        while at + 7 <= part.size:
            n, start = vint(part, at + 4)
            if zlib.crc32(part.need(at + 4, start - at - 4 + n)) != part.get("<I", at)[0]:
                raise Corrupt("header checksum differs")
            kind, p = vint(part, start)
            flags, p = vint(part, p)
            extra = size = 0
            if flags & 1:
                extra, p = vint(part, p)
            if flags & 2:
                size, p = vint(part, p)
            body = start + n
            if kind == 5:
                break
            if kind == 4:
                raise Unsupported("encrypted headers")
            if kind == 2:
                e, own = _rar5_file(part, p, body, extra, size)
                if flags & 8 and pending:
                    first, places, _ = pending
                    first.packed += size
                    first.check = e.check
                    e = first
                else:
                    places = []
                    if not own["solid"]:
                        run, count = _Run(Rar5), count + 1
                    e.solid = count
                places.append((part, body, size))
                pending = (e, places, own) if flags & 16 else None
                if not pending:
                    if not e.directory and not e.link:
                        _rar5_content(e, places, own, run)
                    yield e
            at = body + size
    if pending:
        e = pending[0]
        e.corrupted, e.decode = True, _not_here("volumes that are missing")
        yield e


def _rar5_file(src: Source, p: int, body: int, extra: int, packed: int) -> tuple[Entry, dict]:
    """An entry from its header's fields, and what its content needs: level, solid, crc, and the cipher's numbers."""
    own, p = vint(src, p)
    plain, p = vint(src, p)
    attributes, p = vint(src, p)
    e = Entry(b"", None if own & 8 else plain, packed, directory=bool(own & 1) or None, offset=body)
    more: dict = {"crc": None, "cipher": None}
    if own & 2:
        e.modified, p = unix_time(src.get("<I", p)[0]), p + 4
    if own & 4:
        more["crc"], p = src.get("<I", p)[0], p + 4
        e.check = crc32_is(more["crc"])
    method, p = vint(src, p)
    system, p = vint(src, p)
    m, p = vint(src, p)
    e.name = src.need(p, m).decode("utf-8", "replace")
    level = method >> 7 & 7
    more |= {"level": level, "solid": bool(method & 0x40), "version": method & 0x3F}
    e.method = RAR5_METHODS[level] if level < 6 else f"Method {level}"
    e.extras |= {"RAR5OS": str(system), "RAR5OSName": ("Windows", "Unix")[system] if system < 2 else str(system)}
    if system == 1:
        e.mode = attributes
    else:
        e.dos = attributes & 255
    p, end = body - extra, body
    while p < end:
        k, q = vint(src, p)
        tag, r = vint(src, q)
        if tag == 1:
            e.encrypted = True
            _, r = vint(src, r)
            bits, r = vint(src, r)
            more["cipher"] = (src.need(r, 1)[0], src.need(r + 1, 16), src.need(r + 17, 16), src.need(r + 33, 12) if bits & 1 else None, bool(bits & 2))
        elif tag == 3:
            bits, r = vint(src, r)
            for bit, key in ((2, "modified"), (4, "created"), (8, "accessed")):
                if bits & bit:
                    setattr(e, key, unix_time(src.get("<I", r)[0]) if bits & 1 else file_time(src.get("<Q", r)[0]))
                    r += 4 if bits & 1 else 8
        elif tag == 5:
            which, r = vint(src, r)
            _, r = vint(src, r)
            m, r = vint(src, r)
            e.extras["RAR5RedirectionType"] = str(which)
            e.link, e.hard_link = src.need(r, m).decode("utf-8", "replace"), which == 4 or None
        p = q + k
    return e, more


def _rar5_content(e: Entry, places: list, own: dict, run: _Run) -> None:
    crc, cipher = own["crc"], own["cipher"]
    told: dict[str, bytes] = {}

    def data(password: bytes | None) -> bytes:
        body = b"".join(p.need(a, k) for p, a, k in places)
        if not cipher:
            return body
        if password is None:
            raise WrongPassword("a password is needed")
        key, told["sums"] = rar5_key(password, cipher[1], cipher[0], cipher[3])
        return aes_cbc(body, key, cipher[2])

    if cipher and cipher[4] and crc is not None:
        e.check = lambda content: rar5_checksum(zlib.crc32(content), told["sums"]) == crc
    if not own["level"]:
        e.decode = lambda password: data(password)[: e.size if e.size is not None else None]
    elif own["version"] or e.size is None:
        e.decode = _not_here("a later version of RAR")
    else:
        e.decode = run.add(data, e.size)


def nds(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    names_at, _, table_at, _ = src.get("<IIII", 0x40)

    seen: set[int] = set()

    def walk(folder: int, above: bytes, depth: int) -> Iterator[Entry]:
        if folder in seen:
            return
        seen.add(folder)
        place, number = src.get("<IH", names_at + 8 * (folder & 0xFFF))
        at = names_at + place
        while (n := src.need(at, 1)[0]) and depth < 64:
            title = above + src.need(at + 1, n & 127)
            at += 1 + (n & 127)
            if n & 128:
                child = src.get("<H", at)[0]
                at += 2
                yield Entry(title, directory=True)
                yield from walk(child, title + b"/", depth + 1)
            else:
                a, b = src.get("<II", table_at + 8 * number)
                number += 1
                yield Entry(title, b - a, b - a, "None", offset=a, decode=lambda _, a=a, b=b: src.need(a, b - a))

    yield from walk(0xF000, b"", 0)


def cfbf(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Sector chains by the allocation table; directory entries are trees of siblings below their storage."""
    shift, small_shift = src.get("<HH", 30)
    sector, small = 1 << shift, 1 << small_shift
    dir_at, limit, small_at = src.get("<I", 48)[0], src.get("<I", 56)[0], src.get("<I", 60)[0]
    places = list(src.get("<109I", 76))
    more, count = src.get("<II", 68)
    while count and more < 0xFFFFFFFA:
        block = struct.unpack(f"<{sector // 4}I", src.need((more + 1) * sector, sector))
        places += block[:-1]
        more, count = block[-1], count - 1
    table = [v for p in places if p < 0xFFFFFFFA for v in struct.unpack(f"<{sector // 4}I", src.at((p + 1) * sector, sector).ljust(sector, b"\xff"))]

    def chain(at: int, links: list[int]) -> list[int]:
        out, seen = [], set()
        while at < len(links) and at not in seen:
            seen.add(at)
            out.append(at)
            at = links[at]
        return out

    def whole(at: int) -> bytes:
        return b"".join(src.at((s + 1) * sector, sector) for s in chain(at, table))

    rows = whole(dir_at)
    nodes = [rows[i : i + 128] for i in range(0, len(rows) - 127, 128)]
    if not nodes:
        raise Corrupt("no directory")
    minor = whole(int.from_bytes(nodes[0][116:120], "little"))
    small_links = [v for (v,) in struct.iter_unpack("<I", whole(small_at))] if small_at < 0xFFFFFFFA else []

    seen: set[int] = set()

    def walk(k: int, above: str) -> Iterator[Entry]:
        if k >= len(nodes) or k in seen:
            return
        d = nodes[k]
        left, right, child = struct.unpack_from("<III", d, 68)
        seen.add(k)
        yield from walk(left, above)
        title = d[: max(0, int.from_bytes(d[64:66], "little") - 2)].decode("utf-16-le", "replace")
        path = f"{above}/{title}" if above else title
        if d[66] == 1:
            yield Entry(path, directory=True)
            yield from walk(child, path)
        elif d[66] == 2:
            start, size = int.from_bytes(d[116:120], "little"), int.from_bytes(d[120:124], "little")

            def decode(_, start=start, size=size) -> bytes:
                if size >= limit:
                    return whole(start)[:size]
                return b"".join(minor[s * small : (s + 1) * small] for s in chain(start, small_links))[:size]

            yield Entry(path, size, size, "None", decode=decode)
        yield from walk(right, above)

    yield from walk(int.from_bytes(nodes[0][76:80], "little"), "")


def ppmd(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    order = "<" if src.at(0, 4) == b"\x8f\xaf\xac\x84" else ">"
    attributes, info, n, stamp = src.get(order + "IHHI", 4)
    variant = chr(ord("A") + (info >> 12))
    yield Entry(src.need(16, n & 0x3FFF), None, src.size - 16 - (n & 0x3FFF), f"PPMd Variant {variant}", modified=dos_time(stamp), dos=attributes & 255, decode=_not_here(f"PPMd variant {variant} as a file"))


def powerpacker(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Bits from the end to the start; the last three bytes are the size, the last one bits to skip."""
    widths, tail = src.need(4, 4), src.need(src.size - 4, 4)
    size, skip = int.from_bytes(tail[:3], "big"), tail[3]

    def decode(_: bytes | None) -> bytes:
        body = src.at(8, src.size - 12)
        bits = Bits(body[::-1], low_first=True)
        bits.read(skip)
        one = lambda k: int("".join(str(bits.read(1)) for _ in range(k)) or "0", 2)
        if size > LIMIT.get():
            raise TooLarge("too many bytes come out")
        out = bytearray(size)
        at = size
        while at:
            if not bits.read(1):
                n = 1
                while (k := one(2)) == 3:
                    n += 3
                for _ in range(n + k):
                    at -= 1
                    out[at] = one(8)
                if not at:
                    break
            k = one(2)
            width, n = widths[k], k + 2
            if k == 3:
                width = width if bits.read(1) else 7
                far = one(width)
                while (m := one(3)) == 7:
                    n += 7
                n += m
            else:
                far = one(width)
            for _ in range(n):
                at -= 1
                if at < 0 or at + far + 1 >= size:
                    raise Damaged("out of range")
                out[at] = out[at + far + 1]
        return bytes(out)

    yield Entry(name.rsplit("/", 1)[-1].removesuffix(".pp"), size, src.size, "PowerPacker", decode=decode)

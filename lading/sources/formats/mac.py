"""Formats of classic Mac OS: MacBinary, AppleSingle, BinHex, PackIt, StuffIt. Each fork is an entry."""

from __future__ import annotations

import binascii
import hashlib
import zlib
from collections.abc import Iterator

from ...functions.codecs import arsenic, compact_lzh, compact_rle
from ...functions.kernels import LIMIT, Bits, Damaged, TooLarge, Unsupported, WrongPassword, crc16, crc16_ccitt, rc4, rle90, unix_compress
from ..source import Source
from .entry import Corrupt, Entry, mac_time

#: The letters of BinHex, and those of Base64, for six bits each.
BINHEX = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
BASE64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: StuffIt's methods.
STUFFIT = {0: "None", 1: "RLE", 2: "Compress", 3: "Huffman", 5: "LZAH", 6: "Fixed Huffman", 8: "MW", 13: "LZ+Huffman", 14: "Installer", 15: "Arsenic"}


def _forks(title: bytes, data, resource, finder: bytes, **shared) -> Iterator[Entry]:
    """The data fork, or the resource fork, or both; an empty file has a data fork."""
    kinds = {"FileType": finder[:4].decode("mac-roman"), "FileCreator": finder[4:8].decode("mac-roman"), "FinderFlags": str(int.from_bytes(finder[8:10], "big"))}
    for fork, part in ((None, data), (True, resource)):
        if part["size"] or (fork is None and not resource["size"]):
            yield Entry(title, fork=fork, encoding="mac-roman", separators="", extras=dict(kinds), **shared, **part)


def _plain(src: Source, at: int, n: int) -> dict:
    return {"size": n, "packed": n, "method": "None", "offset": at, "decode": lambda _: src.need(at, n)}


def macbinary(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    h = src.need(0, 128)
    data, resource = int.from_bytes(h[83:87], "big"), int.from_bytes(h[87:91], "big")
    start = 128 + (int.from_bytes(h[120:122], "big") + 127) // 128 * 128
    finder = h[65:73] + bytes([h[73], h[101]])
    yield from _forks(h[2 : 2 + h[1]], _plain(src, start, data), _plain(src, start + (data + 127) // 128 * 128, resource), finder, created=mac_time(int.from_bytes(h[91:95], "big")), modified=mac_time(int.from_bytes(h[95:99], "big")))


def applesingle(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    order = ">" if src.at(0, 2) == b"\0\5" else "<"
    (count,) = src.get(order + "H", 24)
    parts = {}
    for i in range(count):
        kind, at, n = src.get(order + "III", 26 + 12 * i)
        parts[kind] = (at, n)
    title = src.need(*parts[3]) if 3 in parts else name.rsplit("/", 1)[-1].encode()
    finder = src.need(*parts[9])[:10].ljust(10, b"\0") if 9 in parts else b"\0" * 10
    shared = {}
    if 8 in parts:
        from .entry import unix_time

        stamps = src.get(order + "iiii", parts[8][0])
        shared = {k: unix_time(t + 946684800) if t != -(2**31) else None for k, t in zip(("created", "modified", "accessed"), (stamps[0], stamps[1], stamps[3]), strict=True)}
    yield from _forks(title, _plain(src, *parts.get(1, (0, 0))), _plain(src, *parts.get(2, (0, 0))), finder, **shared)


def binhex(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Six bits a character between colons, then run lengths, then a header, two forks and a CRC behind each."""
    text = src.at(base, src.size)
    body = text[text.find(b":") + 1 :].partition(b":")[0].translate(None, b"\r\n\t ")
    if body.translate(None, BINHEX):
        raise Corrupt("no such character")
    whole = body.translate(bytes.maketrans(BINHEX, BASE64)) + b"A" * (-len(body) % 4)
    plain = rle90(binascii.a2b_base64(whole)[: 6 * len(body) // 8])
    n = plain[0]
    h = plain[n + 2 : n + 20]
    data, resource = int.from_bytes(h[10:14], "big"), int.from_bytes(h[14:18], "big")
    at = n + 22

    def part(start: int, size: int) -> dict:
        want = int.from_bytes(plain[start + size : start + size + 2], "big")
        return {"size": size, "method": "None", "decode": lambda _: plain[start : start + size], "check": lambda d: crc16_ccitt(d) == want}

    yield from _forks(plain[1 : 1 + n], part(at, data), part(at + data + 2, resource), h[:8] + h[8:10])


def packit(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    at = 0
    while (magic := src.at(at, 4)) not in (b"PEnd", b""):
        if magic == b"PMag":
            h = src.need(at + 4, 94)
            data, resource = int.from_bytes(h[78:82], "big"), int.from_bytes(h[82:86], "big")
            body = at + 98
            yield from _forks(h[1 : 1 + h[0]], _plain(src, body, data), _plain(src, body + data, resource), h[64:74], created=mac_time(int.from_bytes(h[86:90], "big")), modified=mac_time(int.from_bytes(h[90:94], "big")))
            at = body + data + resource + 2
        elif magic == b"PMa4":
            plain, used = _huffman(src.at(at + 4, src.size))
            h = plain[:94]
            data, resource = int.from_bytes(h[78:82], "big"), int.from_bytes(h[82:86], "big")
            mem = Source(plain)
            yield from _forks(h[1 : 1 + h[0]], _plain(mem, 94 + 2, data), _plain(mem, 96 + data, resource), h[64:74])
            at += 4 + used
        else:
            raise Unsupported("encrypted PackIt")


def _huffman(data: bytes) -> tuple[bytes, int]:
    """PackIt's and StuffIt's tree: a one is a leaf and its byte. Sizes are in the header that comes first."""
    bits = Bits(data)

    def tree():
        return bits.read(8) if bits.read(1) else (tree(), tree())

    root, out, want = tree(), bytearray(), 94
    if not isinstance(root, tuple):
        raise Damaged("a tree of one leaf")
    while len(out) < want:
        node = root
        while isinstance(node, tuple):
            node = node[bits.read(1)]
        out.append(node)
        if len(out) == 94:
            want = 94 + 2 + int.from_bytes(out[78:82], "big") + int.from_bytes(out[82:86], "big") + 2
    return bytes(out), bits.place()


def stuffit(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Headers of 112 bytes; folders begin and end with methods 32 and 33."""
    total = int.from_bytes(src.need(6, 4), "big")
    at, above = 22, []
    while at + 112 <= min(src.size, max(total, 22)):
        h = src.need(at, 112)
        if crc16(h[:110]) != int.from_bytes(h[110:112], "big"):
            raise Corrupt("header checksum differs")
        rm, dm, title = h[0], h[1], h[3 : 3 + h[2]]
        rsize, dsize, rpacked, dpacked, rcrc, dcrc = *(int.from_bytes(h[i : i + 4], "big") for i in (84, 88, 92, 96)), int.from_bytes(h[100:102], "big"), int.from_bytes(h[102:104], "big")
        body = at + 112
        path = b"/".join([*above, title])
        shared = {"created": mac_time(int.from_bytes(h[76:80], "big")), "modified": mac_time(int.from_bytes(h[80:84], "big"))}
        if dm & 0x6F == 32 or rm & 0x6F == 32:
            above.append(title)
            yield Entry(path, directory=True, encoding="mac-roman", **shared)
            at = body
            continue
        if dm & 0x6F == 33 or rm & 0x6F == 33:
            above = above[:-1]
            at = body
            continue

        def part(start: int, size: int, packed: int, method: int, crc: int) -> dict:
            def decode(_: bytes | None) -> bytes:
                if method & 0x80:
                    raise Unsupported("StuffIt encryption")
                data, told = _unstuffed(method & 15, src.need(start, packed), size)
                seen[:] = [told]
                return data

            seen: list[int | None] = []
            return {"size": size, "packed": packed, "method": STUFFIT.get(method & 15, f"Method {method & 15}"), "offset": start, "encrypted": bool(method & 0x80) or None, "decode": decode, "check": lambda d: _sound(d, seen, crc)}

        for e in _forks(path, part(body + rpacked, dsize, dpacked, dm, dcrc), part(body, rsize, rpacked, rm, rcrc), h[66:76], **shared):
            e.separators = "/"
            yield e
        at = body + rpacked + dpacked


def _unstuffed(method: int, data: bytes, size: int) -> tuple[bytes, int | None]:
    """Content, and its CRC-32 if the method tells one."""
    if method == 0:
        return data, None
    if method == 1:
        return rle90(data), None
    if method == 2:
        return unix_compress(b"\x1f\x9d\x8e" + data)[:size], None
    if method == 3:
        return _tree_coded(data, size), None
    if method == 15:
        return arsenic(data, size)
    raise Unsupported(STUFFIT.get(method, f"method {method}"))


def _sound(data: bytes, told: list[int | None], crc: int) -> bool:
    """By the CRC-32 of the content's stream, or by the CRC-16 of its header."""
    return zlib.crc32(data) == told[0] if told and told[0] is not None else crc16(data) == crc


def stuffit5(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Entries one after another, folders before what they hold, which names them by their place; the resource fork's
    data come before those of the data fork."""
    version, flags, _, _, left, first = src.get(">BBIIHI", base + 82)
    if version != 5:
        raise Corrupt("no such version")
    at = base + 100 + (14 if flags & 0x10 else 0) + (4 if flags & 0x20 else 0)
    lock = src.need(at + 1, src.need(at, 1)[0]) if flags & 0x80 else b""
    at, folders = base + first, {}
    while left > 0:
        left -= 1
        place = at - base
        mark, version, head, kind, created, modified, _, _, above, n, _, dsize, dpacked, dcrc, dm, keyed = src.get(">IBxHxBIIIIIHHIIHxxBB", at)
        if mark != 0xA5A5A5A5:
            raise Corrupt("no entry here")
        folder = bool(kind & 0x40)
        if folder and dsize == 0xFFFFFFFF:
            left, at = left + 1, at + 48
            continue
        p = at + 48
        dkey = b"" if folder else src.need(p, keyed)
        p += len(dkey)
        title, p = src.need(p, n), p + n
        note = b""
        if p < at + head:
            note = src.need(p + 4, src.get(">H", p)[0])
            p += 4 + len(note)
        marks = src.get(">H", p)[0]
        finder, p = src.need(p + 4, 10), p + (36 if version == 1 else 32)
        rsize = rpacked = rcrc = rm = 0
        rkey = b""
        if marks & 1:
            rsize, rpacked, rcrc, rm, keyed = src.get(">IIHxxBB", p)
            rkey = src.need(p + 14, keyed)
            p += 14 + keyed
        path = folders.get(above, b"") + title
        shared = {"created": mac_time(created), "modified": mac_time(modified), "comment": note.decode("mac-roman") or None}
        if folder:
            folders[place] = path + b"/"
            left += src.get(">H", at + 46)[0]
            yield Entry(path, directory=True, encoding="mac-roman", **shared)
            at = p
            continue

        def part(start: int, size: int, packed: int, method: int, crc: int, key: bytes) -> dict:
            seen: list[int | None] = []

            def decode(password: bytes | None) -> bytes:
                data = src.need(start, packed)
                if key:
                    own = hashlib.md5(password or b"").digest()[:5]
                    if password is None or hashlib.md5(own).digest()[:5] != lock:
                        raise WrongPassword("a password is needed")
                    data = rc4(data, own + key)
                data, told = _unstuffed(method, data, size)
                seen[:] = [told]
                return data

            return {"size": size, "packed": packed, "method": STUFFIT.get(method, f"Method {method}"), "offset": start, "encrypted": bool(key) or None, "decode": decode, "check": lambda d: _sound(d, seen, crc)}

        for e in _forks(path, part(p + rpacked, dsize, dpacked, dm, dcrc, dkey), part(p, rsize, rpacked, rm, rcrc, rkey), finder, **shared):
            e.separators = "/"
            yield e
        at = p + rpacked + dpacked


def _tree_coded(data: bytes, size: int) -> bytes:
    bits = Bits(data)

    def tree():
        return bits.read(8) if bits.read(1) else (tree(), tree())

    try:
        root, out = tree(), bytearray()
    except RecursionError as e:
        raise Damaged("tree too deep") from e
    if size > LIMIT.get():
        raise TooLarge("too many bytes come out")
    if not isinstance(root, tuple):
        return bytes([root]) * size
    while len(out) < size:
        node = root
        while isinstance(node, tuple):
            node = node[bits.read(1)]
        out.append(node)
    return bytes(out)


def compact_pro(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """A directory behind the data: folders say how many entries they hold, files where their two forks are, resource
    fork first, run lengths over LZH by flags."""
    at = int.from_bytes(src.need(4, 4), "big")
    count, note = src.get(">HB", at + 4)
    left = [(at + 7 + note, count, b"")]

    def walk(at: int, count: int, above: bytes) -> Iterator[tuple[int, Entry | None]]:
        while count > 0:
            n = src.need(at, 1)[0]
            title = above + src.need(at + 1, n & 127)
            at += 1 + (n & 127)
            if n & 128:
                (inner,) = src.get(">H", at)
                at += 2
                yield at, Entry(title, directory=True, encoding="mac-roman")
                for where, e in walk(at, inner, title + b"/"):
                    at = where
                    yield where, e
                count -= inner + 1
                continue
            _, place, finder, created, modified, more, crc, flags, rsize, dsize, rpacked, dpacked = src.get(">BI8sIIHIHIIII", at)
            at += 45
            count -= 1

            def part(start: int, size: int, packed: int, lzh: int, flags: int = flags) -> dict:
                def decode(_: bytes | None) -> bytes:
                    if flags & 1:
                        raise Unsupported("Compact Pro encryption")
                    data = src.need(start, packed)
                    return compact_rle(compact_lzh(data, 2 * size + 1024) if lzh else data)[:size]

                return {"size": size, "packed": packed, "method": "LZH+RLE" if lzh else "RLE", "offset": start, "encrypted": bool(flags & 1) or None, "decode": decode}

            own = list(_forks(title, part(place + rpacked, dsize, dpacked, flags & 4), part(place, rsize, rpacked, flags & 2), finder + more.to_bytes(2, "big"), created=mac_time(created), modified=mac_time(modified)))
            if len(own) == 1:
                own[0].check = lambda d, crc=crc: zlib.crc32(d) ^ 0xFFFFFFFF == crc or zlib.crc32(d) == crc
            for e in own:
                e.separators = "/"
                yield at, e
        yield at, None

    for place, n, above in left:
        yield from (e for _, e in walk(place, n, above) if e is not None)

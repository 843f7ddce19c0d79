"""7-Zip: folders of coders over packed streams, cut into substreams, matched with files by place."""

from __future__ import annotations

import bz2
import hashlib
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ...functions.codecs import bcj2
from ...functions.kernels import LIMIT, Damaged, TooLarge, Unsupported, WrongPassword, aes_cbc, expand, inflate, inflate64
from ...functions.ppmd import seven_zip
from ..source import Source
from .entry import Corrupt, Entry, crc32_is, file_time

#: coders' ids, and the filters of the standard library for them.
NAMES = {b"\0": "None", b"\3": "Delta", b"\4": "x86", b"\x21": "LZMA2", b"\3\1\1": "LZMA", b"\3\3\1\3": "BCJ", b"\3\3\1\x1b": "BCJ2", b"\3\3\2\5": "PPC", b"\3\3\4\1": "IA64", b"\3\3\5\1": "ARM", b"\3\3\7\1": "ARM Thumb", b"\3\3\x08\5": "SPARC", b"\3\4\1": "PPMd", b"\4\1\x08": "Deflate", b"\4\1\x09": "Deflate64", b"\4\2\2": "Bzip2", b"\6\xf1\7\1": "AES-256"}
BRANCHES = {b"\4": lzma.FILTER_X86, b"\3\3\1\3": lzma.FILTER_X86, b"\3\3\2\5": lzma.FILTER_POWERPC, b"\3\3\4\1": lzma.FILTER_IA64, b"\3\3\5\1": lzma.FILTER_ARM, b"\3\3\7\1": lzma.FILTER_ARMTHUMB, b"\3\3\x08\5": lzma.FILTER_SPARC}


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Corrupt("header ends too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """One to nine bytes; ones at the first byte's top tell how many follow."""
        first, value, mask, k = self.byte(), 0, 0x80, 0
        while k < 8 and first & mask:
            value |= self.byte() << 8 * k
            mask >>= 1
            k += 1
        return value | (first & mask - 1) << 8 * k if k < 8 else value

    def bits(self, n: int) -> list[bool]:
        data = self.take((n + 7) // 8)
        return [bool(data[i // 8] >> 7 - i % 8 & 1) for i in range(n)]

    def all_or_bits(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


@dataclass
class Folder:
    coders: list[tuple[bytes, bytes, int, int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    packed: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    crc: int | None = None
    streams: list[tuple[int, int]] = field(default_factory=list)

    def main(self) -> int:
        bound = {o for _, o in self.pairs}
        return next(i for i in range(len(self.sizes)) if i not in bound)


def _crcs(r: Reader, n: int) -> list[int | None]:
    return [struct.unpack("<I", r.take(4))[0] if d else None for d in r.all_or_bits(n)]


def _streams(r: Reader) -> tuple[list[Folder], list[list[tuple[int, int | None]]]]:
    """Folders, and for each its substreams' (size, crc)."""
    folders: list[Folder] = []
    place, sizes, subs = 0, [], None
    while (kind := r.number()) != 0:
        if kind == 6:
            place, n = r.number(), r.number()
            while (k := r.number()) != 0:
                if k == 9:
                    sizes = [r.number() for _ in range(n)]
                elif k == 10:
                    _crcs(r, n)
        elif kind == 7:
            if r.number() != 11:
                raise Corrupt("no folders")
            n = r.number()
            if r.byte():
                raise Corrupt("folders elsewhere")
            for _ in range(n):
                f = Folder()
                ins = outs = 0
                for _ in range(r.number()):
                    flags = r.byte()
                    ident = r.take(flags & 15)
                    a, b = (r.number(), r.number()) if flags & 16 else (1, 1)
                    f.coders.append((ident, r.take(r.number()) if flags & 32 else b"", a, b))
                    ins, outs = ins + a, outs + b
                f.pairs = [(r.number(), r.number()) for _ in range(outs - 1)]
                if ins - len(f.pairs) == 1:
                    f.packed = [next(i for i in range(ins) if i not in {p for p, _ in f.pairs})]
                else:
                    f.packed = [r.number() for _ in range(ins - len(f.pairs))]
                f.sizes = [0] * outs
                folders.append(f)
            while (k := r.number()) != 0:
                if k == 12:
                    for f in folders:
                        f.sizes = [r.number() for _ in f.sizes]
                elif k == 10:
                    for f, c in zip(folders, _crcs(r, len(folders)), strict=True):
                        f.crc = c
        elif kind == 8:
            counts = [1] * len(folders)
            k = r.number()
            if k == 13:
                counts = [r.number() for _ in folders]
                k = r.number()
            lengths = []
            for f, c in zip(folders, counts, strict=True):
                own = [r.number() if k == 9 else 0 for _ in range(c - 1)]
                lengths.append([*own, f.sizes[f.main()] - sum(own)] if c else [])
            if k == 9:
                k = r.number()
            sums: list[list[int | None]] = [[f.crc] if c == 1 and f.crc is not None else [None] * c for f, c in zip(folders, counts, strict=True)]
            while k != 0:
                if k == 10:
                    free = [(i, j) for i, (f, c) in enumerate(zip(folders, counts, strict=True)) if not (c == 1 and f.crc is not None) for j in range(c)]
                    for (i, j), c in zip(free, _crcs(r, len(free)), strict=True):
                        sums[i][j] = c
                k = r.number()
            subs = [list(zip(a, b, strict=True)) for a, b in zip(lengths, sums, strict=True)]
    at = 32 + place
    it = iter(sizes)
    for f in folders:
        for _ in f.packed:
            n = next(it)
            f.streams.append((at, n))
            at += n
    return folders, subs if subs is not None else [[(f.sizes[f.main()], f.crc)] for f in folders]


def _key(password: str, salt: bytes, power: int) -> bytes:
    plain = password.encode("utf-16-le")
    if power == 0x3F:
        return (salt + plain + bytes(32))[:32]
    h = hashlib.sha256()
    for i in range(1 << power):
        h.update(salt + plain + i.to_bytes(8, "little"))
    return h.digest()


def _summed(data: bytes, distance: int) -> bytes:
    """Each byte is the difference to the one so many before."""
    out = np.frombuffer(data, np.uint8).copy()
    for k in range(distance):
        out[k::distance] = np.cumsum(out[k::distance], dtype=np.uint64).astype(np.uint8)
    return out.tobytes()


def _unpacked(src: Source, base: int, f: Folder, password: bytes | None) -> bytes:
    def output(out: int) -> bytes:
        first_in = first_out = 0
        for ident, props, ins, outs in f.coders:
            if first_out <= out < first_out + outs:
                return run(ident, props, [source(first_in + i) for i in range(ins)], f.sizes[out])
            first_in, first_out = first_in + ins, first_out + outs
        raise Corrupt("no such output")

    def source(index: int) -> bytes:
        for a, b in f.pairs:
            if a == index:
                return output(b)
        at, n = f.streams[f.packed.index(index)]
        return src.need(base + at, n)

    def run(ident: bytes, props: bytes, inputs: list[bytes], size: int) -> bytes:
        data = inputs[0]
        if size > LIMIT.get():
            raise TooLarge("too many bytes come out")
        try:
            if ident == b"\0":
                return data
            if ident == b"\3\1\1":
                d, window = props[0], struct.unpack("<I", props[1:5])[0]
                return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": max(window, 4096)}]).decompress(data, size)
            if ident == b"\x21":
                p = props[0]
                window = 0xFFFFFFFF if p == 40 else (2 | p & 1) << p // 2 + 11
                return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": window}]).decompress(data, size)
            if ident == b"\3" or ident in BRANCHES:
                if ident == b"\3":
                    return _summed(data, props[0] + 1)
                spec = {"id": BRANCHES[ident]}
                whole = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 0}])
                return lzma.decompress(whole, lzma.FORMAT_RAW, filters=[spec, {"id": lzma.FILTER_LZMA2, "preset": 0}])
            if ident == b"\3\3\1\x1b":
                return bcj2(*inputs, size)
            if ident == b"\3\4\1":
                return seven_zip(data, props[0], struct.unpack_from("<I", props, 1)[0], size)
            if ident == b"\4\1\x08":
                return inflate(data)
            if ident == b"\4\1\x09":
                return inflate64(data)
            if ident == b"\4\2\2":
                return expand(bz2.BZ2Decompressor(), data)
            if ident == b"\6\xf1\7\1":
                if password is None:
                    raise WrongPassword("a password is needed")
                a, b = props[0], props[1] if len(props) > 1 else 0
                n, m = (a >> 7 & 1) + (b >> 4), (a >> 6 & 1) + (b & 15)
                return aes_cbc(data, _key(password.decode(), props[2 : 2 + n], a & 63), props[2 + n : 2 + n + m].ljust(16, b"\0"))[:size]
        except (lzma.LZMAError, OSError, struct.error, IndexError) as e:
            raise Damaged(str(e)) from e
        raise Unsupported(NAMES.get(ident, ident.hex()))

    return output(f.main())[: f.sizes[f.main()]]


def parse(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    place, size, crc = src.get("<QQI", base + 12)
    if not size:
        return
    data = src.need(base + 32 + place, size)
    if zlib.crc32(data) != crc:
        raise Corrupt("header checksum differs")
    r = Reader(data)
    kind = r.number()
    while kind == 0x17:
        folders, _ = _streams(r)
        r = Reader(_unpacked(src, base, folders[0], None))
        kind = r.number()
    if kind != 1:
        raise Corrupt("no header")
    folders, subs, files, n = [], [], {}, 0
    while (kind := r.number()) != 0:
        if kind == 2:
            while r.number() != 0:
                r.take(r.number())
        elif kind == 4:
            folders, subs = _streams(r)
        elif kind == 5:
            n = r.number()
            while (k := r.number()) != 0:
                body = Reader(r.take(r.number()))
                if k == 0x0E:
                    files["empty"] = body.bits(n)
                elif k in (0x0F, 0x10):
                    files["file" if k == 0x0F else "anti"] = body.bits(sum(files.get("empty", [])))
                elif k == 0x11:
                    body.byte()
                    files["names"] = body.data[1:].decode("utf-16-le", "replace").split("\0")
                elif k in (0x12, 0x13, 0x14):
                    known = body.all_or_bits(n)
                    body.byte()
                    files[{0x12: "created", 0x13: "accessed", 0x14: "modified"}[k]] = [file_time(struct.unpack("<Q", body.take(8))[0]) if d else None for d in known]
                elif k == 0x15:
                    known = body.all_or_bits(n)
                    body.byte()
                    files["attributes"] = [struct.unpack("<I", body.take(4))[0] if d else None for d in known]
    flat = [(i, j, s, c) for i, own in enumerate(subs) for j, (s, c) in enumerate(own)]
    empties, streams = iter(zip(files.get("file", [False] * n), files.get("anti", [False] * n), strict=False)), iter(flat)
    unpacked: dict[int, bytes] = {}

    def content(i: int, start: int, size: int):
        def decode(password: bytes | None) -> bytes:
            if i not in unpacked:
                unpacked.clear()
                unpacked[i] = _unpacked(src, base, folders[i], password)
            return unpacked[i][start : start + size]

        return decode

    for k in range(n):
        e = Entry(files.get("names", [""] * n)[k] or name.rsplit("/", 1)[-1].removesuffix(".7z"))
        for key in ("created", "accessed", "modified"):
            if key in files:
                setattr(e, key, files[key][k])
        if (a := files.get("attributes", [None] * n)[k]) is not None:
            e.dos = a & 255
            if a & 0x8000:
                e.mode = a >> 16
        if files.get("empty", [False] * n)[k]:
            is_file, anti = next(empties)
            if anti:
                continue
            e.size = e.packed = 0
            e.directory = None if is_file else True
            e.decode = None if not is_file else lambda _: b""
        else:
            i, j, size, crc = next(streams)
            f, start = folders[i], sum(s for s, _ in subs[i][:j])
            whole = sum(s for s, _ in subs[i])
            e.size, e.packed = size, sum(m for _, m in f.streams) * size // whole if whole else 0
            e.method = "+".join(NAMES.get(c[0], c[0].hex()) for c in f.coders)
            e.encrypted = any(c[0] == b"\6\xf1\7\1" for c in f.coders) or None
            e.solid, e.solid_offset = (i, start) if len(subs[i]) > 1 else (None, None)
            e.decode = content(i, start, size)
            if crc is not None:
                e.extras["7zCRC32"] = str(crc)
                e.check = crc32_is(crc)
        yield e

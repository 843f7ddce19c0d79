"""Archives made from rows, to read back: a row for each archive. Groups must be of bounded size."""

from __future__ import annotations

import binascii
import bz2
import gzip
import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import crc16, zip_locked
from ..sources.formats.mac import BASE64, BINHEX


def _zip(rows: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in rows:
            z.writestr(zipfile.ZipInfo(name, (2020, 2, 29, 12, 34, 56)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _tar(rows: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, data in rows:
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(data), 1_582_979_696, 0o640
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _ar(rows: list[tuple[str, bytes]]) -> bytes:
    out = [b"!<arch>\n"]
    for name, data in rows:
        out.append(b"%-16s%-12d%-6d%-6d%-8o%-10d\x60\n" % (name.encode() + b"/", 0, 0, 0, 0o100644, len(data)) + data + b"\n" * (len(data) % 2))
    return b"".join(out)


def _cpio(rows: list[tuple[str, bytes]]) -> bytes:
    out = bytearray()
    for i, (name, data) in enumerate([*rows, ("TRAILER!!!", b"")]):
        raw = name.encode() + b"\0"
        fields = (i, 0o100644, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(raw), 0)
        out += b"070701" + b"".join(b"%08x" % f for f in fields) + raw
        out += b"\0" * (-len(out) % 4) + data
        out += b"\0" * (-len(out) % 4)
    return bytes(out)


def _warc(rows: list[tuple[str, bytes]]) -> bytes:
    out = []
    for i, (url, data) in enumerate(rows):
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + data
        out.append(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    return b"".join(out)


def _zip_methods(rows: list[tuple[str, bytes]]) -> bytes:
    """Stored, deflated, bzip2 and LZMA entries by turns."""
    out = io.BytesIO()
    kinds = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, data) in enumerate(rows):
            z.writestr(zipfile.ZipInfo(name, (2020, 2, 29, 12, 34, 56)), data, kinds[i % 4])
    return out.getvalue()


#: The password of packed archives that have one.
PASSWORD = b"open sesame"


def _zip_locked(rows: list[tuple[str, bytes]]) -> bytes:
    """Deflated entries under the stream cipher of Zip."""
    out, central = bytearray(), bytearray()
    for name, data in rows:
        crc, d = zlib.crc32(data), zlib.compressobj(9, zlib.DEFLATED, -15)
        body = zip_locked(bytes(11) + bytes([crc >> 24]) + d.compress(data) + d.flush(), PASSWORD)
        raw, at = name.encode(), len(out)
        shared = struct.pack("<HHHIIIIHH", 20, 1, 8, 0x505D6458, crc, len(body), len(data), len(raw), 0)
        out += b"PK\3\4" + shared + raw + body
        central += b"PK\1\2" + struct.pack("<H", 20) + shared + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw
    return bytes(out + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(rows), len(rows), len(central), len(out), 0))


def _number7(n: int) -> bytes:
    """A number as 7-Zip writes it."""
    for k in range(9):
        if n < 1 << 7 * (k + 1) or k == 8:
            return bytes([(0xFF << 8 - k & 0xFF) | (n >> 8 * k if k < 8 else 0)]) + (n & (1 << 8 * k) - 1).to_bytes(k, "little")
    raise AssertionError


def _sevenzip(rows: list[tuple[str, bytes]]) -> bytes:
    """One solid folder of LZMA2."""
    whole = b"".join(data for _, data in rows)
    packed = lzma.compress(whole, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
    n, full = _number7, [(name, data) for name, data in rows if data]
    folder = b"\1\x21\x21\1" + bytes([18])
    streams = b"\6" + n(0) + n(1) + b"\x09" + n(len(packed)) + b"\0" + b"\7\x0b" + n(1) + b"\0" + folder + b"\x0c" + n(len(whole)) + b"\0"
    streams += b"\x08\x0d" + n(len(full)) + (b"\x09" + b"".join(n(len(d)) for _, d in full[:-1]) if len(full) > 1 else b"") + b"\x0a\1" + b"".join(struct.pack("<I", zlib.crc32(d)) for _, d in full) + b"\0\0"
    names = b"\0" + b"".join(name.encode("utf-16-le") + b"\0\0" for name, _ in rows)
    files = b"\5" + n(len(rows)) + b"\x11" + n(len(names)) + names
    if len(full) < len(rows):
        bits = [not data for _, data in rows]
        field = lambda kind, flags: (body := bytes(sum(f << 7 - i for i, f in enumerate(flags[k : k + 8])) for k in range(0, len(flags), 8)), bytes([kind]) + n(len(body)) + body)[1]
        files += field(0x0E, bits) + field(0x0F, [True] * sum(bits))
    header = b"\1" + (b"\4" + streams if full else b"") + files + b"\0\0"
    start = struct.pack("<QQI", len(packed) if full else 0, len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + (packed if full else b"") + header


def _iso(rows: list[tuple[str, bytes]]) -> bytes:
    """A primary volume with one folder, names by Rock Ridge."""
    both = lambda n, k: n.to_bytes(k, "little") + n.to_bytes(k, "big")
    blocks = lambda n: (n + 2047) // 2048

    def record(raw: bytes, place: int, size: int, flags: int, extra: bytes = b"") -> bytes:
        body = b"\0" + both(place, 4) + both(size, 4) + bytes([120, 2, 29, 12, 34, 56, 0, flags, 0, 0]) + both(1, 2) + bytes([len(raw)]) + raw + b"\0" * (1 - len(raw) % 2) + extra
        body += b"\0" * (1 - len(body) % 2)
        return bytes([len(body) + 1]) + body

    names = [(b"F%07d.;1" % i, b"NM" + bytes([5 + len(n.encode()), 1, 0]) + n.encode()) for i, (n, _) in enumerate(rows)]
    dots = record(b"\0", 0, 0, 2) + record(b"\1", 0, 0, 2)
    at = len(dots)
    for raw, nm in names:
        n = len(record(raw, 0, 0, 0, nm))
        at += (-at % 2048 if at % 2048 + n > 2048 else 0) + n
    size = blocks(at) * 2048
    place, data = 18 + size // 2048, bytearray()
    dots = record(b"\0", 18, size, 2) + record(b"\1", 18, size, 2)
    folder = bytearray(dots)
    for (raw, nm), (_, content) in zip(names, rows, strict=True):
        r = record(raw, place + len(data) // 2048, len(content), 0, nm)
        if len(folder) % 2048 + len(r) > 2048:
            folder += b"\0" * (-len(folder) % 2048)
        folder += r
        data += content + b"\0" * (-len(content) % 2048)
    folder += b"\0" * (size - len(folder))
    volume = b"\1CD001\1\0" + b" " * 64 + bytes(8) + both(place + len(data) // 2048, 4) + bytes(32) + both(1, 2) * 2 + both(2048, 2)
    volume = volume.ljust(156, b"\0") + record(b"\0", 18, size, 2)
    return bytes(16 * 2048) + volume.ljust(2048, b"\0") + b"\xffCD001\1".ljust(2048, b"\0") + bytes(folder) + bytes(data)


def _rar5(rows: list[tuple[str, bytes]]) -> bytes:
    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def block(body: bytes) -> bytes:
        body = number(len(body)) + body
        return struct.pack("<I", zlib.crc32(body)) + body

    out = b"Rar!\x1a\7\1\0" + block(b"\1\0\0")
    for name, data in rows:
        raw = name.encode()
        out += block(b"\2\2" + number(len(data)) + b"\4" + number(len(data)) + number(0o100644) + struct.pack("<I", zlib.crc32(data)) + b"\0\1" + number(len(raw)) + raw) + data
    return out + block(b"\5\0\0")


def _lha(rows: list[tuple[str, bytes]]) -> bytes:
    out = bytearray()
    for name, data in rows:
        raw = name.encode()
        head = b"-lh0-" + struct.pack("<IIIBBB", len(data), len(data), 0x505D6458, 32, 0, len(raw)) + raw + struct.pack("<H", crc16(data))
        out += bytes([len(head), sum(head) & 255]) + head + data
    return bytes(out + b"\0")


def _arj(rows: list[tuple[str, bytes]]) -> bytes:
    def header(name: str, kind: int, data: bytes) -> bytes:
        fixed = bytes([30, 3, 1, 0, 0, 0, kind, 0]) + struct.pack("<IIIIHHH", 0x505D6458, len(data), len(data), zlib.crc32(data), 0, 32, 0)
        body = fixed + name.encode() + b"\0\0"
        return b"\x60\xea" + struct.pack("<H", len(body)) + body + struct.pack("<IH", zlib.crc32(body), 0)

    return header("all.arj", 2, b"") + b"".join(header(n, 0, d) + d for n, d in rows) + b"\x60\xea\0\0"


def _zoo(rows: list[tuple[str, bytes]]) -> bytes:
    out = bytearray(b"ZOO 2.10 Archive.\x1a\0\0" + struct.pack("<IIi", 0xFDC4A7DC, 34, -34) + b"\2\0")
    for name, data in rows:
        raw, at = name.encode() + b"\0", len(out)
        body = at + 58 + len(raw)
        out += struct.pack("<IBBIIHHHIIBBB", 0xFDC4A7DC, 2, 0, body + len(data), body, 0x505D, 0x6458, crc16(data), len(data), len(data), 2, 0, 0) + bytes(7) + raw[:12].ljust(13, b"\0") + bytes([len(raw) + 2, 0, 127, 0, 0]) + bytes([len(raw), 0]) + raw + data
    return bytes(out + struct.pack("<IBBIIHHHIIBBB", 0xFDC4A7DC, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0) + bytes(40))


def _arc(rows: list[tuple[str, bytes]]) -> bytes:
    return b"".join(b"\x1a\2" + n.encode()[:12].ljust(13, b"\0") + struct.pack("<IHHHI", len(d), 0x505D, 0x6458, crc16(d), len(d)) + d for n, d in rows) + b"\x1a\0"


def _cab(rows: list[tuple[str, bytes]]) -> bytes:
    """One folder of MSZIP."""
    whole, blocks, before = b"".join(d for _, d in rows), bytearray(), b""
    count = 0
    for k in range(0, len(whole), 32768):
        part = whole[k : k + 32768]
        z = zlib.compressobj(6, zlib.DEFLATED, -15, zdict=before) if before else zlib.compressobj(6, zlib.DEFLATED, -15)
        body = b"CK" + z.compress(part) + z.flush()
        blocks += struct.pack("<IHH", 0, len(body), len(part)) + body
        before, count = part, count + 1
    files, at = bytearray(), 0
    for name, data in rows:
        files += struct.pack("<IIHHHH", len(data), at, 0, 0x505D, 0x6458, 0x20) + name.encode() + b"\0"
        at += len(data)
    first = 36 + 8 + len(files)
    head = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, first + len(blocks), 0, 44, 0, 3, 1, 1, len(rows), 0, 0, 0)
    return head + struct.pack("<IHH", first, count, 1) + bytes(files) + bytes(blocks)


def _sar(rows: list[tuple[str, bytes]]) -> bytes:
    index, at = bytearray(), 0
    for name, data in rows:
        index += name.encode() + b"\0" + struct.pack(">II", at, len(data))
        at += len(data)
    return struct.pack(">HI", len(rows), 6 + len(index)) + bytes(index) + b"".join(d for _, d in rows)


def _lbr(rows: list[tuple[str, bytes]]) -> bytes:
    """Names of eight and three letters, in sectors."""
    sectors = (len(rows) + 1 + 3) // 4
    index, body, at = bytearray(b"\0" + b" " * 11 + struct.pack("<HH", 0, sectors) + bytes(16)), bytearray(), sectors
    for name, data in rows:
        stem, _, end = name.partition(".")
        pad, used = -len(data) % 128, (len(data) + 127) // 128
        index += b"\0" + stem.encode().ljust(8) + end.encode().ljust(3) + struct.pack("<HH", at, used) + bytes(10) + bytes([pad]) + bytes(5)
        body += data + bytes(pad)
        at += used
    return bytes(index.ljust(sectors * 128, b"\xff")) + bytes(body)


def _xar(rows: list[tuple[str, bytes]]) -> bytes:
    toc, heap = [], bytearray()
    for i, (name, data) in enumerate(rows):
        z = zlib.compress(data)
        toc.append(f'<file id="{i + 1}"><name>{name}</name><type>file</type><data><offset>{len(heap)}</offset><length>{len(z)}</length><size>{len(data)}</size><encoding style="application/x-gzip"/><extracted-checksum style="sha1">{hashlib.sha1(data).hexdigest()}</extracted-checksum></data></file>')
        heap += z
    plain = f"<?xml version=\"1.0\"?><xar><toc>{''.join(toc)}</toc></xar>".encode()
    packed = zlib.compress(plain)
    return b"xar!" + struct.pack(">HHQQI", 28, 1, len(packed), len(plain), 0) + packed + bytes(heap)


def _z(data: bytes) -> bytes:
    """LZW of compress, at most twelve bits, without clearing."""
    out, codes, table, width, size = bytearray(b"\x1f\x9d\x8c"), [], {}, 9, 257
    if not data:
        return bytes(out)
    rest = iter(data)
    word = next(rest)
    for byte in rest:
        longer = word << 8 | byte
        if longer in table:
            word = table[longer]
            continue
        codes.append(word)
        word = byte
        table[longer] = size
        size += 1
        if size > 1 << width and width < 12:
            out += _bits(codes, width).ljust(-(-len(codes) // 8) * width, b"\0")
            codes, width = [], width + 1
        if size == 1 << 12:
            break
    found = table.get
    for byte in rest:
        longer = found(word << 8 | byte)
        if longer is None:
            codes.append(word)
            word = byte
        else:
            word = longer
    return bytes(out) + _bits([*codes, word], width)


def _bits(codes: list[int], width: int) -> bytes:
    """Numbers of width bits, the least significant bit first."""
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def _macbinary(name: bytes, data: bytes, resource: bytes) -> bytes:
    h = bytearray(128)
    h[1], h[2 : 2 + len(name)], h[65:73] = len(name), name, b"TEXTlade"
    h[83:91] = struct.pack(">II", len(data), len(resource))
    h[124:126] = struct.pack(">H", binascii.crc_hqx(bytes(h[:124]), 0))
    return bytes(h) + data + bytes(-len(data) % 128) + resource + bytes(-len(resource) % 128)


def _applesingle(name: bytes, data: bytes, resource: bytes) -> bytes:
    parts, at, index = ((3, name), (9, b"TEXTlade" + bytes(24)), (1, data), (2, resource)), 26 + 48, b""
    for kind, body in parts:
        index += struct.pack(">III", kind, at, len(body))
        at += len(body)
    return b"\0\5\x16\0\0\2\0\0" + bytes(16) + struct.pack(">H", 4) + index + b"".join(b for _, b in parts)


def _binhex(name: bytes, data: bytes, resource: bytes) -> bytes:
    """Runs aren't shortened, but for the mark of runs itself."""
    head = bytes([len(name)]) + name + b"\0TEXTlade\0\0" + struct.pack(">II", len(data), len(resource))
    whole = b"".join(p + struct.pack(">H", binascii.crc_hqx(p + b"\0\0", 0) if p is head else binascii.crc_hqx(p, 0)) for p in (head, data, resource))
    plain = whole.replace(b"\x90", b"\x90\0")
    text = binascii.b2a_base64(plain + bytes(-len(plain) % 3), newline=False)[: (8 * len(plain) + 5) // 6]
    return b"(This file must be converted with BinHex 4.0)\r\r:" + text.translate(bytes.maketrans(BASE64, BINHEX)) + b":\r"


def _film(rows: list[tuple[str, bytes]]) -> bytes:
    """A compressed film that shows a picture in GIF, with each row's bytes behind the mark, in each frame."""
    body = bytearray(b"\x10\0\0\x0c" + struct.pack("<H", len(rows)))
    for i, (_, data) in enumerate(rows):
        body += struct.pack("<HIH", 21 << 6 | 63, len(data) + 8, i) + b"GIF89a" + data + struct.pack("<H", 1 << 6)
    return b"CWS\6" + struct.pack("<I", len(body) + 10) + zlib.compress(bytes(body) + b"\0\0", 1)


def _amiga_lzx(rows: list[tuple[str, bytes]]) -> bytes:
    """Stored groups of up to three files; a group's bytes follow its last file."""
    out = bytearray(b"LZX" + bytes(7))
    for k in range(0, len(rows), 3):
        part = rows[k : k + 3]
        body = b"".join(data for _, data in part)
        for name, data in part:
            last = name == part[-1][0]
            out += struct.pack("<HIIBBHBBHIIIB", 0, len(data), len(body) if last else 0, 10, 0, 0, 0, 10, 0, 1 << 27 | 30 << 17, zlib.crc32(data), 0, len(name)) + name.encode()
        out += body
    return bytes(out)


#: The lowest levels: packing only makes what the engine is to read, and a benchmark should time the reading.
ONE = {"gz": lambda d: gzip.compress(d, 1), "bz2": lambda d: bz2.compress(d, 1), "xz": lambda d: lzma.compress(d, preset=0), "lzma": lambda d: lzma.compress(d, lzma.FORMAT_ALONE, preset=0), "Z": _z}
MANY = {"zip": _zip, "tar": _tar, "a": _ar, "cpio": _cpio, "warc": _warc, "tar.gz": lambda rows: gzip.compress(_tar(rows), mtime=1), "methods.zip": _zip_methods, "locked.zip": _zip_locked, "swf": _film, "lzx": _amiga_lzx}
#: Formats that archives of a mixed corpus have by turns.
MIXED = {"7z": _sevenzip, "iso": _iso, "rar": _rar5, "lzh": _lha, "arj": _arj, "zoo": _zoo, "arc": _arc, "cab": _cab, "sar": _sar, "lbr": _lbr, "xar": _xar}
FORKED = {"macbinary.bin": _macbinary, "applesingle.as": _applesingle, "binhex.hqx": _binhex}


def mixed(rows: DataFrame) -> DataFrame:
    """packed(), in a format that follows from the archive's number, the digits of its name; a sar is named as such."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        kind = list(MIXED)[int(key[0].rsplit("-", 1)[1]) % len(MIXED)]
        name = f"{key[0]}/arc.sar" if kind == "sar" else f"{key[0]}.{kind}"
        return pd.DataFrame({"path": [name], "content": [MIXED[kind](list(zip(part["name"], map(bytes, part["data"]), strict=True)))]})

    return spread(rows, "archive").groupBy("archive").applyInPandas(pack, "path string, content binary")


#: Bytes of a table, as it is stored, that one task packs.
PART = 1 << 23


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys to as many tasks as shuffles have, since a small table of one row group would else be
    packed and read by one, and to one for each PART of the table at least, since a task's archives may come to Python
    in one batch."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // PART, 100_000), 1), *keys)


def forked(rows: DataFrame) -> DataFrame:
    """path and content of a file of two forks for each row of rows (name, data, resource, kind: one of FORKED)."""

    def run(batches):
        for part in batches:
            files = [FORKED[k](n.encode(), bytes(d), bytes(r)) for n, d, r, k in zip(part["name"], part["data"], part["resource"], part["kind"], strict=True)]
            yield pd.DataFrame({"path": part["name"] + "." + part["kind"], "content": files})

    return spread(rows.select("name", "data", "resource", "kind"), "name").mapInPandas(run, "path string, content binary")


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """path and content of an archive for each value of archive in rows (archive, at, name, data), in the order of at."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        return pd.DataFrame({"path": [f"{key[0]}.{kind}"], "content": [MANY[kind](list(zip(part["name"], map(bytes, part["data"]), strict=True)))]})

    return spread(rows, "archive").groupBy("archive").applyInPandas(pack, "path string, content binary")


def squeezed(rows: DataFrame, kind: str) -> DataFrame:
    """path and content of a compressed stream for each row of rows (name, data)."""

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"path": part["name"] + f".{kind}", "content": [ONE[kind](bytes(d)) for d in part["data"]]})

    return spread(rows.select("name", "data"), "name").mapInPandas(run, "path string, content binary")


def from_text(table: DataFrame, key: str, text: str, archive: str, many: int = 50) -> DataFrame:
    """Rows to pack: `many` consecutive keys an archive, a file a row."""
    return table.select(F.concat(F.lit(f"{archive}-"), F.floor(F.col(key) / many).cast("string")).alias("archive"), F.col(key).alias("at"), F.concat(F.lit("doc"), F.col(key).cast("string"), F.lit(".txt")).alias("name"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("data"))

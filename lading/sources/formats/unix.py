"""Ar, Cpio, RPM, XAR, ISO 9660, SAR and NSA, LBR, WARC and split files."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.etree import ElementTree

from ...functions.kernels import Bits, Damaged, Unsupported, byte_sum, expand
from ..source import Source
from .entry import Corrupt, Entry, unix_time


def _plain(src: Source, offset: int, size: int):
    return lambda _: src.need(offset, size)


def ar(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    at, table = 8, b""
    while at + 60 <= src.size:
        h = src.need(at, 60)
        if h[58:] != b"\x60\n":
            raise Corrupt("no header end")
        raw, size, body = h[:16].rstrip(b" "), int(h[48:58]), at + 60
        after = body + size + size % 2
        if raw == b"//":
            table = src.need(body, size)
        elif raw not in (b"/", b"/SYM64/"):
            if m := re.fullmatch(rb"#1/([0-9]+)", raw):
                n = int(m[1])
                raw, body, size = src.need(body, n).rstrip(b"\0"), body + n, size - n
            elif m := re.fullmatch(rb"/([0-9]+)", raw):
                raw = re.split(rb"/?\n", table[int(m[1]) :], maxsplit=1)[0]
            else:
                raw = raw.removesuffix(b"/")
            yield Entry(raw, size, size, "None", modified=unix_time(int(h[16:28].strip() or 0)), uid=int(h[28:34].strip() or 0), gid=int(h[34:40].strip() or 0), mode=int(h[40:48].strip() or b"0", 8), offset=body, decode=_plain(src, body, size))
        at = after


def cpio(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    at = base
    while at + 26 <= src.size:
        magic = src.need(at, 6)
        check = None
        if magic == b"070707":
            h = src.need(at, 76)
            cut = lambda a, n, h=h: int(h[a : a + n], 8)
            mode, uid, gid, mtime, n, size = cut(18, 6), cut(24, 6), cut(30, 6), cut(48, 11), cut(59, 6), cut(65, 11)
            head, pad = 76, 1
        elif magic in (b"070701", b"070702"):
            h = src.need(at, 110)
            f = [int(h[6 + 8 * i : 14 + 8 * i], 16) for i in range(13)]
            mode, uid, gid, mtime, size, n = f[1], f[2], f[3], f[5], f[6], f[11]
            head, pad = 110, 4
            if magic == b"070702" and mode & 0xF000 == 0x8000:
                check = lambda data, want=f[12]: byte_sum(data, 0xFFFFFFFF) == want
        elif magic[:2] in (b"\x71\xc7", b"\xc7\x71"):
            order = "big" if magic[:2] == b"\x71\xc7" else "little"
            w = [int.from_bytes(src.need(at + 2 * i, 2), order) for i in range(13)]
            mode, uid, gid, mtime, n, size = w[3], w[4], w[5], w[8] << 16 | w[9], w[10], w[11] << 16 | w[12]
            head, pad = 26, 2
        else:
            raise Corrupt("no header")
        raw = src.need(at + head, n)[:-1]
        body = at + head + n
        body += -body % pad if pad > 2 else (n + head) % pad and 1
        if raw == b"TRAILER!!!":
            return
        e = Entry(raw, size, size, "None", mode=mode, uid=uid, gid=gid, modified=unix_time(mtime), directory=mode & 0xF000 == 0x4000 or None, offset=body, check=check)
        if mode & 0xF000 == 0xA000:
            e.link = src.need(body, size).decode("utf-8", "replace")
        elif not e.directory:
            e.decode = _plain(src, body, size)
        yield e
        at = body + size
        at += -at % pad if pad > 2 else (size % 2 if pad == 2 else 0)


def rpm(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Lead, signature header and header; what follows is an archive in an archive."""
    at, tags = 96, {}
    for last in (False, True):
        if src.at(at, 3) != b"\x8e\xad\xe8":
            raise Corrupt("no header")
        n, size = src.get(">II", at + 8)
        store = at + 16 + 16 * n
        for i in range(n):
            tag, kind, place, _ = src.get(">IIII", at + 16 + 16 * i)
            if kind in (6, 9) and last:
                stop = src.find(b"\0", store + place)
                tags[tag] = src.at(store + place, stop - store - place).decode("utf-8", "replace")
        at = store + size
        if not last:
            at += -at % 8
    kind, method = tags.get(1124, "cpio"), tags.get(1125, "gzip")
    stem = re.sub(r"\.rpm$", "", name.rsplit("/", 1)[-1])
    end = {"gzip": ".gz", "bzip2": ".bz2", "xz": ".xz", "lzma": ".lzma"}.get(method, "")
    yield Entry(f"{stem}.{kind}{end}", src.size - at, src.size - at, "None", archive=True, offset=at, decode=_plain(src, at, src.size - at))


def xar(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    head, _, packed, _ = src.get(">HHQQ", 4)
    try:
        root = ElementTree.fromstring(expand(zlib.decompressobj(), src.need(head, packed)))
    except (zlib.error, ElementTree.ParseError) as e:
        raise Corrupt(str(e)) from e
    heap = head + packed

    def stamp(text: str | None) -> datetime | None:
        try:
            return datetime.fromisoformat(text.rstrip("Z")).replace(tzinfo=UTC) if text else None
        except ValueError:
            return None

    def walk(node, above: str) -> Iterator[Entry]:
        for f in node.findall("file"):
            title = f.findtext("name") or ""
            encoded = f.find("name")
            if encoded is not None and encoded.get("enctype") == "base64":
                title = base64.b64decode(title).decode("utf-8", "replace")
            path = f"{above}/{title}" if above else title
            number = lambda k, b=10, f=f: int(f.findtext(k), b) if f.findtext(k) else None
            kind = f.findtext("type")
            e = Entry(path, mode=number("mode", 8), uid=number("uid"), gid=number("gid"), user=f.findtext("user"), group=f.findtext("group"), modified=stamp(f.findtext("mtime")), created=stamp(f.findtext("ctime")), accessed=stamp(f.findtext("atime")), directory=kind == "directory" or None)
            if kind == "symlink":
                e.link = f.findtext("link") or ""
            if (data := f.find("data")) is not None:
                offset, length, size = heap + int(data.findtext("offset")), int(data.findtext("length")), int(data.findtext("size"))
                style = (data.find("encoding").get("style") if data.find("encoding") is not None else "application/octet-stream") or ""
                e.size, e.packed, e.offset = size, length, offset
                e.method = {"application/octet-stream": "None", "application/x-gzip": "Deflate", "application/x-bzip2": "Bzip2", "application/x-lzma": "LZMA", "application/x-xz": "LZMA2"}.get(style, style)
                e.extras["XAREncodingStyle"] = style
                total = data.find("extracted-checksum")
                if total is not None:
                    e.extras |= {"XARChecksum": total.text or "", "XARChecksumStyle": total.get("style") or ""}
                    e.check = lambda d, t=total: hashlib.new((t.get("style") or "sha1").lower(), d).hexdigest() == (t.text or "").lower()

                def decode(_, offset=offset, length=length, style=style) -> bytes:
                    raw = src.need(offset, length)
                    try:
                        return raw if style == "application/octet-stream" else expand({"application/x-gzip": zlib.decompressobj, "application/x-bzip2": bz2.BZ2Decompressor, "application/x-lzma": lzma.LZMADecompressor, "application/x-xz": lzma.LZMADecompressor}[style](), raw)
                    except KeyError as x:
                        raise Unsupported(style) from x
                    except (zlib.error, OSError, lzma.LZMAError) as x:
                        raise Damaged(str(x)) from x

                e.decode = decode
            yield e
            yield from walk(f, path)

    yield from walk(root.find("toc") if root.find("toc") is not None else root, "")


def sar(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    at = 0
    (count,) = src.get(">H", at)
    at += 2
    if not count:
        (count,) = src.get(">H", at)
        at += 2
    (start,) = src.get(">I", at)
    at += 4
    for _ in range(count):
        stop = src.find(b"\0", at)
        raw = src.at(at, stop - at)
        offset, size = src.get(">II", stop + 1)
        at = stop + 9
        yield Entry(raw, size, size, "None", offset=start + offset, separators="\\", decode=_plain(src, start + offset, size))


def nsa(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    (count,), (start,) = src.get(">H", 0), src.get(">I", 2)
    at = 6
    for _ in range(count):
        stop = src.find(b"\0", at)
        raw = src.at(at, stop - at)
        kind, offset, packed, size = src.get(">BIII", stop + 1)
        at = stop + 14

        def decode(_, kind=kind, place=start + offset, packed=packed, size=size) -> bytes:
            data = src.need(place, packed)
            if kind == 0:
                return data
            if kind == 2:
                bits = Bits(data)

                def one():
                    return bits.read(8) if bits.read(1) else (bits.read(8), bits.read(4) + 2)

                ring, out = bytearray(256), bytearray()
                put = 239
                while len(out) < size:
                    got = one()
                    for b in [got] if isinstance(got, int) else [None] * got[1]:
                        if b is None:
                            b = ring[got[0]]
                            got = ((got[0] + 1) % 256, got[1])
                        out.append(b)
                        ring[put] = b
                        put = (put + 1) % 256
                return bytes(out[:size])
            if kind == 4:
                return expand(bz2.BZ2Decompressor(), data[4:])
            raise Unsupported(f"method {kind}")

        yield Entry(raw, size, packed, {0: "None", 1: "SPB", 2: "LZSS", 4: "Bzip2"}.get(kind, f"Method {kind}"), offset=start + offset, separators="\\", decode=decode)


def lbr(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """A directory of 32 bytes an entry that is itself the first one, in sectors of 128 bytes."""
    count = src.get("<H", 14)[0] * 4
    for i in range(1, count):
        h = src.need(32 * i, 32)
        if h[0] == 0:
            stem, end = h[1:9].rstrip(b" "), h[9:12].rstrip(b" ")
            place, size, pad = int.from_bytes(h[12:14], "little") * 128, int.from_bytes(h[14:16], "little") * 128, h[26]
            size -= pad if pad < 128 else 0
            yield Entry(stem + (b"." + end if end else b""), size, size, "None", offset=place, archive=end[1:2] in (b"Q", b"Z") or None, decode=_plain(src, place, size))


def split(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """The volumes together are the file."""
    inner = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    yield Entry(inner, src.size, src.size, "None", archive=inner.lower().endswith(".zip") or None, decode=_plain(src, 0, src.size))


def warc(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Responses with status 200 are files at host and path; requests are joined to them by record id, the last of an id.

    A file whose place is a directory becomes its index.html, names that are taken get .1, .2 and so on. The size runs
    to the record's end."""
    records, at = [], 0
    while at < src.size:
        if src.at(at, 8) not in (b"WARC/1.0", b"WARC/1.1"):
            at = src.find(b"WARC/1.", at + 1)
            if at < 0:
                break
            if records:
                records[-1]["end"] = min(records[-1]["end"], at)
            continue
        stop = src.find(b"\r\n\r\n", at)
        if stop < 0:
            break
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in src.at(at, stop - at).decode("utf-8", "replace").split("\r\n")[1:])}
        body, length = stop + 4, fields.get("content-length", "0") or "0"
        if not length.isdigit():  # the record is lost, the next one is found by its mark
            at = body
            continue
        records.append({"fields": fields, "body": body, "end": min(src.size, body + int(length))})
        at = records[-1]["end"]
        while src.at(at, 2) == b"\r\n":
            at += 2
    asked = {r["fields"].get("warc-record-id"): r for r in records if r["fields"].get("warc-type") == "request"}
    files = []
    for r in records:
        if r["fields"].get("warc-type") != "response":
            continue
        stop = src.find(b"\r\n\r\n", r["body"], r["end"])
        head = src.at(r["body"], (stop if stop >= 0 else r["end"]) - r["body"]).decode("latin-1")
        if not re.match(r"HTTP/\d+.\d+ 200", head):
            continue
        uri = r["fields"].get("warc-target-uri", "").strip("<>")
        m = re.fullmatch(r"https?://([^/]+)(/.*|)", uri, re.S)
        if m:
            files.append(([m[1], *[p for p in m[2].split("/") if p]], stop + 4, r, head, uri))
    folders = {tuple(p[:k]) for p, *_ in files for k in range(1, len(p))}
    seen: dict[tuple, int] = {}
    made: set[tuple] = set()
    for path, start, r, head, uri in files:
        for k in range(1, len(path)):
            if (d := tuple(path[:k])) not in made:
                made.add(d)
                yield Entry("/".join(d), directory=True)
        path = [*path, "index.html"] if tuple(path) in folders or len(path) == 1 else path
        n = seen[tuple(path)] = seen.get(tuple(path), -1) + 1
        full = "/".join(path) + (f".{n}" if n else "")
        size = r["end"] - start
        e = Entry(full, size, size, "None", offset=start, decode=_plain(src, start, size), extras={"WARCTargetURI": uri, "WARCResponseHeaders": head})
        if date := r["fields"].get("warc-date"):
            try:
                e.modified = datetime.fromisoformat(date.replace("Z", "+00:00"))
            except ValueError:
                e.extras["WARCDate"] = date
        if (q := asked.get(r["fields"].get("warc-concurrent-to"))) is not None:
            e.extras["WARCRequestHeaders"] = src.at(q["body"], q["end"] - q["body"]).decode("latin-1").split("\r\n\r\n")[0]
        yield e


def iso(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Plain and raw sectors; Joliet names if there are any, Rock Ridge names and modes in the primary tree."""
    raw, lead = next(((r, s) for r, s in ((2048, 0), (2352, 16), (2352, 24), (2336, 8)) if src.at(16 * r + s + 1, 5) == b"CD001"), (2048, 0))

    def block(n: int, size: int) -> bytes:
        if raw == 2048:
            return src.need(n * 2048, size)
        return b"".join(src.at((n + i) * raw + lead, 2048) for i in range((size + 2047) // 2048))[:size]

    k, chosen, joliet = 16, None, False
    while k < 64:
        d = block(k, 2048)
        if d[1:6] != b"CD001" or d[0] == 255:
            break
        if d[0] == 1 and chosen is None:
            chosen = d
        if d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E"):
            chosen, joliet = d, True
        k += 1
    if chosen is None:
        raise Corrupt("no volume descriptor")

    def stamp(b: bytes) -> datetime | None:
        try:
            return datetime(1900 + b[0], b[1], b[2], b[3], b[4], b[5], tzinfo=UTC)
        except ValueError:
            return None

    seen: set[int] = set()

    def walk(place: int, size: int, above: str, depth: int) -> Iterator[Entry]:
        if place in seen:
            return
        seen.add(place)
        data, at = block(place, size), 0
        while at < len(data):
            n = data[at]
            if not n:
                at += 2048 - at % 2048
                continue
            r = data[at : at + n]
            at += n
            where, length, flags, m = int.from_bytes(r[2:6], "little"), int.from_bytes(r[10:14], "little"), r[25], r[32]
            raw_name = r[33 : 33 + m]
            if raw_name in (b"\0", b"\1"):
                continue
            title = raw_name.decode("utf-16-be" if joliet else "latin-1", "replace").split(";")[0]
            e = Entry("", directory=bool(flags & 2) or None, modified=stamp(r[18:25]), offset=where * 2048)
            use, i = r[33 + m + (m + 1) % 2 :], 0
            better = ""
            while not joliet and i + 4 <= len(use) and use[i + 2] >= 4:
                tag, body = use[i : i + 2], use[i + 5 : i + use[i + 2]] if use[i : i + 2] == b"NM" else use[i + 4 : i + use[i + 2]]
                if tag == b"NM":
                    better += body.decode("utf-8", "replace")
                elif tag == b"PX" and len(body) >= 32:
                    e.mode, e.uid, e.gid = (int.from_bytes(body[o : o + 4], "little") for o in (0, 16, 24))
                i += use[i + 2]
            title = better or title.removesuffix(".") if not joliet else title
            e.name = f"{above}/{title}" if above else title
            if not flags & 2:
                e.size = e.packed = length
                e.method = "None"
                e.decode = lambda _, where=where, length=length: block(where, length)
            yield e
            if flags & 2 and depth < 64:
                yield from walk(where, length, e.name, depth + 1)

    root = chosen[156:190]
    yield from walk(int.from_bytes(root[2:6], "little"), int.from_bytes(root[10:14], "little"), "", 0)

"""Tar: V7, ustar, GNU and pax headers of 512 bytes."""

from __future__ import annotations

from collections.abc import Iterator

from ..source import Source
from .entry import Corrupt, Entry, unix_time


def _number(field: bytes) -> int:
    """Octal digits, or base 256 if the first bit is set."""
    if field[:1] and field[0] & 0x80:
        value = int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
        return value - (1 << (8 * len(field) - 1)) if field[0] & 0x40 else value
    digits = field.replace(b"\0", b" ").split()
    try:
        return int(digits[0], 8) if digits else 0
    except ValueError as e:
        raise Corrupt("not a number") from e


def _pax(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        stop = data.find(b" ", at)
        if stop < 0 or not data[at:stop].isdigit():
            break
        n = int(data[at:stop])
        key, _, value = data[stop + 1 : at + n - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        at += max(n, 1)
    return out


def parse(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """A global pax header replaces the one before; an entry's own keys go before it."""
    at, everywhere, own, long_name, long_link = base, {}, {}, None, None
    while at + 512 <= src.size:
        h = src.need(at, 512)
        if not any(h):
            return
        plain = h[:148] + b" " * 8 + h[156:]
        if _number(h[148:156]) not in (sum(plain), sum(b - 256 if b > 127 else b for b in plain)):
            raise Corrupt("header checksum differs")
        size, kind = _number(h[124:136]), h[156:157]
        if size < 0:
            raise Corrupt("size below zero")
        body, blocks = at + 512, (size + 511) // 512 * 512
        if kind in (b"g", b"x", b"L", b"K"):
            data = src.need(body, size)
            if kind == b"g":
                everywhere = _pax(data)
            elif kind == b"x":
                own = _pax(data)
            elif kind == b"L":
                long_name = data.rstrip(b"\0")
            else:
                long_link = data.rstrip(b"\0")
            at = body + blocks
            continue
        raw = h[:100].split(b"\0")[0]
        ustar = h[257:263] == b"ustar\0"
        if ustar and (prefix := h[345:500].split(b"\0")[0]):
            raw = prefix + b"/" + raw
        e = Entry(long_name or raw, size, size, "None", mode=_number(h[100:108]), uid=_number(h[108:116]), gid=_number(h[116:124]), modified=unix_time(_number(h[136:148])), offset=body)
        if h[257:262] == b"ustar":
            e.user, e.group = h[265:297].split(b"\0")[0].decode("utf-8", "replace") or None, h[297:329].split(b"\0")[0].decode("utf-8", "replace") or None
        target = (long_link or h[157:257].split(b"\0")[0]).decode("utf-8", "replace")
        keys = everywhere | own
        target = keys.get("linkpath", target)
        if kind == b"1":
            e.link, e.hard_link = target, True
        elif kind == b"2":
            e.link = target
        elif kind == b"3":
            e.mode |= 0x2000
        elif kind == b"4":
            e.mode |= 0x6000
        elif kind == b"5":
            e.directory = True
        elif kind == b"6":
            e.mode |= 0x1000
        for key, set_ in (("path", "name"), ("uname", "user"), ("gname", "group"), ("comment", "comment")):
            if key in keys:
                setattr(e, set_, keys[key])
        for key, set_ in (("atime", "accessed"), ("ctime", "created"), ("mtime", "modified")):
            if key in keys:
                setattr(e, set_, unix_time(float(keys[key])))
        for key in ("uid", "gid"):
            if key in keys:
                setattr(e, key, int(keys[key]))
        if "size" in keys:
            e.size = e.packed = size = int(keys["size"])
            blocks = (size + 511) // 512 * 512
        if kind == b"S":
            e.extras["TARIsSparseFile"], e.decode = "true", None
        elif not e.directory and not e.link:
            e.decode = lambda _, body=body, size=size: src.need(body, size)
        if e.directory is None and not e.link and kind in (b"\0", b"") and (e.name if isinstance(e.name, bytes) else e.name.encode()).endswith(b"/"):
            e.directory = True
        e.packed = blocks
        yield e
        at, own, long_name, long_link = body + (0 if kind in b"123456" and kind else blocks), {}, None, None

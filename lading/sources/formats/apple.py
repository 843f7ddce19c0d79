"""What AppleDouble files and resource forks hold: extended attributes, and resources by type and number."""

from __future__ import annotations

from ..source import Source


def extended_attributes(src: Source) -> dict[str, bytes]:
    """Names and values of the extended attributes of an AppleDouble file, sorted by name: they stand behind the Finder's
    information, at places counted from the file's start. A file without them gives none."""
    order = ">" if src.at(0, 2) == b"\0\5" else "<"
    if src.at(0, 4) not in (b"\0\5\x16\7", b"\7\x16\5\0"):
        return {}
    (count,) = src.get(order + "H", 24)
    for k in range(count):
        kind, at, size = src.get(order + "III", 26 + 12 * k)
        if kind != 9 or size < 70 or src.at(at + 34, 4) != b"ATTR":
            continue
        (n,) = src.get(order + "H", at + 34 + 34)
        out, place = {}, at + 34 + 36
        for _ in range(n):
            where, length, _, m = src.get(order + "IIHB", place)
            out[src.need(place + 11, m).rstrip(b"\0").decode("utf-8", "replace")] = src.need(where, length)
            place += (11 + m + 3) // 4 * 4
        return dict(sorted(out.items()))
    return {}


def resources(src: Source) -> list[tuple[str, int, str | None, bytes]]:
    """(type, number, name, data) of each resource of a resource fork, in its map's order."""
    data, map_, _, _ = src.get(">IIII", 0)
    types, names = src.get(">HH", map_ + 24)
    (last,) = src.get(">H", map_ + types)
    out = []
    for k in range((last + 1) & 0xFFFF):
        kind, more, refs = src.get(">4sHH", map_ + types + 2 + 8 * k)
        for i in range(more + 1):
            number, name, place = src.get(">hHI", map_ + types + refs + 12 * i)
            place &= 0xFFFFFF
            (size,) = src.get(">I", data + place)
            title = None
            if name != 0xFFFF:
                n = src.need(map_ + names + name, 1)[0]
                title = src.need(map_ + names + name + 1, n).decode("mac-roman")
            out.append((kind.decode("mac-roman"), number, title, src.need(data + place + 4, size)))
    return out

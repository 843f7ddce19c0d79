"""Bytes that a parser reads: a file's, a column's, a slice's, or several one after another."""

from __future__ import annotations

import bisect
import struct
from itertools import accumulate

from ..functions.kernels import Damaged


class StoreFailure(RuntimeError):
    """The store gave an error: the task fails and is tried again, as no archive is to blame."""


class Source:
    """Random access to bytes held in memory."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def volumes(self) -> list[Source]:
        """The volumes that are joined here, or this one alone."""
        return [self]

    def at(self, offset: int, n: int) -> bytes:
        """n bytes from offset; fewer at the end."""
        return bytes(self.data[max(0, offset) : max(0, offset) + max(0, n)])

    def need(self, offset: int, n: int) -> bytes:
        out = self.at(offset, n)
        if offset < 0 or len(out) < n:
            raise Damaged("data end too soon")
        return out

    def get(self, layout: str, offset: int) -> tuple:
        return struct.unpack(layout, self.need(offset, struct.calcsize(layout)))

    def find(self, what: bytes, start: int = 0, stop: int | None = None) -> int:
        """The first place of what, or -1; read in overlapping chunks."""
        stop, step = min(self.size, self.size if stop is None else stop), 1 << 16
        while start < stop:
            chunk = self.at(start, min(step + len(what) - 1, stop - start))
            if (i := chunk.find(what)) >= 0:
                return start + i
            start += step
        return -1


class FileSource(Source):
    """Random access to an open file with seek and read: headers alone are read to list a large archive."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(max(0, offset))
        return self.file.read(max(0, min(n, self.size - max(0, offset))))


class Slice(Source):
    def __init__(self, inner: Source, offset: int, size: int | None = None) -> None:
        self.inner, self.offset = inner, offset
        self.size = max(0, min(size if size is not None else inner.size, inner.size - offset))

    def at(self, offset: int, n: int) -> bytes:
        offset = max(0, offset)
        return self.inner.at(self.offset + offset, max(0, min(n, self.size - offset)))


class Joined(Source):
    """Volumes in order; a place is found among their running sizes."""

    def __init__(self, parts: list[Source]) -> None:
        self.parts = parts
        self.ends = list(accumulate(p.size for p in parts))
        self.size = self.ends[-1] if parts else 0

    def volumes(self) -> list[Source]:
        return self.parts

    def at(self, offset: int, n: int) -> bytes:
        offset, out = max(0, offset), []
        k = bisect.bisect_right(self.ends, offset)
        while n > 0 and k < len(self.parts):
            start = self.ends[k] - self.parts[k].size
            got = self.parts[k].at(offset - start, n)
            out.append(got)
            offset, n, k = offset + len(got), n - len(got), k + 1
        return b"".join(out)


class Without(Source):
    """A source with ranges (start, after) left out; a place is found among the running sizes of what is left."""

    def __init__(self, inner: Source, ranges: list[tuple[int, int]]) -> None:
        kept, at = [], 0
        for start, after in sorted(ranges):
            if start > at:
                kept.append(Slice(inner, at, start - at))
            at = max(at, after)
        kept.append(Slice(inner, at))
        self.joined = Joined(kept)
        self.size = self.joined.size

    def at(self, offset: int, n: int) -> bytes:
        return self.joined.at(offset, n)


class Sparse(Source):
    """Parts of a source at places (place, size) of a larger one that is zero elsewhere."""

    def __init__(self, inner: Source, parts: list[tuple[int, int]], size: int) -> None:
        self.parts, self.size, self.inner, start = [], size, inner, 0
        for place, n in parts:
            self.parts.append((place, n, start))
            start += n

    def at(self, offset: int, n: int) -> bytes:
        offset = max(0, offset)
        out = bytearray(max(0, min(n, self.size - offset)))
        for place, size, start in self.parts:
            lo, hi = max(place, offset), min(place + size, offset + len(out))
            if lo < hi:
                part = self.inner.at(start + lo - place, hi - lo)
                out[lo - offset : lo - offset + len(part)] = part
        return bytes(out)


class Guarded(Source):
    """Errors of the store as StoreFailure, which isn't taken for damage."""

    def __init__(self, inner: Source) -> None:
        self.inner, self.size = inner, inner.size

    def at(self, offset: int, n: int) -> bytes:
        try:
            return self.inner.at(offset, n)
        except OSError as e:
            raise StoreFailure(str(e)) from e

    def volumes(self) -> list[Source]:
        return [Guarded(v) for v in self.inner.volumes()]

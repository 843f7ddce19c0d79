"""Entries as parsers yield them, and what is derived from each in one place."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta


@dataclass
class Entry:
    """One row: None is unknown, which differs from zero and from false. decode gives the content for a password (or
    None), check tells whether content is as the archive says (None: it says nothing)."""

    name: bytes | str
    size: int | None = None
    packed: int | None = None
    method: str | None = None
    directory: bool | None = None
    fork: bool | None = None
    archive: bool | None = None
    link: str | None = None
    hard_link: bool | None = None
    mode: int | None = None
    uid: int | None = None
    gid: int | None = None
    user: str | None = None
    group: str | None = None
    modified: datetime | None = None
    accessed: datetime | None = None
    created: datetime | None = None
    comment: str | None = None
    encrypted: bool | None = None
    corrupted: bool | None = None
    offset: int | None = None
    dos: int | None = None
    solid: int | None = None
    solid_offset: int | None = None
    encoding: str | None = None
    separators: str = "/"
    extras: dict[str, str] = field(default_factory=dict)
    decode: Callable[[bytes | None], bytes] | None = None
    check: Callable[[bytes], bool] | None = None


class Corrupt(Exception):
    """Parsing can't go on; rows so far stay."""


def text(raw: bytes | str, encoding: str | None = None) -> tuple[str, str]:
    """Text and encoding of raw bytes: UTF-8 if it fits, else what is declared, else windows-1252, then escapes."""
    if isinstance(raw, str):
        return raw, "utf-8"
    for name in ("utf-8", encoding, "windows-1252"):
        if name:
            try:
                return raw.decode(name), name
            except (UnicodeDecodeError, LookupError):
                continue
    return "".join(chr(b) if b < 128 else f"%{b:02x}" for b in raw), "escaped"


def crc32_is(value: int) -> Callable[[bytes], bool]:
    return lambda data: zlib.crc32(data) == value & 0xFFFFFFFF


def unix_time(seconds: float | None) -> datetime | None:
    try:
        return None if seconds is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)
    except OverflowError:
        return None


def dos_time(stamp: int) -> datetime | None:
    """32 bits: years since 1980, month, day, hour, minute and pairs of seconds; None if there is no such date."""
    try:
        return datetime((stamp >> 25) + 1980, stamp >> 21 & 15, stamp >> 16 & 31, stamp >> 11 & 31, stamp >> 5 & 63, 2 * (stamp & 31), tzinfo=UTC)
    except ValueError:
        return None


def file_time(ticks: int) -> datetime | None:
    """Hundreds of nanoseconds since 1601."""
    try:
        return datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10) if ticks else None
    except OverflowError:
        return None


def mac_time(seconds: int) -> datetime | None:
    return datetime(1904, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds) if seconds else None

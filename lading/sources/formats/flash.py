"""SWF: pictures and sounds of a film as entries, named by their count and frame."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from ...functions.filters import png
from ...functions.kernels import Damaged, expand
from ..source import Source
from .entry import Corrupt, Entry

#: The tags that are looked at.
SHOW_FRAME, JPEG, JPEG_TABLES, SOUND, STREAM_HEAD, STREAM_BLOCK, LOSSLESS, JPEG2, JPEG3, LOSSLESS2, SPRITE, STREAM_HEAD2, JPEG4 = 1, 6, 8, 14, 18, 19, 20, 21, 35, 36, 39, 45, 90
#: Samples a second, by the two bits that tell it.
RATES = (5512, 11025, 22050, 44100)


def _tags(body: bytes, at: int) -> Iterator[tuple[int, bytes, int]]:
    """Kind and data of each tag up to the end tag, and the frames shown before it."""
    frame = 0
    while at + 2 <= len(body):
        head = int.from_bytes(body[at : at + 2], "little")
        kind, n, at = head >> 6, head & 63, at + 2
        if n == 63:
            n, at = int.from_bytes(body[at : at + 4], "little"), at + 4
        if not kind:
            return
        if at + n > len(body):
            raise Corrupt("a tag runs over the end")
        frame += kind == SHOW_FRAME
        yield kind, body[at : at + n], frame
        at += n


def _inflated(data: bytes) -> bytes:
    """What can be had of zlib data, its end missing or not."""
    try:
        return expand(zlib.decompressobj(), data)
    except zlib.error as e:
        raise Damaged(str(e)) from e


def _jpeg(data: bytes) -> tuple[bytes, int, int, int]:
    """A picture without the pairs of end and start marks that films put into its head, its width and height, and how
    many bytes of its head were left out."""
    whole = len(data)
    data = data[4:] if data[:4] == b"\xff\xd9\xff\xd8" else data
    head, at, width, height = bytearray(data[:2]), 2, 0, 0
    while at + 4 <= len(data) and data[at : at + 2] != b"\xff\xda":
        mark = data[at : at + 2]
        if mark == b"\xff\xd9":
            at += 4
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if mark[0] != 0xFF or n < 2:
            raise Damaged("no JPEG segment")
        if b"\xff\xc0" <= mark <= b"\xff\xc3":
            height, width = struct.unpack_from(">HH", data, at + 5)
        head += data[at : at + 2 + n]
        at += 2 + n
    out = bytes(head) + data[at:]
    return out, width, height, whole - len(out)


def _samples(data: bytes, width: int, height: int) -> np.ndarray:
    """Rows of so many bytes; those that are missing are zero."""
    return np.frombuffer(data[: width * height].ljust(width * height, b"\0"), np.uint8).reshape(height, width)


def _lossless(data: bytes, kind: int, width: int, height: int, colors: int, alpha: bool) -> bytes:
    """PNG of samples with a palette (3), of 15 bits (4) or of 32 bits (5)."""
    plain, channels = _inflated(data), 4 if alpha else 3
    if kind == 3:
        table = np.zeros((256, channels), np.uint8)
        table[:colors] = _samples(plain, channels, colors)
        out = table[_samples(plain[channels * colors :], (width + 3) // 4 * 4, height)[:, :width]]
    elif kind == 4:
        rows = _samples(plain, (2 * width + 3) // 4 * 4, height)[:, : 2 * width].astype(np.uint16)
        pixels, channels = rows[:, ::2] << 8 | rows[:, 1::2], 3
        out = np.stack([(pixels >> s & 31) * 33 >> 2 for s in (10, 5, 0)], axis=2).astype(np.uint8)
    else:
        out = _samples(plain, 4 * width, height).reshape(height, width, 4)
        out = out[:, :, [1, 2, 3, 0] if alpha else [1, 2, 3]]
    return png(out.tobytes(), width, height, channels)


def _wave(flags: int, data: bytes) -> bytes:
    rate, depth, channels = RATES[flags >> 2 & 3], 16 if flags & 2 else 8, 2 if flags & 1 else 1
    step = channels * depth // 8
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * step, step, depth) + b"data" + struct.pack("<I", len(data)) + data


class _Stream:
    """MP3 that comes in pieces, the first of a frame with four bytes in front."""

    def __init__(self) -> None:
        self.on, self.parts, self.frame = False, [], -1

    def take(self, kind: int, data: bytes, frame: int) -> None:
        if kind in (STREAM_HEAD, STREAM_HEAD2):
            self.on, self.parts = len(data) > 1 and data[1] >> 4 == 2, []
        elif kind == STREAM_BLOCK and self.on:
            self.parts.append(data[4:] if frame != self.frame else data)
            self.frame = frame


def swf(src: Source, name: str, base: int = 0) -> Iterator[Entry]:
    """Pictures (JPEG, GIF and PNG as they are, lossless ones and the alpha of JPEG as PNG) and sounds (MP3, plain samples
    as WAV) in the film's order, then the film's stream. Sounds in other codes are left out, streams in such too."""
    body = src.at(8, src.size)
    method = "Zlib" if src.at(0, 1) == b"C" else "None"
    if method == "Zlib":
        body = _inflated(body)
    if not body:
        raise Corrupt("no film")
    images = sounds = streams = 0
    tables, main = None, _Stream()

    def entry(title: str, data: bytes) -> Entry:
        return Entry(title, len(data), method=method, decode=lambda _: data)

    for kind, data, frame in _tags(body, (5 + 4 * (body[0] >> 3) + 7) // 8 + 4):
        if kind == JPEG_TABLES:
            tables = data[:-2] if len(data) >= 2 else b"\xff\xd8"
        elif kind == JPEG:
            images += 1
            if tables is None:
                raise Corrupt("a picture without its tables")
            yield entry(f"Image {images} at frame {frame}.jpg", tables + data[4:])
        elif kind in (JPEG2, JPEG3, JPEG4):
            images += 1
            skip = {JPEG2: 2, JPEG3: 6, JPEG4: 8}[kind]
            picture, title = data[skip:], f"Image {images} at frame {frame}"
            split = int.from_bytes(data[2:6], "little") if kind != JPEG2 else 0
            plain = re.match(rb"\x89P|GI", picture)
            if plain:
                yield entry(title + (".gif" if plain[0] == b"GI" else ".png"), picture)
                continue
            if picture[:2] not in (b"\xff\xd8", b"\xff\xd9"):
                yield Entry(title, corrupted=True)
                continue
            try:
                whole, width, height, gone = _jpeg(picture)
            except (Damaged, struct.error):
                yield Entry(title + ".jpg", corrupted=True)
                continue
            yield entry(title + ".jpg", whole[: split - gone] if split else whole)
            if split and width and height:
                rest = picture[split:]
                yield Entry(f"Image {images} alpha channel at frame {frame}.png", packed=len(rest), method="Zlib", decode=lambda _, r=rest, w=width, h=height: png(_samples(_inflated(r), w, h).tobytes(), w, h, 1))
        elif kind in (LOSSLESS, LOSSLESS2):
            images += 1
            form, width, height = struct.unpack_from("<BHH", data, 2)
            if form not in (3, 4, 5):
                continue
            at, colors = (8, data[7] + 1) if form == 3 else (7, 0)
            args = (data[at:], form, width, height, colors, kind == LOSSLESS2)
            yield Entry(f"Image {images} at frame {frame}.png", packed=len(data) - at, method="Zlib", decode=lambda _, a=args: _lossless(*a))
        elif kind == SOUND:
            sounds += 1
            title = f"Sound {sounds} at frame {frame}"
            if data[2] >> 4 == 2:
                yield entry(title + ".mp3", data[7:])
            elif data[2] >> 4 in (0, 3):
                yield entry(title + ".wav", _wave(data[2], data[7:]))
        elif kind == SPRITE:
            inner = _Stream()
            for k, d, f in _tags(data, 4):
                inner.take(k, d, f)
            if any(inner.parts):
                streams += 1
                yield entry(f"Stream {streams} at frame {frame}.mp3", b"".join(inner.parts))
        else:
            main.take(kind, data, frame)
    if any(main.parts):
        yield entry("Stream.mp3", b"".join(main.parts))

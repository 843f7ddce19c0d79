"""Byte kernels: checksums, ciphers and decompressors, each a function of bytes and parameters."""

from __future__ import annotations

import binascii
import hashlib
import hmac
import struct
import zlib
from contextvars import ContextVar
from functools import cache

import numpy as np

#: Bytes that one content may have at most.
LIMIT: ContextVar[int] = ContextVar("LIMIT", default=1 << 31)


class Damaged(ValueError):
    """The bytes can't be decoded."""


class Unsupported(ValueError):
    """A method that isn't decoded here."""


class WrongPassword(ValueError):
    """No password, or not the right one."""


class TooLarge(ValueError):
    """More than LIMIT bytes come out."""


def expand(decompressor, data: bytes) -> bytes:
    """What a decompressor of the standard library makes of data, if it is within the limit."""
    most = LIMIT.get()
    out = decompressor.decompress(data, most + 1)
    if len(out) > most:
        raise TooLarge("too many bytes come out")
    return out


# Checksums


@cache
def crc_table(polynomial: int) -> tuple[int, ...]:
    """The table of a reflected polynomial, for one byte at a time."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (polynomial if value & 1 else 0)
        out.append(value)
    return tuple(out)


def crc16(data: bytes, start: int = 0) -> int:
    """CRC-16 of IBM (reflected 0xA001)."""
    table = crc_table(0xA001)
    for b in data:
        start = start >> 8 ^ table[(start ^ b) & 255]
    return start


def crc16_ccitt(data: bytes, start: int = 0) -> int:
    """CRC-16 of CCITT, most significant bit first (0x1021)."""
    return binascii.crc_hqx(data, start)


def byte_sum(data: bytes, mask: int = 0xFFFF) -> int:
    return sum(data) & mask


def xor_sum(data: bytes) -> int:
    return int(np.bitwise_xor.reduce(np.frombuffer(data, np.uint8))) if data else 0


# Ciphers


def zip_cipher(data: bytes, password: bytes) -> bytes:
    """The stream cipher of Zip, its twelve bytes in front included in data and in the result."""
    table, pads = crc_table(0xEDB88320), _zip_pads()
    a, b, c = 0x12345678, 0x23456789, 0x34567890
    for byte in password:
        a = a >> 8 ^ table[(a ^ byte) & 255]
        b = (b + (a & 255)) * 0x08088405 + 1 & 0xFFFFFFFF
        c = c >> 8 ^ table[(c ^ b >> 24) & 255]
    out = bytearray(data)
    for i, byte in enumerate(data):
        out[i] = byte = byte ^ pads[c >> 2 & 0x3FFF]
        a = a >> 8 ^ table[(a ^ byte) & 255]
        b = (b + (a & 255)) * 0x08088405 + 1 & 0xFFFFFFFF
        c = c >> 8 ^ table[(c ^ b >> 24) & 255]
    return bytes(out)


def zip_locked(data: bytes, password: bytes) -> bytes:
    """What zip_cipher() makes data of."""
    table, pads = crc_table(0xEDB88320), _zip_pads()
    a, b, c = 0x12345678, 0x23456789, 0x34567890
    out = bytearray(password + data)
    for i, byte in enumerate(out):
        out[i] = byte ^ pads[c >> 2 & 0x3FFF]
        a = a >> 8 ^ table[(a ^ byte) & 255]
        b = (b + (a & 255)) * 0x08088405 + 1 & 0xFFFFFFFF
        c = c >> 8 ^ table[(c ^ b >> 24) & 255]
    return bytes(out[len(password) :])


@cache
def _zip_pads() -> bytes:
    """What the cipher adds to a byte, by bits 2 to 15 of its third key."""
    return bytes(t * (t ^ 1) >> 8 & 255 for t in range(2, 1 << 16, 4))


def rc4(data: bytes, key: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def xor_cipher(data: bytes, key: bytes) -> bytes:
    """XOR with a key again and again."""
    if not key:
        return data
    pad = np.frombuffer((key * (len(data) // len(key) + 1))[: len(data)], np.uint8)
    return (np.frombuffer(data, np.uint8) ^ pad).tobytes()


@cache
def _boxes() -> tuple[bytes, bytes]:
    """The AES substitution and its inverse, from the field's inverses."""
    box, p, q = bytearray(256), 1, 1
    while True:
        p ^= p << 1 ^ (0x11B if p & 0x80 else 0)
        p &= 0xFF
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 0xFF
        if q & 0x80:
            q ^= 0x09
        x = q ^ (q << 1 | q >> 7) ^ (q << 2 | q >> 6) ^ (q << 3 | q >> 5) ^ (q << 4 | q >> 4)
        box[p] = (x ^ 0x63) & 0xFF
        if p == 1:
            break
    box[0] = 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out & 0xFF


@cache
def _multiples() -> dict[int, bytes]:
    return {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    """AES with a key of 16, 24 or 32 bytes, a block at a time."""

    def __init__(self, key: bytes) -> None:
        box, _ = _boxes()
        words, n, r = [key[i : i + 4] for i in range(0, len(key), 4)], len(key) // 4, 1
        self.rounds = n + 6
        while len(words) < 4 * (self.rounds + 1):
            w = words[-1]
            if len(words) % n == 0:
                w = bytes(box[b] for b in w[1:] + w[:1])
                w = bytes([w[0] ^ r]) + w[1:]
                r = _times(r, 2)
            elif n > 6 and len(words) % n == 4:
                w = bytes(box[b] for b in w)
            words.append(bytes(x ^ y for x, y in zip(words[-n], w, strict=True)))
        self.keys = [b"".join(words[4 * i : 4 * i + 4]) for i in range(self.rounds + 1)]

    def encrypt(self, block: bytes) -> bytes:
        box, m = _boxes()[0], _multiples()
        s = bytes(a ^ b for a, b in zip(block, self.keys[0], strict=True))
        for k in range(1, self.rounds + 1):
            t = [box[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if k < self.rounds:
                t = [m[2][t[c + i]] ^ m[3][t[c + (i + 1) % 4]] ^ t[c + (i + 2) % 4] ^ t[c + (i + 3) % 4] for c in (0, 4, 8, 12) for i in range(4)]
            s = bytes(a ^ b for a, b in zip(t, self.keys[k], strict=True))
        return s

    def decrypt(self, block: bytes) -> bytes:
        back, m = _boxes()[1], _multiples()
        s = bytes(a ^ b for a, b in zip(block, self.keys[-1], strict=True))
        for k in range(self.rounds - 1, -1, -1):
            t = [back[s[(i - 4 * (i % 4)) % 16]] ^ self.keys[k][i] for i in range(16)]
            if k:
                t = [m[14][t[c + i]] ^ m[11][t[c + (i + 1) % 4]] ^ m[13][t[c + (i + 2) % 4]] ^ m[9][t[c + (i + 3) % 4]] for c in (0, 4, 8, 12) for i in range(4)]
            s = bytes(t)
        return s


def aes_ctr(data: bytes, key: bytes) -> bytes:
    """Counter mode with a little-endian counter from one."""
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data), 16):
        pad = aes.encrypt((i // 16 + 1).to_bytes(16, "little"))
        out += bytes(a ^ b for a, b in zip(data[i : i + 16], pad, strict=False))
    return bytes(out)


def aes_cbc(data: bytes, key: bytes, start: bytes) -> bytes:
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(aes.decrypt(block), start, strict=True))
        start = block
    return bytes(out)


def zip_aes(data: bytes, password: bytes, strength: int) -> bytes:
    """WinZip's AES: salt, two bytes of check, the data, ten bytes of its code."""
    size, salt = 8 * (strength + 1), 4 * (strength + 1)
    keys = hashlib.pbkdf2_hmac("sha1", password, data[:salt], 1000, 2 * size + 2)
    if keys[2 * size :] != data[salt : salt + 2]:
        raise WrongPassword("wrong password")
    body = data[salt + 2 : -10]
    if hmac.new(keys[size : 2 * size], body, "sha1").digest()[:10] != data[-10:]:
        raise Damaged("authentication code differs")
    return aes_ctr(body, keys[:size])


# Decompressors


class Bits:
    """Bits of data, the most or the least significant of a byte first; eight bytes are held at a time."""

    def __init__(self, data: bytes, low_first: bool = False) -> None:
        self.data, self.low, self.at, self.held, self.n = data, low_first, 0, 0, 0

    def _fill(self) -> None:
        more = self.data[self.at : self.at + 8]
        self.at += len(more)
        if self.low:
            self.held |= int.from_bytes(more, "little") << self.n
        else:
            self.held = self.held << 8 * len(more) | int.from_bytes(more, "big")
        self.n += 8 * len(more)

    def read(self, k: int) -> int:
        while self.n < k:
            if self.at >= len(self.data):
                raise Damaged("data end too soon")
            self._fill()
        self.n -= k
        if self.low:
            out, self.held = self.held & (1 << k) - 1, self.held >> k
        else:
            out, self.held = self.held >> self.n, self.held & (1 << self.n) - 1
        return out

    def peek(self, k: int) -> int:
        """The next k bits, zeros behind the end."""
        while self.n < k and self.at < len(self.data):
            self._fill()
        if self.low:
            return self.held & (1 << k) - 1
        return self.held >> self.n - k if self.n >= k else self.held << k - self.n

    def align(self) -> None:
        """Skip to the next whole byte."""
        self.read(self.n % 8)

    def place(self) -> int:
        """Bytes that are read, a part of one included."""
        return self.at - self.n // 8

    def seek(self, place: int) -> None:
        self.at, self.held, self.n = place, 0, 0


class Prefix:
    """A canonical prefix code from lengths: shorter first, then by symbol, most significant bit first. A table tells
    codes of up to WIDTH bits at once, longer ones are sought."""

    WIDTH = 10

    def __init__(self, lengths: list[int]) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        self.tables: dict[bool, list] = {}
        code, top = 0, max(lengths, default=0)
        by_size: list[list[int]] = [[] for _ in range(top + 1)]
        for symbol, n in enumerate(lengths):
            by_size[n].append(symbol)
        for size in range(1, top + 1):
            for symbol in by_size[size]:
                self.codes[size, code] = symbol
                code += 1
            code <<= 1

    @classmethod
    def single(cls, symbol: int) -> Prefix:
        out = cls([])
        out.codes[0, 0] = symbol
        return out

    def _table(self, low: bool) -> list:
        table: list = [None] * (1 << self.WIDTH)
        for (size, code), symbol in self.codes.items():
            if size <= self.WIDTH and code < 1 << size:
                for rest in range(1 << self.WIDTH - size):
                    at = int(f"{code:0{size}b}"[::-1], 2) | rest << size if low and size else code << self.WIDTH - size | rest
                    table[at] = (symbol, size)
        self.tables[low] = table
        return table

    def next(self, bits: Bits) -> int:
        found = (self.tables.get(bits.low) or self._table(bits.low))[bits.peek(self.WIDTH)]
        if found:
            if found[1]:
                bits.read(found[1])
            return found[0]
        size = code = 0
        while (size, code) not in self.codes:
            code = code << 1 | bits.read(1)
            size += 1
            if size > 32:
                raise Damaged("no such code")
        return self.codes[size, code]


def unix_compress(data: bytes) -> bytes:
    """LZW of compress (.Z), header included: codes grow from nine bits, and a change of width skips to a group's end."""
    if data[:2] != b"\x1f\x9d" or len(data) < 3:
        raise Damaged("not compress data")
    most, block = data[2] & 31, bool(data[2] & 128)
    body, out = np.frombuffer(data, np.uint8)[3:], bytearray()
    at, width, table, last = 0, 9, [bytes([i]) for i in range(256)] + [b""] * block, b""
    while n := 8 * (len(body) - at) // width:
        room = (1 << width) - len(table) + (not last) if width < most else n
        codes = _codes(body, at, width, min(n, room, 4096))
        grown, cleared = len(codes) == room and width < most, -1
        if len(table) >= 1 << most and max(codes) < len(table):
            if block and 256 in codes:
                cleared = codes.index(256)
                codes = codes[:cleared]
            out += b"".join([table[code] for code in codes])
            last = table[codes[-1]] if codes else last
        else:
            for i, code in enumerate(codes):
                if block and code == 256:
                    cleared = i
                    break
                if code < len(table):
                    word = table[code]
                elif code == len(table) and last:
                    word = last + last[:1]
                else:
                    raise Damaged("code out of range")
                out += word
                if last and len(table) < 1 << most:
                    table.append(last + word[:1])
                last = word
        if cleared >= 0:
            del table[257:]
            at, width, last = at + -(-(cleared + 1) // 8) * width, 9, b""
        elif grown:
            at, width = at + -(-room // 8) * width, width + 1
        elif len(codes) == n:
            break
        else:
            at += len(codes) // 8 * width
        if at > len(body):
            break
    return bytes(out)


def _codes(body: np.ndarray, at: int, width: int, count: int) -> list[int]:
    """count numbers of width bits from the byte at on, the least significant bit first."""
    bits = np.unpackbits(body[at : at + (count * width + 7) // 8], bitorder="little")[: count * width]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits.reshape(count, width)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().tolist()


def rle90(data: bytes) -> bytes:
    """0x90 and a count repeats the byte before; a count of zero is the byte 0x90."""
    out, i = bytearray(), 0
    while i < len(data):
        mark = data.find(0x90, i)
        out += data[i : mark if mark >= 0 else len(data)]
        if mark < 0:
            break
        i = mark
        if i + 1 >= len(data):
            raise Damaged("a run without its count")
        n = data[i + 1]
        if n:
            if not out:
                raise Damaged("a run of nothing")
            out += out[-1:] * (n - 1)
        else:
            out.append(0x90)
        i += 2
    return bytes(out)


def squeeze(data: bytes) -> bytes:
    """Huffman tree of signed node pairs, then codes, least significant bit first; 256 ends."""
    (n,) = struct.unpack_from("<H", data)
    nodes = [struct.unpack_from("<hh", data, 2 + 4 * i) for i in range(n)]
    bits, out = Bits(data[2 + 4 * n :], low_first=True), bytearray()
    if not n:
        return b""
    while True:
        at = 0
        while at >= 0:
            at = nodes[at][bits.read(1)]
            if at >= n:
                raise Damaged("no such node")
        if at == -257:
            return bytes(out)
        out.append(-at - 1)


def lzss(literals, size: int, out: bytearray) -> bytes:
    """Literals and (distance, length) matches until size bytes; matches may reach before the start, to what out held."""
    start = len(out)
    if size > LIMIT.get():
        raise TooLarge("too many bytes come out")
    while len(out) - start < size:
        got = literals()
        if isinstance(got, int):
            out.append(got)
        else:
            distance, length = got
            for _ in range(length):
                out.append(out[-distance] if distance <= len(out) else 0x20)
    return bytes(out[start : start + size])


def lzh_static(data: bytes, size: int, window: int) -> bytes:
    """-lh4- to -lh7-: blocks of canonical codes for literals and lengths, and for distances."""
    bits = Bits(data + b"\0" * 8)
    places = {12: (14, 4), 13: (14, 4), 15: (16, 5), 16: (17, 5)}[window]
    state = {"left": 0, "main": None, "far": None}

    def lengths(most: int, width: int, gap: int) -> Prefix:
        n = bits.read(width)
        if not n:
            return Prefix.single(bits.read(width))
        out: list[int] = []
        while len(out) < n:
            k = bits.read(3)
            if k == 7:
                while bits.read(1):
                    k += 1
            out.append(k)
            if len(out) == gap:
                out += [0] * bits.read(2)
        return Prefix(out[:most])

    def block() -> None:
        state["left"] = bits.read(16)
        short = lengths(19, 5, 3)
        n = bits.read(9)
        if not n:
            state["main"] = Prefix.single(bits.read(9))
        else:
            out: list[int] = []
            while len(out) < n:
                k = short.next(bits)
                out += [0] * ((1, bits.read(4) + 3 if k == 1 else 0, bits.read(9) + 20 if k == 2 else 0)[k]) if k < 3 else [k - 2]
            state["main"] = Prefix(out)
        state["far"] = lengths(places[0], places[1], -1)

    def one():
        if not state["left"]:
            block()
        state["left"] -= 1
        symbol = state["main"].next(bits)
        if symbol < 256:
            return symbol
        k = state["far"].next(bits)
        return (k if k < 2 else (1 << k - 1) + bits.read(k - 1)) + 1, symbol - 253

    return lzss(one, size, bytearray())


def larc_lzs(data: bytes, size: int) -> bytes:
    """-lzs-: a bit tells a literal from an 11-bit place and a 4-bit length in a 2 KiB ring."""
    bits, ring, at, out = Bits(data + b"\0" * 4), bytearray(b" " * 2048), 2048 - 17, bytearray()
    while len(out) < size:
        if bits.read(1):
            got = [bits.read(8)]
        else:
            place, n = bits.read(11), bits.read(4) + 2
            got = [(place + i) % 2048 for i in range(n)]
            for p in got:
                b = ring[p]
                out.append(b)
                ring[at] = b
                at = (at + 1) % 2048
            continue
        out.append(got[0])
        ring[at] = got[0]
        at = (at + 1) % 2048
    return bytes(out[:size])


def inflate(data: bytes) -> bytes:
    d = zlib.decompressobj(-15)
    try:
        return expand(d, data) + d.flush()
    except zlib.error as e:
        raise Damaged(str(e)) from e


def ms_zip(blocks: list[bytes]) -> bytes:
    """Blocks of CK and deflate data, each with the one before as its dictionary."""
    out = bytearray()
    for b in blocks:
        if b[:2] != b"CK":
            raise Damaged("not an MSZIP block")
        d = zlib.decompressobj(-15, zdict=bytes(out[-32768:])) if out else zlib.decompressobj(-15)
        try:
            out += expand(d, b[2:]) + d.flush()
        except zlib.error as e:
            raise Damaged(str(e)) from e
    return bytes(out)


#: The order in which deflate tells the lengths of its code of lengths.
_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def inflate64(data: bytes) -> bytes:
    """Deflate64: a window of 64 KiB, two more distances, and sixteen more bits for the longest length."""
    bits, out, most = Bits(data, low_first=True), bytearray(), LIMIT.get()
    lengths_of, far_of = [], []
    base = 3
    for i in range(28):
        extra = max(0, i // 4 - 1)
        lengths_of.append((base, extra))
        base += 1 << extra
    lengths_of.append((3, 16))
    base = 1
    for i in range(32):
        extra = max(0, i // 2 - 1)
        far_of.append((base, extra))
        base += 1 << extra
    while True:
        last, kind = bits.read(1), bits.read(2)
        if kind == 0:
            bits.align()
            n = bits.read(16)
            bits.read(16)
            out += bytes(bits.read(8) for _ in range(n))
        elif kind == 3:
            raise Damaged("no such block")
        else:
            if kind == 1:
                main, far = Prefix([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), Prefix([5] * 32)
            else:
                n, m, k = bits.read(5) + 257, bits.read(5) + 1, bits.read(4) + 4
                own = [0] * 19
                for place in _ORDER[:k]:
                    own[place] = bits.read(3)
                code, sizes = Prefix(own), []
                while len(sizes) < n + m:
                    c = code.next(bits)
                    if c < 16:
                        sizes.append(c)
                    elif c == 16:
                        if not sizes:
                            raise Damaged("nothing to repeat")
                        sizes += sizes[-1:] * (bits.read(2) + 3)
                    else:
                        sizes += [0] * (bits.read(3) + 3 if c == 17 else bits.read(7) + 11)
                main, far = Prefix(sizes[:n]), Prefix(sizes[n : n + m])
            while (symbol := main.next(bits)) != 256:
                if symbol < 256:
                    out.append(symbol)
                    continue
                if symbol > 285:
                    raise Damaged("no such length")
                start, extra = lengths_of[symbol - 257]
                n = start + bits.read(extra)
                start, extra = far_of[far.next(bits)]
                at = len(out) - start - bits.read(extra)
                if at < 0:
                    raise Damaged("before the start")
                for i in range(n):
                    out.append(out[at + i])
                if len(out) > most:
                    raise TooLarge("too many bytes come out")
        if last:
            return bytes(out)


def lzw(data: bytes, most: int = 13) -> bytes:
    """LZW of Zoo: codes from nine bits on, the least significant bit first; 256 starts anew, 257 ends."""
    bits, out = Bits(data, low_first=True), bytearray()
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    width, last = 9, b""
    while True:
        code = bits.read(width)
        if code == 257:
            return bytes(out)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise Damaged("code out of range")
        out += word
        if last and len(table) < 1 << most:
            table.append(last + word[:1])
            if len(table) >= 1 << width and width < most:
                width += 1
        last = word
        if len(out) > LIMIT.get():
            raise TooLarge("too many bytes come out")


def larc_lz5(data: bytes, size: int) -> bytes:
    """-lz5-: eight flags, then literals and places in a 4 KiB ring that starts with runs, ramps, zeros and blanks."""
    ring = bytearray(b"".join(bytes([i]) * 13 for i in range(256)) + bytes(range(256)) + bytes(range(255, -1, -1)) + bytes(128) + b" " * 128)
    at, out, i, flags, left = 4096 - 18, bytearray(), 0, 0, 0
    while len(out) < size:
        if not left:
            flags, left, i = data[i], 8, i + 1
        literal, flags, left = flags & 1, flags >> 1, left - 1
        if literal:
            got, i = [data[i]], i + 1
            place = None
        else:
            place, n, i = data[i] | (data[i + 1] & 0xF0) << 4, (data[i + 1] & 15) + 3, i + 2
            got = range(n)
        for k in got:
            b = k if place is None else ring[(place + k) % 4096]
            out.append(b)
            ring[at] = b
            at = (at + 1) % 4096
    return bytes(out[:size])

"""Decompression of RAR 3 and RAR 5, with the filters that their programs know by name, and their ciphers."""

from __future__ import annotations

import hashlib
import hmac
import struct
import zlib
from collections.abc import Callable

import numpy as np

from .kernels import LIMIT, Bits, Damaged, Prefix, TooLarge, Unsupported, WrongPassword, aes_cbc
from .ppmd import Model, RarCoder

_CODES20 = 20


def _code_lengths(bits: Bits) -> Prefix:
    """The code that codes lengths: four bits each, 15 tells a run of zeros or itself."""
    out: list[int] = []
    while len(out) < _CODES20:
        n = bits.read(4)
        if n == 15:
            zeros = bits.read(4)
            out += [0] * (zeros + 2) if zeros else [15]
        else:
            out.append(n)
    return Prefix(out[:_CODES20])


def _lengths(bits: Bits, count: int, before: list[int] | None) -> list[int]:
    """Lengths of all codes of a block; with before, they are told as differences."""
    code, out = _code_lengths(bits), []
    while len(out) < count:
        n = code.next(bits)
        if n < 16:
            out.append(n + before[len(out)] & 15 if before else n)
        elif n < 18:
            times = bits.read(3) + 3 if n == 16 else bits.read(7) + 11
            if not out:
                raise Damaged("nothing to repeat")
            out += out[-1:] * times
        else:
            out += [0] * (bits.read(3) + 3 if n == 18 else bits.read(7) + 11)
    return out[:count]


class _Window:
    """What has come out, of one file or of a solid run; matches copy from it."""

    def __init__(self) -> None:
        self.out = bytearray()

    def copy(self, length: int, distance: int) -> None:
        out = self.out
        at = len(out) - distance
        if at < 0:
            raise Damaged("before the start")
        if distance >= length:
            out += out[at : at + length]
        else:
            part = bytes(out[at:])
            out += (part * (length // distance + 1))[:length]


# Filters


def delta(data: bytes, channels: int) -> bytes:
    """Differences of each channel, one channel after another, summed up and interleaved."""
    out = np.zeros(len(data), np.uint8)
    raw, at = np.frombuffer(data, np.uint8), 0
    for c in range(channels):
        n = len(out[c::channels])
        out[c::channels] = (-np.cumsum(raw[at : at + n], dtype=np.uint64)).astype(np.uint8)
        at += n
    return out.tobytes()


def calls(data: bytes, start: int, marks: tuple[int, ...], wraps: bool) -> bytes:
    """Targets behind x86 calls (and jumps), absolute to relative."""
    out, at, size = bytearray(data), 0, 1 << 24
    while at < len(out) - 4:
        at += 1
        if out[at - 1] not in marks:
            continue
        here = (start + at) % size if wraps else start + at
        (target,) = struct.unpack_from("<I", out, at)
        if target >> 31:
            if not (target + here & 0xFFFFFFFF) >> 31:
                struct.pack_into("<I", out, at, target + size & 0xFFFFFFFF)
        elif target < size:
            struct.pack_into("<I", out, at, target - here & 0xFFFFFFFF)
        at += 4
    return bytes(out)


def branches(data: bytes, start: int) -> bytes:
    """Targets of ARM branches with link, absolute to relative."""
    out = bytearray(data)
    for at in range(0, len(out) - 3, 4):
        if out[at + 3] == 0xEB:
            target = int.from_bytes(out[at : at + 3], "little") - (start + at) // 4
            out[at : at + 3] = (target & 0xFFFFFF).to_bytes(3, "little")
    return bytes(out)


def pixels(data: bytes, width: int, red: int) -> bytes:
    """Each byte was told as the difference to whichever of left, above and above left is nearest to their plane."""
    size, out, at = len(data), bytearray(len(data)), 0
    for c in range(3):
        last = 0
        for i in range(c, size, 3):
            up = i - width
            if up >= 3:
                above, corner = out[up], out[up - 3]
                plane = last + above - corner
                a, b, d = abs(plane - last), abs(plane - above), abs(plane - corner)
                guess = last if a <= b and a <= d else above if b <= d else corner
            else:
                guess = last
            last = guess - data[at] & 255
            at += 1
            out[i] = last
    for i in range(red, size - 2, 3):
        out[i] = out[i] + out[i + 1] & 255
        out[i + 2] = out[i + 2] + out[i + 1] & 255
    return bytes(out)


def sound(data: bytes, channels: int) -> bytes:
    """Each channel is predicted from its last differences, with weights that follow the errors."""
    out, at = bytearray(len(data)), 0
    signed = lambda b: b - 256 if b > 127 else b
    for c in range(channels):
        last = change = 0
        d1 = d2 = d3 = k1 = k2 = k3 = 0
        errors = [0] * 7
        for count, i in enumerate(range(c, len(data), channels)):
            d3, d2 = d2, change - d1
            d1 = change
            guess = (8 * last + k1 * d1 + k2 * d2 + k3 * d3) >> 3 & 255
            now = data[at]
            at += 1
            guess = guess - now & 255
            out[i] = guess
            change = signed(guess - last & 255)
            last = guess
            d = signed(now) << 3
            for n, off in enumerate((0, -d1, d1, -d2, d2, -d3, d3)):
                errors[n] += abs(d + off)
            if not count & 31:
                best = min(range(7), key=errors.__getitem__)
                errors = [0] * 7
                if best == 1:
                    k1 -= k1 >= -16
                elif best == 2:
                    k1 += k1 < 16
                elif best == 3:
                    k2 -= k2 >= -16
                elif best == 4:
                    k2 += k2 < 16
                elif best == 5:
                    k3 -= k3 >= -16
                elif best == 6:
                    k3 += k3 < 16
    return bytes(out)


def _span(n: int, bits: Bits) -> int:
    """The length of class n: eight single ones, then four classes for each more bit."""
    if n < 8:
        return 2 + n
    k = n // 4 - 1
    return 2 + ((4 | n & 3) << k) + bits.read(k)


class Rar5:
    """The files of one solid run, one after another; decode() gives the next."""

    def __init__(self) -> None:
        self.window, self.tables, self.old, self.last = _Window(), None, [0, 0, 0, 0], 0

    def decode(self, data: bytes, size: int) -> bytes:
        if size > LIMIT.get():
            raise TooLarge("too many bytes come out")
        out, start, filters, place, final = self.window.out, len(self.window.out), [], 0, False
        while len(out) - start < size and not final:
            flags, check = data[place], data[place + 1]
            n = (flags >> 3 & 3) + 1
            length = int.from_bytes(data[place + 2 : place + 2 + n], "little")
            if n > 3 or check != 0x5A ^ flags ^ length & 255 ^ length >> 8 & 255 ^ length >> 16:
                raise Damaged("no block")
            place += 2 + n
            final = bool(flags & 0x40)
            end = (length - 1) * 8 + (flags & 7) + 1
            bits = Bits(data[place : place + length])
            if flags & 0x80:
                lengths = _lengths(bits, 430, None)
                self.tables = [Prefix(lengths[a:b]) for a, b in ((0, 306), (306, 370), (370, 386), (386, 430))]
            if self.tables is None:
                raise Damaged("no tables")
            self._block(bits, end, start + size, start, filters)
            place += length
        return _filtered(bytes(out[start : start + size]), filters)

    def _block(self, bits: Bits, end: int, stop: int, start: int, filters: list) -> None:
        main, far, low, again = self.tables
        out, old = self.window.out, self.old
        while 8 * bits.at - bits.n < end and len(out) < stop:
            n = main.next(bits)
            if n < 256:
                out.append(n)
            elif n == 256:
                number = lambda: int.from_bytes(bytes(bits.read(8) for _ in range(bits.read(2) + 1)), "little")
                at, length, kind = number(), number(), bits.read(3)
                filters.append((len(out) - start + at, length, kind, bits.read(5) + 1 if kind == 0 else 0))
            elif n == 257:
                if self.last:
                    self.window.copy(self.last, old[0])
            elif n < 262:
                old.insert(0, old.pop(n - 258))
                self.last = _span(again.next(bits), bits)
                self.window.copy(self.last, old[0])
            else:
                length, slot = _span(n - 262, bits), far.next(bits)
                if slot < 4:
                    distance = 1 + slot
                else:
                    k = slot // 2 - 1
                    distance = 1 + ((2 | slot & 1) << k)
                    if k >= 4:
                        distance += (bits.read(k - 4) << 4) + low.next(bits)
                    else:
                        distance += bits.read(k)
                length += (distance > 0x100) + (distance > 0x2000) + (distance > 0x40000)
                old.insert(0, distance)
                old.pop()
                self.last = length
                self.window.copy(length, distance)


def _filtered(data: bytes, filters: list) -> bytes:
    """data with RAR 5's filters (start, length, kind, channels) applied to their parts, in order."""
    if not filters:
        return data
    out = bytearray(data)
    for at, n, kind, channels in filters:
        part = bytes(out[at : at + n])
        if kind == 0:
            part = delta(part, channels)
        elif kind in (1, 2):
            part = calls(part, at, (0xE8,) if kind == 1 else (0xE8, 0xE9), True)
        elif kind == 3:
            part = branches(part, at)
        else:
            raise Unsupported(f"RAR 5 filter {kind}")
        out[at : at + n] = part
    return bytes(out)


#: Length and CRC-32 of the filter programs that archives carry.
_PROGRAMS = {(53, 0xAD576887): "calls", (57, 0x3CD7E57E): "jumps", (29, 0x0E06077D): "delta", (149, 0x1C2C5DC8): "pixels", (216, 0xBC85E701): "sound", (120, 0x3769893F): "itanium"}


def _distances() -> list[tuple[int, int]]:
    """(base, bits) of RAR 3's classes of distance: four of no bits, two of each number of bits up to 15, fourteen of 16
    and twelve of 18."""
    out, base = [], 0
    for bits, count in enumerate([4] + [2] * 15 + [14, 0, 12]):
        for _ in range(count):
            out.append((base, bits))
            base += 1 << bits
    return out


_FAR = _distances()
_SHORT = ((0, 2), (4, 2), (8, 3), (16, 4), (32, 5), (64, 6), (128, 6), (192, 6))


class Rar3:
    """The files of one solid run, one after another; decode() gives the next."""

    def __init__(self) -> None:
        self.window, self.lengths, self.tables, self.old, self.last = _Window(), [0] * 404, None, [0, 0, 0, 0], 0
        self.model: Model | None = None
        self.escape, self.ppm, self.kept = 2, False, False
        self.low, self.low_left = 0, 0
        self.programs: list[list] = []
        self.program = 0

    def decode(self, data: bytes, size: int) -> bytes:
        if size > LIMIT.get():
            raise TooLarge("too many bytes come out")
        out, start = self.window.out, len(self.window.out)
        self.filters: list = []
        bits = Bits(data)
        if not self.kept or self.ppm:
            self._tables(bits)
        while len(out) - start < size:
            if not (self._ppm_block(bits, start + size) if self.ppm else self._block(bits, start + size)):
                break
        whole = bytearray(out[start : start + size])
        for at, n, what, registers in self.filters:
            at -= start
            part = bytes(whole[at : at + n])
            if what == "delta":
                part = delta(part, registers[0])
            elif what in ("calls", "jumps"):
                part = calls(part, at, (0xE8,) if what == "calls" else (0xE8, 0xE9), False)
            elif what == "pixels":
                part = pixels(part, registers[0] - 3, registers[1])
            elif what == "sound":
                part = sound(part, registers[0])
            else:
                raise Unsupported("a RAR filter program of its own")
            whole[at : at + n] = part
        return bytes(whole)

    def _tables(self, bits: Bits) -> None:
        bits.align()
        if bits.read(1):
            self.ppm = True
            flags = bits.read(7)
            memory = bits.read(8) + 1 << 20 if flags & 0x20 else 0
            if flags & 0x40:
                self.escape = bits.read(8)
            if flags & 0x20:
                order = (flags & 31) + 1
                if order == 1:
                    raise Damaged("no model")
                self.model = Model(order if order <= 16 else 16 + (order - 16) * 3, memory)
            if self.model is None:
                raise Damaged("no model")
            self.coder = RarCoder(lambda: bits.read(8) if bits.n >= 8 or bits.at < len(bits.data) else 0)
            return
        self.ppm = False
        if not bits.read(1):
            self.lengths = [0] * 404
        self.low = self.low_left = 0
        self.lengths = _lengths(bits, 404, self.lengths)
        self.tables = [Prefix(self.lengths[a:b]) for a, b in ((0, 299), (299, 359), (359, 376), (376, 404))]
        self.kept = True

    def _far(self, n: int, bits: Bits) -> int:
        """The distance of class n; lowest bits of far ones have a code of their own, or repeat."""
        base, k = _FAR[n]
        if n <= 9:
            return base + 1 + bits.read(k)
        distance = base + 1 + (bits.read(k - 4) << 4 if k > 4 else 0)
        if self.low_left:
            self.low_left -= 1
        else:
            low = self.tables[2].next(bits)
            if low == 16:
                self.low_left = 15
            else:
                self.low = low
        return distance + self.low

    def _block(self, bits: Bits, stop: int) -> bool:
        """Whether the file goes on behind the block."""
        main, far, _, again = self.tables
        out, old = self.window.out, self.old
        while len(out) < stop:
            n = main.next(bits)
            if n < 256:
                out.append(n)
            elif n >= 271:
                length, distance = _span(n - 271, bits) + 1, self._far(far.next(bits), bits)
                length += (distance >= 0x2000) + (distance >= 0x40000)
                self._matched(length, distance)
            elif n == 256:
                if bits.read(1):
                    self._tables(bits)
                    return True
                self.kept = not bits.read(1)
                return False
            elif n == 257:
                self._program(bits.read, bits)
            elif n == 258:
                if self.last:
                    self.window.copy(self.last, old[0])
            elif n < 263:
                old.insert(0, old.pop(n - 259))
                self.last = _span(again.next(bits), bits)
                self.window.copy(self.last, old[0])
            else:
                base, k = _SHORT[n - 263]
                self._matched(2, base + 1 + bits.read(k))
        return False

    def _matched(self, length: int, distance: int) -> None:
        self.old.insert(0, distance)
        self.old.pop()
        self.last = length
        self.window.copy(length, distance)

    def _ppm_block(self, bits: Bits, stop: int) -> bool:
        out = self.window.out
        one = lambda: self._known(self.model.symbol(self.coder))
        while len(out) < stop:
            c = one()
            if c != self.escape:
                out.append(c)
                continue
            c = one()
            if c == 0:
                self._tables(bits)
                return True
            if c == 2:
                return False
            if c == 3:
                self._program(lambda k: one() if k == 8 else 0, None, one)
            elif c == 4:
                far = one() << 16 | one() << 8 | one()
                self.window.copy(one() + 32, far + 2)
            elif c == 5:
                self.window.copy(one() + 4, 1)
            else:
                out.append(self.escape)
        return False

    @staticmethod
    def _known(symbol: int) -> int:
        if symbol < 0:
            raise Damaged("the model ends")
        return symbol

    def _program(self, read: Callable[[int], int], bits: Bits | None, one: Callable[[], int] | None = None) -> None:
        """A filter's place and numbers, and, the first time, its program."""
        byte = one or (lambda: bits.read(8))
        first = byte()
        n = (first & 7) + 1
        if n == 7:
            n = byte() + 7
        elif n == 8:
            n = byte() << 8 | byte()
        code = Bits(bytes(byte() for _ in range(n)))

        def number() -> int:
            kind = code.read(2)
            if kind == 0:
                return code.read(4)
            if kind == 1:
                high = code.read(4)
                return high << 4 | code.read(4) if high else 0xFFFFFF00 | code.read(8)
            return code.read(16) if kind == 2 else code.read(32)

        if first & 0x80:
            which = number()
            if not which:
                self.programs = []
            else:
                which -= 1
        else:
            which = self.program
        if which > len(self.programs):
            raise Damaged("no such filter")
        self.program, new = which, which == len(self.programs)
        if new:
            self.programs.append(["", 0])
        at = number() + (258 if first & 0x40 else 0) + len(self.window.out)
        if first & 0x20:
            self.programs[which][1] = number()
        length, registers = self.programs[which][1], [0] * 7
        if first & 0x10:
            mask = code.read(7)
            for i in range(7):
                if mask >> i & 1:
                    registers[i] = number()
        if new:
            program = bytes(code.read(8) for _ in range(number()))
            self.programs[which][0] = _PROGRAMS.get((len(program), zlib.crc32(program)), "own")
        self.filters.append((at, length, self.programs[which][0], registers))


class _Channel:
    """What RAR 2 foretells of a channel of sound: weights for the last differences that follow the errors."""

    def __init__(self) -> None:
        self.weights, self.differences, self.errors, self.count, self.last, self.change = [0] * 5, [0] * 4, [0] * 11, 0, 0, 0

    def next(self, told: int, other: int) -> int:
        """The byte that is told as a difference; other: how the channel before has changed."""
        signed = lambda b: b - 256 if b > 127 else b
        self.count += 1
        d = self.differences
        d[:] = [self.change, self.change - d[0], d[1], d[2]]
        terms = [*d, other]
        guess = 8 * self.last + sum(w * x for w, x in zip(self.weights, terms, strict=True)) >> 3 & 255
        byte, off = guess - told & 255, signed(told) << 3
        self.errors[0] += abs(off)
        for k, x in enumerate(terms):
            self.errors[2 * k + 1] += abs(off - x)
            self.errors[2 * k + 2] += abs(off + x)
        self.change, self.last = signed(byte - self.last & 255), byte
        if not self.count & 31:
            best = min(range(11), key=self.errors.__getitem__)
            self.errors = [0] * 11
            k = (best - 1) // 2
            if best and best % 2 and self.weights[k] >= -16:
                self.weights[k] -= 1
            elif best and not best % 2 and self.weights[k] < 16:
                self.weights[k] += 1
        return byte


class Rar2:
    """The files of one solid run of RAR 2.0, one after another; decode() gives the next."""

    def __init__(self) -> None:
        self.window, self.lengths, self.tables, self.old, self.last = _Window(), [0] * 1028, None, [1, 1, 1, 1], 0
        self.sound, self.channels, self.channel, self.change = False, [_Channel() for _ in range(4)], 0, 0

    def _read_tables(self, bits: Bits) -> None:
        self.sound = bool(bits.read(1))
        if not bits.read(1):
            self.lengths = [0] * 1028
        n = 1
        if self.sound:
            n = bits.read(2) + 1
            if self.channel >= n:
                self.channel = 0
            self.used = n
        sizes = [257] * n if self.sound else [298, 48, 28]
        code, out = Prefix([bits.read(4) for _ in range(19)]), []
        while len(out) < sum(sizes):
            k = code.next(bits)
            if k < 16:
                out.append(k + self.lengths[len(out)] & 15)
            elif k == 16:
                if not out:
                    raise Damaged("nothing to repeat")
                out += out[-1:] * (bits.read(2) + 3)
            else:
                out += [0] * (bits.read(3) + 3 if k == 17 else bits.read(7) + 11)
        del out[sum(sizes) :]
        self.lengths[: len(out)] = out
        self.tables, at = [], 0
        for k in sizes:
            self.tables.append(Prefix(out[at : at + k]))
            at += k

    def decode(self, data: bytes, size: int) -> bytes:
        if size > LIMIT.get():
            raise TooLarge("too many bytes come out")
        bits, out, old = Bits(data), self.window.out, self.old
        start = len(out)
        if self.tables is None:
            self._read_tables(bits)
        while len(out) - start < size:
            if self.sound:
                n = self.tables[self.channel].next(bits)
                if n == 256:
                    self._read_tables(bits)
                    continue
                channel = self.channels[self.channel]
                out.append(channel.next(n, self.change))
                self.change = channel.change
                self.channel = (self.channel + 1) % self.used
                continue
            n = self.tables[0].next(bits)
            if n < 256:
                out.append(n)
                continue
            if n == 269:
                self._read_tables(bits)
                continue
            if n == 256:
                length, distance = self.last, old[0]
            elif n < 261:
                distance = old[n - 257]
                length = _span(self.tables[2].next(bits), bits)
                length += (distance >= 0x101) + (distance >= 0x2000) + (distance >= 0x40000)
            elif n < 269:
                base, k = _SHORT[n - 261]
                length, distance = 2, base + 1 + bits.read(k)
            else:
                length = _span(n - 270, bits) + 1
                base, k = _FAR[self.tables[1].next(bits)]
                distance = base + 1 + bits.read(k)
                length += (distance >= 0x2000) + (distance >= 0x40000)
            old.insert(0, distance)
            old.pop()
            self.last = length
            if length:
                self.window.copy(length, distance)
        if 8 * len(data) - 8 * bits.at + bits.n > 16:  # tables for the next file may stand at the end
            table = self.tables[self.channel if self.sound else 0]
            if table.next(bits) == (256 if self.sound else 269):
                self._read_tables(bits)
        return bytes(out[start : start + size])


# Ciphers


def rar3_plain(data: bytes, password: str, salt: bytes) -> bytes:
    """AES-128 whose key and start come from a long SHA-1 of the password, the salt and a counter."""
    seed, h, start = password.encode("utf-16-le") + salt, hashlib.sha1(), bytearray()
    for i in range(1 << 18):
        h.update(seed + i.to_bytes(3, "little"))
        if not i % (1 << 14):
            start.append(h.digest()[19])
    key = struct.pack("<4I", *struct.unpack(">4I", h.digest()[:16]))
    return aes_cbc(data, key, bytes(start))


def rar5_key(password: bytes, salt: bytes, power: int, check: bytes | None) -> tuple[bytes, bytes]:
    """The key, and the key of checksums; check tells a wrong password."""
    if power > 24:
        raise Damaged("too many rounds")
    whole = lambda more: hashlib.pbkdf2_hmac("sha256", password, salt, (1 << power) + more, 32)
    if check:
        told = bytearray(8)
        for i, b in enumerate(whole(32)):
            told[i % 8] ^= b
        if bytes(told) != check[:8]:
            raise WrongPassword("wrong password")
    return whole(0), whole(16)


def rar5_checksum(crc: int, key: bytes) -> int:
    """A checksum that depends on the password."""
    out = 0
    for (part,) in struct.iter_unpack("<I", hmac.new(key, struct.pack("<I", crc), "sha256").digest()):
        out ^= part
    return out

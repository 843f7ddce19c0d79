"""Decompressors of older archive formats: LZX and Quantum of cabinets, shrink and implode, -lh1-, ARC's crunch, BCJ2."""

from __future__ import annotations

import struct
from itertools import accumulate

from .kernels import LIMIT, Bits, Damaged, Prefix, TooLarge, Unsupported


def _checked(size: int) -> None:
    if size > LIMIT.get():
        raise TooLarge("too many bytes come out")


def _copied(out: bytearray, distance: int, length: int, blank: int | None = None) -> None:
    """A match; before the start lie blanks, if there may be such."""
    at = len(out) - distance
    while at < 0 and length and blank is not None:
        out.append(blank)
        at, length = at + 1, length - 1
    if at < 0:
        raise Damaged("before the start")
    if distance >= length:
        out += out[at : at + length]
    else:
        part = bytes(out[at:])
        out += (part * (length // distance + 1))[:length]


# Zip


def shrink(data: bytes, size: int) -> bytes:
    """LZW of 9 to 13 bits; code 256 and 1 widens, 256 and 2 frees the codes that no other builds on."""
    _checked(size)
    bits, out, width = Bits(data, low_first=True), bytearray(), 9
    before: list[int | None] = [None] * 8192
    last = [0] * 8192
    free, old, first = 257, None, 0

    def word(code: int) -> bytes:
        w = bytearray()
        while code > 255:
            if before[code] is None or len(w) > 8192:
                raise Damaged("code out of range")
            w.append(last[code])
            code = before[code]
        w.append(code)
        return bytes(w[::-1])

    while len(out) < size:
        code = bits.read(width)
        if code == 256:
            what = bits.read(width)
            if what == 1 and width < 13:
                width += 1
            elif what == 2:
                used = {b for b in before[257:] if b is not None}
                for k in range(257, 8192):
                    if k not in used:
                        before[k] = None
                free = 257
            else:
                raise Damaged("no such control code")
            continue
        if old is None:
            out.append(code & 255)
            old, first = code, code & 255
            continue
        known = code < 256 or before[code] is not None
        w = word(code) if known else word(old) + bytes([first])
        while free < 8192 and before[free] is not None:
            free += 1
        if free < 8192:
            before[free], last[free] = old, w[0]
        out += w
        old, first = code, w[0]
    return bytes(out[:size])


def _shannon(bits: Bits, count: int) -> Prefix:
    """A code from run lengths of lengths; the longest codes, from the last symbol on, have the smallest values."""
    lengths: list[int] = []
    for _ in range(bits.read(8) + 1):
        b = bits.read(8)
        lengths += [(b & 15) + 1] * ((b >> 4) + 1)
    if len(lengths) != count:
        raise Damaged("no such code")
    out, code, step, size = Prefix([]), 0, 0, 0
    for symbol in sorted(range(count), key=lambda s: (lengths[s], s), reverse=True):
        code += step
        if lengths[symbol] != size:
            size = lengths[symbol]
            step = 1 << 16 - size
        out.codes[size, (code & 0xFFFF) >> 16 - size] = symbol
    return out


def implode(data: bytes, size: int, flags: int) -> bytes:
    """A window of 4 or 8 KiB (flag 2), with or without a code for literals (flag 4)."""
    _checked(size)
    bits, out = Bits(data, low_first=True), bytearray()
    literal = _shannon(bits, 256) if flags & 4 else None
    lengths, far = _shannon(bits, 64), _shannon(bits, 64)
    low, least = 7 if flags & 2 else 6, 3 if literal else 2
    while len(out) < size:
        if bits.read(1):
            out.append(literal.next(bits) if literal else bits.read(8))
            continue
        near = bits.read(low)
        distance = (far.next(bits) << low | near) + 1
        n = lengths.next(bits)
        _copied(out, distance, n + least + (bits.read(8) if n == 63 else 0), 0)
    return bytes(out[:size])


# 7-Zip


def bcj2(main: bytes, call: bytes, jump: bytes, coded: bytes, size: int) -> bytes:
    """x86 code whose branch targets are in streams of their own; a range coder tells which branches have theirs there."""
    _checked(size)
    chances, out = [1024] * 258, bytearray()
    scope, code, place = 0xFFFFFFFF, int.from_bytes(coded[:5], "big") & 0xFFFFFFFF, 5
    taken, at, before = {True: 0, False: 0}, 0, 0
    while len(out) < size:
        if at >= len(main):
            raise Damaged("data end too soon")
        b = main[at]
        at += 1
        out.append(b)
        if not (b & 0xFE == 0xE8 or before == 0x0F and b & 0xF0 == 0x80):
            before = b
            continue
        k = before if b == 0xE8 else 256 if b == 0xE9 else 257
        before = b
        if len(out) == size:
            break
        bound = (scope >> 11) * chances[k]
        told = code >= bound
        if told:
            scope, code = scope - bound, code - bound
            chances[k] -= chances[k] >> 5
        else:
            scope = bound
            chances[k] += 2048 - chances[k] >> 5
        if scope < 1 << 24:
            scope, code = scope << 8, (code << 8 | (coded[place] if place < len(coded) else 0)) & 0xFFFFFFFF
            place += 1
        if told:
            side = b == 0xE8
            source = call if side else jump
            if taken[side] + 4 > len(source):
                raise Damaged("data end too soon")
            (target,) = struct.unpack_from(">I", source, taken[side])
            taken[side] += 4
            out += struct.pack("<I", target - len(out) - 4 & 0xFFFFFFFF)
            before = out[-1]
    return bytes(out[:size])


# Cabinets


def _slots(count: int, most: int) -> list[tuple[int, int]]:
    """(base, bits) of classes of distance: two single ones, then two for each number of bits, up to a most."""
    out, base = [], 0
    for k in range(count):
        bits = min(max(0, k // 2 - 1), most)
        out.append((base, bits))
        base += 1 << bits
    return out


#: Classes of distance of LZX by the bits of its window.
_LZX_SLOTS = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}
_FRAME = 32768


class _LzxBits(Bits):
    """Words of 16 bits, the least significant byte first, and in them the most significant bit first."""

    def __init__(self, data: bytes) -> None:
        data += b"\0" * (len(data) % 2)
        swapped = bytearray(data)
        swapped[::2], swapped[1::2] = data[1::2], data[::2]
        super().__init__(bytes(swapped) + b"\0" * 4)
        self.plain = data

    def used(self) -> int:
        return 8 * self.at - self.n

    def raw(self, n: int) -> bytes:
        at = self.used() // 8
        self.seek(at + n)
        return self.plain[at : at + n]


def lzx(data: bytes, size: int, window: int) -> bytes:
    """LZX of cabinets: blocks of verbatim, aligned or plain data, in frames of 32 KiB that end on a word."""
    _checked(size)
    if window not in _LZX_SLOTS:
        raise Damaged("no such window")
    bits, out, slots = _LzxBits(data), bytearray(), _slots(_LZX_SLOTS[window], 17)
    file_size = bits.read(32) if bits.read(1) else 0
    main, lengths, recent = [0] * (256 + 8 * len(slots)), [0] * 249, [1, 1, 1]
    codes: list = [None, None, None]
    kind = left = 0
    odd = started = False

    def told(old: list[int], first: int, after: int) -> None:
        code, k = Prefix([bits.read(4) for _ in range(20)]), first
        while k < after:
            c = code.next(bits)
            if c < 17:
                old[k], k = (old[k] - c) % 17, k + 1
                continue
            if c == 19:
                n = bits.read(1) + 4
                value = (old[k] - code.next(bits)) % 17
            else:
                n, value = (bits.read(4) + 4 if c == 17 else bits.read(5) + 20), 0
            n = min(n, after - k)
            old[k : k + n] = [value] * n
            k += n

    while len(out) < size:
        stop = min(size, len(out) // _FRAME * _FRAME + _FRAME)
        while len(out) < stop:
            if not left:
                if odd:
                    bits.raw(1)
                    odd = False
                kind, left = bits.read(3), bits.read(24)
                if kind == 2:
                    codes[2] = Prefix([bits.read(3) for _ in range(8)])
                if kind in (1, 2):
                    told(main, 0, 256)
                    told(main, 256, len(main))
                    told(lengths, 0, 249)
                    codes[0], codes[1] = Prefix(main), Prefix(lengths)
                    started |= main[0xE8] > 0
                elif kind == 3:
                    started = True
                    bits.read(16 - bits.used() % 16)
                    recent = list(struct.unpack("<III", bits.raw(12)))
                    odd = bool(left & 1)
                else:
                    raise Damaged("no such block")
            if kind == 3:
                n = min(left, stop - len(out))
                part = bits.raw(n)
                if len(part) < n:
                    raise Damaged("data end too soon")
                out += part
                left -= n
                continue
            had = len(out)
            c = codes[0].next(bits)
            if c < 256:
                out.append(c)
            else:
                n, slot = (c - 256 & 7) + 2, c - 256 >> 3
                if n == 9:
                    n += codes[1].next(bits)
                if slot < 3:
                    recent[0], recent[slot] = recent[slot], recent[0]
                else:
                    base, more = slots[slot]
                    if kind == 2 and more >= 3:
                        distance = base - 2 + (bits.read(more - 3) << 3) + codes[2].next(bits)
                    else:
                        distance = base - 2 + bits.read(more)
                    recent = [distance, *recent[:2]]
                _copied(out, recent[0], n)
            left -= len(out) - had
        if bits.used() % 16:
            bits.read(-bits.used() % 16)
    return _calls_back(bytes(out[:size]), file_size) if started and file_size else bytes(out[:size])


def amiga_lzx(data: bytes, size: int) -> bytes:
    """LZX of the Amiga: words of 16 bits, read from the least significant bit on; blocks keep the code lengths of the
    block before as what theirs differ from."""
    _checked(size)
    swapped = bytearray(data[: len(data) // 2 * 2])
    swapped[::2], swapped[1::2] = swapped[1::2], swapped[::2]
    bits, out, slots = Bits(bytes(swapped), low_first=True), bytearray(), _slots(32, 14)
    lengths, far, left, main, low = [0] * 768, 1, 0, None, None

    def told(first: int, after: int, late: int) -> None:
        code, k = Prefix([bits.read(4) for _ in range(20)]), first
        while k < after:
            c = code.next(bits)
            if c == 17:
                n, value = bits.read(4) + 4 - late, 0
            elif c == 18:
                n, value = bits.read(5 + late) + 20 - late, 0
            else:
                n = bits.read(1) + 4 - late if c == 19 else 1
                value = (lengths[k] - (code.next(bits) if c == 19 else c)) % 17
            if k + n > after:
                raise Damaged("lengths run over")
            lengths[k : k + n] = [value] * n
            k += n

    while len(out) < size:
        if not left:
            kind = bits.read(3)
            if kind not in (2, 3):
                raise (Unsupported if kind == 1 else Damaged)("no such block")
            low = Prefix([bits.read(3) for _ in range(8)]) if kind == 3 else None
            left = int.from_bytes(bytes(bits.read(8) for _ in range(3)), "big")
            told(0, 256, 0)
            told(256, 768, 1)
            main = Prefix(lengths)
            continue
        symbol = main.next(bits)
        if symbol < 256:
            out.append(symbol)
            left -= 1
            continue
        base, more = slots[symbol & 31]
        if base or more:
            far = base + (bits.read(more) if low is None or more < 3 else (bits.read(more - 3) << 3) + low.next(bits))
        base, more = slots[symbol - 256 >> 5]
        n = base + 3 + bits.read(more)
        if far > len(out):
            raise Damaged("a copy from before the start")
        word = out[len(out) - far : len(out) - far + n]
        out += (word * (n // far + 1))[:n]
        left = max(0, left - n)
    return bytes(out[:size])


def _calls_back(data: bytes, file_size: int) -> bytes:
    """Targets behind E8, absolute to relative, in each frame but for its last ten bytes."""
    out = bytearray(data)
    for start in range(0, min(len(out), 32768 * _FRAME), _FRAME):
        at, stop = start, min(start + _FRAME, len(out)) - 10
        while at < stop:
            if out[at] != 0xE8:
                at += 1
                continue
            (target,) = struct.unpack_from("<i", out, at + 1)
            if -at <= target < file_size:
                struct.pack_into("<i", out, at + 1, target - at if target >= 0 else target + file_size)
            at += 5
    return bytes(out)


class _Shares:
    """A model of Quantum: symbols by falling cumulated counts."""

    def __init__(self, first: int, n: int) -> None:
        self.symbols, self.counts, self.left = [*range(first, first + n), 0], list(range(n, -1, -1)), 4

    def grow(self, at: int) -> None:
        c = self.counts
        for i in range(at):
            c[i] += 8
        if c[0] <= 3800:
            return
        n = len(c) - 1
        self.left -= 1
        if self.left:
            for i in range(n - 1, -1, -1):
                c[i] >>= 1
                if c[i] <= c[i + 1]:
                    c[i] = c[i + 1] + 1
            return
        self.left = 50
        own = [c[i] - c[i + 1] + 1 >> 1 for i in range(n)]
        s = self.symbols
        for i in range(n - 1):
            for j in range(i + 1, n):
                if own[i] < own[j]:
                    own[i], own[j], s[i], s[j] = own[j], own[i], s[j], s[i]
        c[:] = [*list(accumulate(reversed(own)))[::-1], 0]


def quantum(blocks: list[bytes], sizes: list[int], window: int) -> bytes:
    """Quantum of cabinets: an arithmetic coder over seven models of literals, lengths and places; it starts anew with
    each block, the models don't."""
    _checked(sum(sizes))
    out, slots = bytearray(), _slots(42, 19)
    spans = [(k, 0) for k in range(6)]
    base = 6
    for k in range(20):
        spans.append((base, k // 4 + 1))
        base += 1 << k // 4 + 1
    spans.append((base, 0))
    kind, literals = _Shares(0, 7), [_Shares(64 * k, 64) for k in range(4)]
    places = [_Shares(0, min(most, 2 * window)) for most in (24, 36, 42)]
    length = _Shares(0, 27)
    for data, size in zip(blocks, sizes, strict=True):
        bits = Bits(data + b"\xff" + bytes(16))
        low, high, code = 0, 0xFFFF, bits.read(16)

        def symbol(model: _Shares, bits: Bits = bits) -> int:
            nonlocal low, high, code
            c, scope = model.counts, (high - low & 0xFFFF) + 1
            want = ((code - low + 1) * c[0] - 1) // scope & 0xFFFF
            i = next((k for k in range(1, len(c)) if c[k] <= want), len(c) - 1)
            out_ = model.symbols[i - 1]
            high, low = low + c[i - 1] * scope // c[0] - 1, low + c[i] * scope // c[0]
            model.grow(i)
            while True:
                if low & 0x8000 != high & 0x8000:
                    if not low & 0x4000 or high & 0x4000:
                        return out_
                    code, low, high = code ^ 0x4000, low & 0x3FFF, high | 0x4000
                low, high, code = low << 1 & 0xFFFF, (high << 1 | 1) & 0xFFFF, (code << 1 | bits.read(1)) & 0xFFFF

        stop = len(out) + size
        while len(out) < stop:
            k = symbol(kind)
            if k < 4:
                out.append(symbol(literals[k]))
                continue
            n = k - 1
            if k == 6:
                base, more = spans[symbol(length)]
                n = base + bits.read(more) + 5
            base, more = slots[symbol(places[k - 4])]
            _copied(out, base + bits.read(more) + 1, n)
    return bytes(out)


# LHA, ARJ and ARC


def lh1(data: bytes, size: int) -> bytes:
    """-lh1-: a Huffman tree that adapts, for literals and lengths, and a fixed code for the upper bits of distances."""
    _checked(size)
    n, bits, out = 314, Bits(data + bytes(8)), bytearray()
    t, top = 2 * n - 1, 2 * n - 2
    count, son, above = [1] * n + [0] * n, [0] * (t + 1), [0] * (t + n)
    far = Prefix([3] + [4] * 3 + [5] * 8 + [6] * 12 + [7] * 24 + [8] * 16)
    for i in range(n):
        son[i], above[i + t] = i + t, i
    for j in range(n, t):
        i = 2 * (j - n)
        count[j], son[j] = count[i] + count[i + 1], i
        above[i] = above[i + 1] = j
    count[t] = 0xFFFF

    def hang(child: int, node: int) -> None:
        above[child] = node
        if child < t:
            above[child + 1] = node

    def rebuild() -> None:
        leaves = [(count[i] + 1 >> 1, son[i]) for i in range(t) if son[i] >= t]
        for i, (c, s) in enumerate(leaves):
            count[i], son[i] = c, s
        for j in range(n, t):
            i = 2 * (j - n)
            c, k = count[i] + count[i + 1], j
            while c < count[k - 1]:
                k -= 1
            count[k + 1 : j + 1], son[k + 1 : j + 1] = count[k:j], son[k:j]
            count[k], son[k] = c, i
        for i in range(t):
            hang(son[i], i)

    while len(out) < size:
        c = son[top]
        while c < t:
            c = son[c + bits.read(1)]
        symbol = c - t
        if count[top] == 0x8000:
            rebuild()
        c = above[symbol + t]
        while True:
            count[c] += 1
            k, other = count[c], c + 1
            if k > count[other]:
                while k > count[other + 1]:
                    other += 1
                count[c], count[other] = count[other], k
                i, j = son[c], son[other]
                hang(i, other)
                hang(j, c)
                son[other], son[c] = i, j
                c = other
            c = above[c]
            if not c:
                break
        if symbol < 256:
            out.append(symbol)
        else:
            high = far.next(bits)
            _copied(out, (high << 6 | bits.read(6)) + 1, symbol - 253, 0x20)
    return bytes(out[:size])


def arj_fastest(data: bytes, size: int) -> bytes:
    """ARJ's method 4: numbers of bits told by ones in front, up to 7 for lengths and 9 to 13 for distances."""
    _checked(size)
    bits, out = Bits(data + bytes(8)), bytearray()

    def number(first: int, most: int) -> int:
        width, plus = first, 0
        while width < most and bits.read(1):
            plus += 1 << width
            width += 1
        return plus + bits.read(width)

    while len(out) < size:
        n = number(0, 7)
        if n:
            _copied(out, number(9, 13) + 1, n + 2)
        else:
            out.append(bits.read(8))
    return bytes(out[:size])


def arc_crunch(data: bytes, newer: bool) -> bytes:
    """ARC's codes of 12 bits, whose places in a table follow from a hash, by squares or, newer, by a product."""
    bits, out, left = Bits(data), bytearray(), 4096
    used, after = [False] * 4096, [0] * 4096
    before, last = [-1] * 4096, [0] * 4096

    def add(code: int, byte: int) -> None:
        total = code + byte & 0xFFFF
        at = total * 15073 & 0xFFF if newer else ((total | 0x800) ** 2 & 0xFFFFFFFF) >> 6 & 0xFFF
        if used[at]:
            while after[at]:
                at = after[at]
            free = at + 101 & 0xFFF
            while used[free]:
                free = free + 1 & 0xFFF
            after[at], at = free, free
        used[at], before[at], last[at] = True, code if code != 0xFFFF else -1, byte

    for b in range(256):
        add(0xFFFF, b)
    left -= 256

    def word(code: int) -> bytes:
        w = bytearray()
        while code >= 0:
            if not used[code] or len(w) > 4096:
                raise Damaged("code out of range")
            w.append(last[code])
            code = before[code]
        return bytes(w[::-1])

    old, first = -1, 0
    while 8 * len(data) - (8 * bits.at - bits.n) >= 12:
        code = bits.read(12)
        if old < 0:
            w = word(code)
        else:
            w = word(code) if used[code] else word(old) + bytes([first])
            if left:
                add(old, w[0])
                left -= 1
        out += w
        old, first = code, w[0]
        if len(out) > LIMIT.get():
            raise TooLarge("too many bytes come out")
    return bytes(out)


# Compact Pro


def compact_rle(data: bytes) -> bytes:
    """0x81 0x82 and a count repeats the byte before, a count of zero is the two bytes themselves; a second 0x81 stays
    half a mark."""
    out, at, half, n = bytearray(), 0, False, len(data)
    while half or at < n:
        if half:
            b, half = 0x81, False
        else:
            b, at = data[at], at + 1
        if b != 0x81 or at >= n:
            out.append(b)
            continue
        b, at = data[at], at + 1
        if b == 0x82:
            if at >= n:
                raise Damaged("a run without its count")
            count, at = data[at], at + 1
            if count:
                if not out:
                    raise Damaged("a run of nothing")
                out += out[-1:] * (count - 1)
            else:
                out += b"\x81\x82"
        elif b == 0x81:
            out.append(0x81)
            half = True
        else:
            out += bytes([0x81, b])
    return bytes(out)


def compact_lzh(data: bytes, most: int) -> bytes:
    """Blocks of literals, lengths and places, each with its three codes, until the data end; a window of 8 KiB."""
    bits, out, limit = Bits(data + bytes(8)), bytearray(), 8 * len(data)

    def code(count: int) -> Prefix:
        pairs = bits.read(8)
        if 2 * pairs > count:
            raise Damaged("no such code")
        lengths = [bits.read(4) for _ in range(2 * pairs)]
        return Prefix(lengths + [0] * (count - len(lengths)))

    while len(out) < most and 8 * bits.at - bits.n < limit:
        literal, length, far, weight = code(256), code(64), code(128), 0
        while weight < 0x1FFF0 and len(out) < most and 8 * bits.at - bits.n < limit:
            last = 8 * bits.at - bits.n > limit - 8  # what fills the last byte may be no symbol
            try:
                if bits.read(1):
                    out.append(literal.next(bits))
                    weight += 2
                else:
                    n = length.next(bits)
                    _copied(out, far.next(bits) << 6 | bits.read(6), n)
                    weight += 3
            except Damaged:
                if not last:
                    raise
                break
        if len(out) < most:
            odd = bits.place() % 2
            bits.align()
            bits.read(24 if odd else 16)
    return bytes(out[:most])


class _Weights:
    """Symbols from a first one on with adaptive weights, which are halved once their sum is over a limit."""

    def __init__(self, first: int, count: int, step: int, most: int) -> None:
        self.first, self.count, self.step, self.most = first, count, step, most
        self.reset()

    def reset(self) -> None:
        self.each, self.total = [self.step] * self.count, self.step * self.count

    def used(self, k: int) -> None:
        self.each[k] += self.step
        self.total += self.step
        if self.total > self.most:
            self.each = [(w + 1) // 2 for w in self.each]
            self.total = sum(self.each)


class _Ranges:
    """An arithmetic decoder of 26 bits."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.range = Bits(data + bytes(8)), 1 << 25
        self.code = self.bits.read(26)

    def next(self, weights: _Weights) -> int:
        unit = self.range // weights.total
        want, below, k = self.code // unit, 0, 0
        while k < weights.count - 1 and below + weights.each[k] <= want:
            below += weights.each[k]
            k += 1
        self.code -= unit * below
        self.range = self.range - unit * below if below + weights.each[k] == weights.total else unit * weights.each[k]
        weights.used(k)
        more = max(0, 25 - (self.range - 1).bit_length())
        if more:
            self.range <<= more
            self.code = self.code << more | self.bits.read(more)
        return weights.first + k

    def number(self, weights: _Weights, bits: int) -> int:
        return sum(self.next(weights) << i for i in range(bits))


def arsenic(data: bytes, size: int) -> tuple[bytes, int]:
    """Sorted blocks, moved to the front, in an arithmetic code; and the CRC-32 that is told behind them. Blocks that were
    disturbed before they were sorted need a table that isn't here."""
    _checked(size)
    coder, plain, kinds = _Ranges(data), _Weights(0, 2, 1, 256), _Weights(0, 11, 8, 1024)
    classes = [_Weights(2 << k, 2 << k, step, 1024) for k, step in enumerate((8, 4, 4, 4, 2, 2, 1))]
    if bytes(coder.number(plain, 8) for _ in range(2)) != b"As":
        raise Damaged("no such stream")
    width, out = coder.number(plain, 4) + 9, bytearray()
    done, told = coder.next(plain), 0
    while not done:
        disturbed, row = coder.next(plain), coder.number(plain, width)
        order, block = list(range(256)), bytearray()
        zeros, unit, kind = 0, 1, 0
        while kind != 10:
            kind = coder.next(kinds)
            if kind < 2:
                zeros, unit = zeros + unit * (kind + 1), unit * 2
            if zeros and kind > 1 or zeros > 1 << width:
                if len(block) + zeros > 1 << width:
                    raise Damaged("a block is too long")
                block += bytes([order[0]]) * zeros
            if kind > 1:
                zeros, unit = 0, 1
            if 1 < kind < 10:
                order.insert(0, order.pop(1 if kind == 2 else coder.next(classes[kind - 3])))
                block.append(order[0])
                if len(block) > 1 << width:
                    raise Damaged("a block is too long")
        for weights in (kinds, *classes):
            weights.reset()
        if coder.next(plain):
            done, told = 1, coder.number(plain, 32)
        if disturbed:
            raise Unsupported("disturbed blocks")
        if row >= len(block):
            raise Damaged("no such row")
        follow, same, last = sorted(range(len(block)), key=block.__getitem__), 0, 0
        for _ in range(len(block)):
            row = follow[row]
            byte = block[row]
            if same == 4:
                out += bytes([last]) * byte
                same = 0
                continue
            same = same + 1 if byte == last else 1
            last = byte
            out.append(byte)
        if len(out) > size:
            raise Damaged("more comes out than was told")
    return bytes(out), told

"""Decompressors against small encoders of their own formats; the box has no archives of the programs that write these."""

import hashlib
import random
import struct
import zlib

import pytest

from lading.functions import codecs, ppmd, rar
from lading.functions.kernels import Bits, Damaged, Prefix, TooLarge, Unsupported, crc16, rc4
from lading.sources.formats.dos import _Run
from lading.sources.formats.sevenzip import _summed
from lading.sources.reader import Options, rows_of
from lading.sources.source import Joined, Source

TEXT = b"the quick brown fox jumps over the lazy dog and the quick red fox jumps over the lazy cat; " * 12 + bytes(range(256))


class Writer:
    """Bits, the most or the least significant of a byte first."""

    def __init__(self, low=False):
        self.bits, self.low = [], low

    def put(self, value, n):
        order = range(n) if self.low else range(n - 1, -1, -1)
        self.bits += [value >> i & 1 for i in order]

    def code(self, prefix, symbol):
        size, code = next(k for k, s in prefix.codes.items() if s == symbol)
        self.bits += [code >> i & 1 for i in range(size - 1, -1, -1)]

    def done(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << (i if self.low else 7 - i) for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))


def parsed(data, least, most, far):
    """Literals and (distance, length) of a greedy parse."""
    at = 0
    while at < len(data):
        best = (0, 0)
        for k in range(max(0, at - far), at):
            n = 0
            while n < most and at + n < len(data) and data[k + n] == data[at + n]:
                n += 1
            if n > best[1]:
                best = (at - k, n)
        if best[1] >= least:
            yield best
            at += best[1]
        else:
            yield data[at]
            at += 1


def test_shrink():
    """With a change of width, and partial clearing that frees the codes nothing builds on."""
    w, table, width, free, old = Writer(low=True), {bytes([i]): i for i in range(256)}, 9, 257, None
    data = TEXT * 3
    at = 0
    while at < len(data):
        n = 1
        while at + n < len(data) and data[at : at + n + 1] in table:
            n += 1
        word = data[at : at + n]
        if table[word] >= 1 << width:
            w.put(256, width), w.put(1, width)
            width += 1
        w.put(table[word], width)
        at += n
        if at < len(data):
            table[data[at - n : at + 1]] = free
            free += 1
        old = word
    assert old and codecs.shrink(w.done(), len(data)) == data
    w = Writer(low=True)
    for c in (97, 98, 257, 256, 2, 97, 98, 258):  # a b ab; what was learnt goes, as nothing builds on it; a b ab
        w.put(c, 9)
    assert codecs.shrink(w.done(), 8) == b"abababab"


@pytest.mark.parametrize("flags", [0, 2, 4, 6])
def test_implode(flags):
    w = Writer(low=True)
    trees = []
    for count, size in ((256, 8), (64, 6), (64, 6)) if flags & 4 else ((64, 6), (64, 6)):
        runs = [(min(16, count - k), size) for k in range(0, count, 16)]
        w.put(len(runs) - 1, 8)
        for n, s in runs:
            w.put((n - 1) << 4 | s - 1, 8)
        trees.append({s: (1 << size) - 1 - s for s in range(count)})  # the last symbol has the smallest code
        trees[-1]["size"] = size
    literal, lengths, far = trees if flags & 4 else (None, *trees)

    def code(tree, symbol):
        for i in range(tree["size"] - 1, -1, -1):
            w.put(tree[symbol] >> i & 1, 1)

    low, least = 7 if flags & 2 else 6, 3 if flags & 4 else 2
    for x in parsed(TEXT, 4, 200, 4000):
        if isinstance(x, int):
            w.put(1, 1)
            code(literal, x) if literal else w.put(x, 8)
            continue
        w.put(0, 1)
        w.put(x[0] - 1 & (1 << low) - 1, low)
        code(far, x[0] - 1 >> low)
        n = x[1] - least
        code(lengths, min(n, 63))
        if n >= 63:
            w.put(n - 63, 8)
    assert codecs.implode(w.done(), len(TEXT), flags) == TEXT


class RangeEncoder:
    def __init__(self):
        self.low, self.range, self.out = 0, 0xFFFFFFFF, []

    def _shift(self):
        if self.low >> 32:
            k = len(self.out) - 1
            while self.out[k] == 255:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
            self.low &= 0xFFFFFFFF
        self.out.append(self.low >> 24)
        self.low = self.low << 8 & 0xFFFFFFFF

    def narrow(self, start, size, unit):
        self.low, self.range = self.low + start * unit, size
        while self.range < 1 << 24:
            self._shift()
            self.range <<= 8

    def done(self):
        for _ in range(5):
            self._shift()
        return bytes([0, *self.out])


class Guide:
    """Stands for a coder: leads a model to the wanted symbols and writes down what it would have decoded."""

    def __init__(self, model):
        self.model, self.enc = model, RangeEncoder()

    def threshold(self, total):
        self.enc.range //= total
        high = 0
        for s in self.model.least.states:
            if s.symbol in self.masked:
                continue
            if s.symbol == self.want:
                return high
            high += s.freq
        self.masked |= {s.symbol for s in self.model.least.states}
        return total - 1

    def decode(self, start, size):
        unit = self.enc.range
        self.enc.narrow(start * unit, size * unit, 1)

    def bit(self, zero):
        s = self.model.least.states[0]
        bound = (self.enc.range >> 14) * zero
        one = s.symbol != self.want
        self.masked |= {s.symbol} if one else set()
        self.enc.narrow(*((bound, self.enc.range - bound) if one else (0, bound)), 1)
        return int(one)


@pytest.mark.parametrize("order", [2, 6, 16])
def test_ppmd_goes_back(order):
    rng = random.Random(order)
    data = TEXT * 4 + bytes(rng.choice(b"abcde ") for _ in range(4000)) + bytes(rng.randrange(256) for _ in range(1500)) + TEXT
    model = ppmd.Model(order, 1 << 24)
    guide = Guide(model)
    for b in data:
        guide.want, guide.masked = b, set()
        assert model.symbol(guide) == b
    packed = guide.enc.done()
    assert ppmd.seven_zip(packed, order, 1 << 24, len(data)) == data
    assert len(packed) < len(data) // 2
    with pytest.raises(Unsupported):
        ppmd.seven_zip(packed, order, 1 << 12, len(data))


def test_bcj2():
    """A stream without branches, and one whose branch targets are told in their own streams."""
    coded = bytes(5) + b"\0" * 64
    main = b"no branches here"
    assert codecs.bcj2(main, b"", b"", coded, len(main)) == main
    enc, chances = RangeEncoder(), {}
    calls, jumps, main, out = b"", b"", bytearray(), bytearray()
    for byte, target in ((0x90, None), (0xE8, 0x1234), (0x01, None), (0xE9, 0x55), (0xE8, None), (7, None)):
        before = out[-1] if out else 0
        out.append(byte)
        main.append(byte)
        if byte & 0xFE == 0xE8:
            k = before if byte == 0xE8 else 256
            p = chances.get(k, 1024)
            bound = (enc.range >> 11) * p
            if target is None:
                enc.narrow(0, bound, 1)
                chances[k] = p + (2048 - p >> 5)
            else:
                enc.narrow(bound, enc.range - bound, 1)
                chances[k] = p - (p >> 5)
                where = struct.pack(">I", target)
                calls, jumps = (calls + where, jumps) if byte == 0xE8 else (calls, jumps + where)
                out += struct.pack("<I", target - len(out) - 4 & 0xFFFFFFFF)
    assert codecs.bcj2(bytes(main), calls, jumps, enc.done(), len(out)) == bytes(out)


def span(n, least):
    """Class, bits and rest of a length."""
    n -= least
    if n < 8:
        return n, 0, 0
    k = n.bit_length() - 3
    return 4 * (k + 1) + (n >> k & 3), k, n & (1 << k) - 1


def far5(d):
    d -= 1
    if d < 4:
        return d, 0, 0
    k = d.bit_length() - 2
    return 2 * (k + 1) + (d >> k & 1), k, d & (1 << k) - 1


def coded_lengths(w, counts):
    """Lengths, all equal within a part; those of the code that codes them are five bits each."""
    for _ in range(20):
        w.put(5, 4)
    code = Prefix([5] * 20)
    for count, size in counts:
        for _ in range(count):
            w.code(code, size)
    return [Prefix([size] * count) for count, size in counts]


def rar5_block(data, final=True, filters=()):
    w = Writer()
    main, far, low, again = coded_lengths(w, ((306, 9), (64, 6), (16, 4), (44, 6)))
    number = lambda v: (w.put(3, 2), [w.put(b, 8) for b in struct.pack("<I", v)])
    for at, n, kind, channels in filters:
        w.code(main, 256)
        number(at), number(n), w.put(kind, 3)
        if not kind:
            w.put(channels - 1, 5)
    last = None
    for x in parsed(data, 4, 300, 40_000):
        if isinstance(x, int):
            w.code(main, x)
            continue
        d, n = x
        if last and last[0] == d and n >= 2:
            w.code(main, 258)
            slot, k, rest = span(n, 2)
            w.code(again, slot), w.put(rest, k)
        else:
            slot, k, rest = span(n - (d > 0x100) - (d > 0x2000), 2)
            w.code(main, 262 + slot), w.put(rest, k)
            slot, k, rest = far5(d)
            w.code(far, slot)
            if k >= 4:
                w.put(rest >> 4, k - 4), w.code(low, rest & 15)
            else:
                w.put(rest, k)
        last = x
    body = w.done()
    flags = 0x80 | (0x40 if final else 0) | 1 << 3 | (len(w.bits) - 1) % 8
    size = struct.pack("<H", len(body))
    return bytes([flags, 0x5A ^ flags ^ size[0] ^ size[1]]) + size + body


def test_rar5():
    assert rar.Rar5().decode(rar5_block(TEXT), len(TEXT)) == TEXT
    run = _Run(rar.Rar5)
    a, b = (run.add(lambda _, d=d: d, n) for d, n in ((rar5_block(TEXT), len(TEXT)), (rar5_block(b"tail " * 40), 200)))
    assert b(None) == b"tail " * 40 and a(None) == TEXT
    told = bytes((TEXT[i - 2] if i > 1 else 0) - TEXT[i] & 255 for i in range(400))
    packed = told[::2] + told[1::2] + TEXT[400:]
    assert rar.Rar5().decode(rar5_block(packed, filters=[(0, 400, 0, 2)]), len(TEXT)) == TEXT
    code = b"\x90" * 20 + b"\xe8" + struct.pack("<I", 500 + 21) + b"\x90" * 20
    assert rar.Rar5().decode(rar5_block(code, filters=[(0, len(code), 1, 0)]), len(code))[21:25] == struct.pack("<I", 500)


def test_rar3():
    w = Writer()
    w.put(0, 2)
    main, far, low, again = coded_lengths(w, ((299, 9), (60, 6), (17, 5), (28, 5)))
    for x in parsed(TEXT, 4, 250, 200):
        if isinstance(x, int):
            w.code(main, x)
            continue
        slot, k, rest = span(x[1], 3)
        w.code(main, 271 + slot), w.put(rest, k)
        slot = max(i for i, (base, _) in enumerate(rar._FAR) if base < x[0])
        base, k = rar._FAR[slot]
        w.code(far, slot)
        rest = x[0] - 1 - base
        if slot > 9:
            if k > 4:
                w.put(rest >> 4, k - 4)
            w.code(low, rest & 15)
        else:
            w.put(rest, k)
    w.code(main, 256), w.put(0, 1), w.put(1, 1)
    assert rar.Rar3().decode(w.done(), len(TEXT)) == TEXT


def vint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def rar5_header(fields, data=b"", flags=0):
    body = vint(fields[0]) + vint(flags | (2 if data else 0)) + (vint(len(data)) if data else b"") + b"".join(vint(f) if isinstance(f, int) else f for f in fields[1:])
    body = vint(len(body)) + body
    return struct.pack("<I", zlib.crc32(body)) + body + data


def test_rar5_archive_over_volumes():
    packed = rar5_block(TEXT)
    mark, main, end = b"Rar!\x1a\7\1\0", rar5_header([1, 0]), rar5_header([5, 0])
    file = lambda data, flags: rar5_header([2, 4, len(TEXT), 0o100644, struct.pack("<I", zlib.crc32(TEXT)), 3 << 7, 1, 5, b"a.txt"], data, flags)
    whole = mark + main + file(packed, 0) + end
    (row,) = rows_of(Source(whole), "a.rar", Options(content=True, test=True))
    assert (row["name"], row["content"], row["status"]) == ("a.txt", TEXT, "ok")
    first, second = mark + main + file(packed[:300], 16) + end, mark + main + file(packed[300:], 8) + end
    (row,) = rows_of(Joined([Source(first), Source(second)]), "a.part1.rar", Options(content=True, test=True))
    assert (row["content"], row["status"], row["compressed_size"]) == (TEXT, "ok", len(packed))
    (row,) = rows_of(Source(first), "a.part1.rar", Options(content=True, test=True))
    assert row["status"] == "unsupported" and row["is_corrupted"]


def test_rar_ciphers():
    key, sums = rar.rar5_key(b"secret", bytes(16), 4, None)
    assert len(key) == len(sums) == 32 and key != sums
    assert rar.rar5_checksum(5, sums) != rar.rar5_checksum(6, sums)
    assert len(rar.rar3_plain(bytes(32), "secret", bytes(8))) == 32


def test_arj_fastest():
    w = Writer()

    def number(v, first, most):
        width, plus = first, 0
        while width < most and v >= plus + (1 << width):
            w.put(1, 1)
            plus += 1 << width
            width += 1
        if width < most:
            w.put(0, 1)
        w.put(v - plus, width)

    for x in parsed(TEXT, 3, 200, 8000):
        if isinstance(x, int):
            number(0, 0, 7), w.put(x, 8)
        else:
            number(x[1] - 2, 0, 7), number(x[0] - 1, 9, 13)
    assert codecs.arj_fastest(w.done(), len(TEXT)) == TEXT


def test_lzx_plain_and_verbatim_blocks():
    w = Writer()
    w.put(0, 1)
    w.put(3, 3), w.put(10, 24)
    w.put(0, -len(w.bits) % 16 or 16)
    words = w.done()
    swap = lambda d: b"".join(d[i + 1 : i + 2] + d[i : i + 1] for i in range(0, len(d), 2))
    plain = swap(words) + struct.pack("<III", 1, 1, 1) + b"0123456789"
    assert codecs.lzx(plain, 10, 15) == b"0123456789"
    w = Writer()
    w.put(0, 1), w.put(1, 3), w.put(40, 24)
    pre = Prefix([5] * 20)

    def tree(n, size):
        for _ in range(20):
            w.put(5, 4)
        for _ in range(n):
            w.code(pre, (0 - size) % 17)

    tree(256, 9), tree(240, 9), tree(249, 8)
    main, lengths = Prefix([9] * 496), Prefix([8] * 249)
    for b in b"abcd":
        w.code(main, b)
    w.code(main, 256 + 8 * 4 + 7), w.code(lengths, 36 - 9), w.put(0, 1)  # distance 4 + 0 - 2 = 2, length 36
    data = w.done()
    assert codecs.lzx(swap(data + b"\0" * (len(data) % 2)), 40, 15) == b"abcd" + b"cd" * 18


@pytest.mark.parametrize("seed", range(30))
def test_noise_ends_in_an_error_or_in_bytes(seed):
    data = random.Random(seed).randbytes(400)
    size = 3000
    known = (Damaged, TooLarge, Unsupported, IndexError, ValueError, KeyError, struct.error, StopIteration, RuntimeError)
    for run in (
        lambda: codecs.shrink(data, size), lambda: codecs.implode(data, size, 6), lambda: codecs.bcj2(data, data, data, data, size), lambda: codecs.lzx(data, size, 17),
        lambda: codecs.quantum([data], [size], 18), lambda: codecs.lh1(data, size), lambda: codecs.arj_fastest(data, size), lambda: codecs.arc_crunch(data, False), lambda: codecs.arc_crunch(data, True),
        lambda: codecs.amiga_lzx(data, size), lambda: codecs.arsenic(data, size)[0], lambda: ppmd.seven_zip(b"\0" + data, 6, 1 << 22, size), lambda: rar.Rar3().decode(data, size), lambda: rar.Rar3().decode(b"\xa5\1" + data, size), lambda: rar.Rar5().decode(data, size),
    ):
        try:
            assert isinstance(run(), bytes)
        except known:
            pass


def test_sums_and_bits():
    data = bytes(range(50)) * 3
    told = bytes(data[i] - (data[i - 3] if i > 2 else 0) & 255 for i in range(len(data)))
    assert _summed(told, 3) == data
    bits = Bits(b"\xf0\x0f\xaa", low_first=True)
    assert (bits.peek(4), bits.read(4), bits.read(4), bits.place()) == (0, 0, 15, 1)
    bits.read(3)
    bits.align()
    assert bits.read(8) == 0xAA


def test_rar2():
    w = Writer()
    w.put(0, 2)
    for _ in range(19):
        w.put(5, 4)
    code = Prefix([5] * 19)
    sizes = ((298, 9), (48, 6), (28, 5))
    for count, size in sizes:
        for _ in range(count):
            w.code(code, size)
    main, far, again = (Prefix([size] * count) for count, size in sizes)
    last = None
    for x in parsed(TEXT, 4, 250, 4000):
        if isinstance(x, int):
            w.code(main, x)
            continue
        d, n = x
        if last == d and d < 0x101:
            slot, k, rest = span(n, 2)
            w.code(main, 257), w.code(again, slot), w.put(rest, k)
        else:
            slot, k, rest = span(n, 3)
            w.code(main, 270 + slot), w.put(rest, k)
            slot = max(i for i, (base, _) in enumerate(rar._FAR[:48]) if base < d)
            base, k = rar._FAR[slot]
            w.code(far, slot), w.put(d - 1 - base, k)
        last = d
    assert rar.Rar2().decode(w.done(), len(TEXT)) == TEXT


def test_compact_pro():
    plain = b"\x81\x82" + b"a" * 30 + b"\x81\x81b" + b"\x81"
    told = b"\x81\x82\x00" + b"a\x81\x82\x1e" + b"\x81\x81" + b"\x62" + b"\x81"
    assert codecs.compact_rle(told)[:2] == b"\x81\x82" and codecs.compact_rle(b"a\x81\x82\x1e") == b"a" * 30
    assert codecs.compact_rle(b"\x81\x81\x82\x05") == b"\x81" * 5 and plain
    w = Writer()
    for count, size in ((256, 8), (64, 6), (128, 7)):
        w.put(count // 2, 8)
        for _ in range(count):
            w.put(size, 4)
    literal, length, far = Prefix([8] * 256), Prefix([6] * 64), Prefix([7] * 128)
    data = b"plain text without marks, plain text without marks"
    for x in parsed(data, 3, 63, 8000):
        if isinstance(x, int):
            w.put(1, 1), w.code(literal, x)
        else:
            w.put(0, 1), w.code(length, x[1]), w.code(far, x[0] >> 6), w.put(x[0] & 63, 6)
    packed = w.done()
    assert codecs.compact_lzh(packed, len(data)) == data
    record = bytes([5]) + b"a.txt" + b"\1" + struct.pack(">I8sIIHIHIIII", 8, b"TEXTlade", 0, 0, 0, zlib.crc32(data), 4, 0, len(data), 0, len(packed))
    folder = bytes([0x81]) + b"d" + struct.pack(">H", 1)
    whole = b"\1\1\0\0" + struct.pack(">I", 8 + len(packed)) + packed + bytes(4) + struct.pack(">HB", 2, 0) + folder + record
    rows = list(rows_of(Source(whole), "x.cpt", Options(content=True, test=True)))
    assert [(r["name"], r["content"], r["status"]) for r in rows] == [("d", None, "not_tested"), ("d/a.txt", data, "ok")]


def test_sources_with_ranges():
    from lading.sources.source import Sparse, Without

    s = Without(Source(bytes(range(30))), [(5, 10), (20, 25)])
    assert (s.size, s.at(3, 4), s.at(13, 5)) == (20, bytes([3, 4, 10, 11]), bytes([18, 19, 25, 26, 27]))
    s = Sparse(Source(b"abcdef"), [(2, 3), (10, 3)], 15)
    assert s.at(0, 15) == b"\0\0abc" + bytes(5) + b"def\0\0" and s.at(3, 8) == b"bc" + bytes(5) + b"d"


def test_filters_of_streams():
    import base64

    from lading.functions import filters

    assert filters.ascii85(base64.a85encode(TEXT) + b"~>") == TEXT and filters.ascii_hex(TEXT.hex().encode() + b">") == TEXT
    assert filters.run_lengths(b"\x02abc\xfed\x80rest") == b"abcddd"
    w, table, width, word = Writer(), {bytes([i]): i for i in range(256)} | {b"x0": 256, b"x1": 257}, 9, b""
    w.put(256, 9)
    for b in TEXT * 9:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        w.put(table[word], width)
        if len(table) < 4094:
            table[longer] = len(table)
        width = min(12, max(9, len(table).bit_length()))
        word = bytes([b])
    w.put(table[word], width)
    assert filters.lzw(w.done()) [:800] == (TEXT * 9)[:800]
    rows = [bytes((i * 7 + k) & 255 for i in range(9)) for k in range(4)]
    told = b"\0" + rows[0] + b"\2" + bytes(a - b & 255 for a, b in zip(rows[1], rows[0], strict=True)) + b"\1" + bytes(rows[2][i] - (rows[2][i - 3] if i > 2 else 0) & 255 for i in range(9)) + b"\0" + rows[3]
    assert filters.png_rows(told, 3, 3) == b"".join(rows)
    assert filters.tiff_rows(bytes([1, 2, 3, 1, 1, 1]), 2, 3) == bytes([1, 2, 3, 2, 3, 4])
    assert filters.palette_colors(b"\1\0\5", b"\1\2\3\4\5\6") == bytes([4, 5, 6, 1, 2, 3, 0, 0, 0])


def unpng(data):
    at, body = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    return zlib.decompress(body)


def test_pdf_pictures_by_page():
    gray, colors = bytes(range(12)), bytes(range(24))
    jpeg = b"\xff\xd8 some picture \xff\xd9"
    stream = lambda head, body: b"<<" + head + b" /Length %d>>\nstream\n" % len(body) + body + b"\nendstream"
    parts = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[4 0 R 3 0 R]/Count 2>>",
        3: b"<</Type/Page/Parent 2 0 R/Resources<</XObject<</A 5 0 R/B 6 0 R>>>>>>", 4: b"<</Type/Page/Parent 2 0 R/Resources<</XObject<</A 5 0 R/C 7 0 R>>>>>>",
        5: stream(b"/Subtype/Image/Width 4/Height 3/BitsPerComponent 8/ColorSpace/DeviceGray/Filter/FlateDecode", zlib.compress(gray)),
        6: stream(b"/Subtype /Image /Filter /DCTDecode /Width 1 /Height 1", jpeg),
        7: stream(b"/Subtype/Image/Width 2/Height 2/BitsPerComponent 8/ColorSpace[/Indexed/DeviceRGB 1 <0102030a0b0c>]/Filter[/ASCIIHexDecode]", b"00010100>"),
        8: stream(b"/Subtype/Image/Width 4/Height 2/BitsPerComponent 8/ColorSpace/DeviceRGB", colors),
    }
    whole = b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n" % k + v + b"\nendobj" for k, v in parts.items()) + b"\n%%EOF"
    rows = list(rows_of(Source(whole), "x.pdf", Options(content=True)))
    assert [r["name"] for r in rows] == ["Page 1, object 7.png", "Page 2, object 5.png", "Page 2, object 6.jpg", "Object 8.png"]
    assert rows[2]["content"] == jpeg
    assert unpng(rows[1]["content"]) == b"".join(b"\0" + gray[k : k + 4] for k in (0, 4, 8))
    assert unpng(rows[0]["content"]) == b"\0\1\2\3\x0a\x0b\x0c\0\x0a\x0b\x0c\1\2\3"


def test_apple_metadata():
    from lading.sources.formats.apple import extended_attributes, resources

    names = [(b"com.b\0", b"two"), (b"com.a\0", b"one!")]
    index, at = b"", 38 + 36 + sum((11 + len(n) + 3) // 4 * 4 for n, _ in names)
    for name, value in names:
        one = struct.pack(">IIHB", 26 + 12 - 38 + 38 + at - 38, len(value), 0, len(name)) + name
        index += one + bytes(-len(one) % 4)
        at += len(value)
    body = bytes(34) + b"ATTR" + bytes(4) + struct.pack(">III", 0, 0, 0) + bytes(12) + struct.pack(">HH", 0, 2) + index + b"".join(v for _, v in names)
    data = b"\0\5\x16\7\0\2\0\0" + bytes(16) + struct.pack(">H", 1) + struct.pack(">III", 9, 38, len(body)) + body
    shift = data.index(b"two") - struct.unpack_from(">I", data, 38 + 34 + 36)[0]
    fixed = bytearray(data)
    place = 38 + 34 + 36
    for name, _ in names:
        (where,) = struct.unpack_from(">I", fixed, place)
        struct.pack_into(">I", fixed, place, where + shift)
        place += (11 + len(name) + 3) // 4 * 4
    assert extended_attributes(Source(bytes(fixed))) == {"com.a": b"one!", "com.b": b"two"}
    content = struct.pack(">I", 5) + b"hello"
    refs = struct.pack(">hHI", 128, 0, 0) + bytes(4)
    map_ = bytes(24) + struct.pack(">HH", 28, 28 + 2 + 8 + len(refs)) + struct.pack(">H", 0) + struct.pack(">4sHH", b"STR ", 0, 10) + refs + b"\4name"
    fork = struct.pack(">IIII", 16, 16 + len(content), len(content), len(map_)) + content + map_
    assert resources(Source(fork)) == [("STR ", 128, "name", b"hello")]


def test_damaged_records_of_warc_are_left_out():
    record = lambda length, body, date="2020-02-29T12:00:00Z": f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.b/{body}\r\nWARC-Date: {date}\r\nContent-Length: {length}\r\n\r\n".encode() + (b"HTTP/1.1 200 OK\r\n\r\n" + body.encode()) + b"\r\n\r\n"
    data = record(22, "one") + record("many", "two") + record(24, "three", "yesterday")
    rows = [r for r in rows_of(Source(data), "x.warc", Options(content=True)) if not r["is_directory"]]
    assert [(r["name"], r["content"]) for r in rows] == [("a.b/one", b"one"), ("a.b/three", b"three")]


def test_zip_over_volumes():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(4):
            z.writestr(f"{i}.txt", f"text {i} " * 30)
    data = bytearray(out.getvalue())
    cut, at = 300, data.find(b"PK\1\2")
    start = at
    while data[at : at + 4] == b"PK\1\2":
        n, m, c = struct.unpack_from("<HHH", data, at + 28)
        (local,) = struct.unpack_from("<I", data, at + 42)
        if local >= cut:
            struct.pack_into("<H", data, at + 34, 1)
            struct.pack_into("<I", data, at + 42, local - cut)
        at += 46 + n + m + c
    struct.pack_into("<H", data, at + 6, 1)
    struct.pack_into("<I", data, at + 16, start - cut)
    rows = list(rows_of(Joined([Source(bytes(data[:cut])), Source(bytes(data[cut:]))]), "x.z01", Options(content=True, test=True)))
    assert [(r["content"], r["status"]) for r in rows] == [(f"text {i} ".encode() * 30, "ok") for i in range(4)]


def test_command_line(spark, tmp_path, capsys):
    import zipfile

    from lading.__main__ import main

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.txt", "1")
        z.writestr("two.log", "2")
    at = f"file://{tmp_path}/a.zip"
    assert main(["list", at]) == 0 and capsys.readouterr().out.split() == ["d/one.txt", "two.log"]
    assert main(["--files", "*.log", "list", "--json", at]) == 0 and '"name":"two.log"' in capsys.readouterr().out
    assert main(["test", at]) == 0 and capsys.readouterr().out.count("ok") == 2
    assert main(["--indexes", "0", "extract", "-o", f"file://{tmp_path}/out", at]) == 0
    assert [p.name for p in (tmp_path / "out").rglob("*.txt")] == ["one.txt"]
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[39] ^= 1
    (tmp_path / "b.zip").write_bytes(bytes(data))
    assert main(["test", f"file://{tmp_path}/b.zip"]) == 1


def amiga_packed(data):
    """Two blocks: verbatim distances with lengths told in runs, then aligned ones with lengths as they were."""
    w, pre, slots = Writer(low=True), Prefix([5] * 20), codecs._slots(32, 14)
    main, low = Prefix([10] * 768), Prefix([3] * 8)
    items, done, half = list(parsed(data, 3, 200, 60000)), 0, 0
    while done < len(data) // 2:
        done += 1 if isinstance(items[half], int) else items[half][1]
        half += 1

    def told(n, late, first):
        for _ in range(20):
            w.put(5, 4)
        while n and first:
            step = 5 - late
            if n >= step:
                w.code(pre, 19), w.put(1, 1), w.code(pre, 7)
            else:
                step = 1
                w.code(pre, 7)
            n -= step
        for _ in range(n):
            w.code(pre, 0)

    for kind, part, size in ((2, items[:half], done), (3, items[half:], len(data) - done)):
        w.put(kind, 3)
        for _ in range(8 * (kind == 3)):
            w.put(3, 3)
        for b in size.to_bytes(3, "big"):
            w.put(b, 8)
        told(256, 0, kind == 2), told(512, 1, kind == 2)
        last = 1
        for x in part:
            if isinstance(x, int):
                w.code(main, x)
                continue
            far, n = x
            k = 0 if far == last and kind == 2 else max(i for i, (b, _) in enumerate(slots) if b <= far)
            m = max(i for i, (b, _) in enumerate(slots[:16]) if b <= n - 3)
            w.code(main, 256 + 32 * m + k)
            if k:
                rest, more = far - slots[k][0], slots[k][1]
                if kind == 3 and more >= 3:
                    w.put(rest >> 3, more - 3), w.code(low, rest & 7)
                else:
                    w.put(rest, more)
            w.put(n - 3 - slots[m][0], slots[m][1])
            last = far
    out = w.done()
    out += b"\0" * (len(out) % 2)
    return b"".join(out[i + 1 : i + 2] + out[i : i + 1] for i in range(0, len(out), 2))


def test_lzx_of_the_amiga():
    data = TEXT + random.Random(5).randbytes(300) + TEXT[:700]
    body = amiga_packed(data)
    assert codecs.amiga_lzx(body, len(data)) == data
    with pytest.raises(Damaged):
        codecs.amiga_lzx(body[: len(body) // 2], len(data))

    def head(name, data, packed, method, attributes=0, note=b""):
        stamp = 29 << 27 | 1 << 23 | 26 << 17 | 12 << 12 | 34 << 6 | 56
        return struct.pack("<HIIBBHBBHIIIB", attributes, len(data), packed, 10, method, 0, len(note), 10, 0, stamp, zlib.crc32(data), 0, len(name)) + name + note

    whole = b"LZX" + bytes(7) + head(b"d/a", data[:500], 0, 2, 0x0F) + head(b"b", data[500:], len(body), 2, 0, b"note") + body + head(b"c", b"plain", 5, 0, 0x13) + b"plain"
    rows = list(rows_of(Source(whole), "x.lzx", Options(content=True)))
    assert [(r["name"], r["status"], r["content"]) for r in rows] == [("d/a", "ok", data[:500]), ("b", "ok", data[500:]), ("c", "ok", b"plain")]
    assert [r["is_solid"] for r in rows] == [None, True, None] and rows[1]["comment"] == "note" and rows[0]["mtime"].isoformat() == "1996-02-29T12:34:56+00:00"
    assert [dict(r["extras"])["AmigaProtectionBits"] for r in rows] == ["0", "15", str(0x03 | 0x10)]
    broken = rows_of(Source(whole.replace(b"plain", b"plaim")), "x.lzx", Options(test=True))
    assert [r["status"] for r in broken] == ["ok", "ok", "checksum"]


def film(tags, packed):
    body = bytes([2 << 3, 0, 0, 12, 1, 0])[:2] + b"\0\x0c\1\0"
    for kind, data in tags:
        body += struct.pack("<HI", kind << 6 | 63, len(data)) + data if len(data) >= 63 or kind == 20 else struct.pack("<H", kind << 6 | len(data)) + data
    body += b"\0\0"
    return (b"CWS" if packed else b"FWS") + b"\6" + struct.pack("<I", 8 + len(body)) + (zlib.compress(body) if packed else body)


@pytest.mark.parametrize("packed", [False, True])
def test_films(packed):
    segment = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 2, 3, 1) + b"\1\x11\0"
    scan = b"\xff\xda\0\x08\1\1\0\0\x3f\0bits\xff\xd9"
    clean = b"\xff\xd8" + segment + scan
    twice = b"\xff\xd9\xff\xd8\xff\xd8" + segment + b"\xff\xd9\xff\xd8" + scan
    alpha = zlib.compress(bytes(range(6)))
    palette, indexes = bytes([1, 2, 3, 9, 10, 11, 12, 8]), b"\0\1\0\0\1\1\1\0"
    tags = [
        (8, b"\xff\xd8tables\xff\xd9"), (6, b"\1\0\xff\xd8rest"), (1, b""), (21, b"\2\0" + twice), (35, b"\3\0" + struct.pack("<I", len(twice)) + twice + alpha),
        (21, b"\4\0GIF89a...") , (1, b""), (36, b"\5\0" + struct.pack("<BHHB", 3, 3, 2, 1) + zlib.compress(palette + indexes)),
        (20, b"\6\0" + struct.pack("<BHH", 4, 1, 1) + zlib.compress(struct.pack(">H", 31 << 10 | 1) + b"\0\0")), (36, b"\7\0" + struct.pack("<BHH", 5, 1, 1) + zlib.compress(b"\x80\1\2\3")),
        (14, b"\1\0" + bytes([0x3F]) + b"\1\0\0\0wave"), (14, b"\1\0" + bytes([0x2F]) + b"\1\0\0\0mp3"), (14, b"\1\0" + bytes([0x1F]) + b"\1\0\0\0adpcm"),
        (39, b"\1\0\1\0" + struct.pack("<H", 18 << 6 | 4) + b"\0\x20\0\0" + struct.pack("<H", 19 << 6 | 6) + b"....in" + struct.pack("<H", 19 << 6 | 3) + b"ner" + b"\0\0"),
        (45, b"\0\x20\0\0"), (19, b"....ma"), (1, b""), (19, b"....in"),
    ]
    rows = list(rows_of(Source(film(tags, packed)), "x.swf", Options(content=True)))
    got = {r["name"]: r["content"] for r in rows}
    assert list(got) == [
        "Image 1 at frame 0.jpg", "Image 2 at frame 1.jpg", "Image 3 at frame 1.jpg", "Image 3 alpha channel at frame 1.png", "Image 4 at frame 1.gif", "Image 5 at frame 2.png", "Image 6 at frame 2.png",
        "Image 7 at frame 2.png", "Sound 1 at frame 2.wav", "Sound 2 at frame 2.mp3", "Stream 1 at frame 2.mp3", "Stream.mp3",
    ]
    files = list(got.values())
    assert files[0] == b"\xff\xd8tablesrest" and files[1] == files[2] == clean and files[4] == b"GIF89a..."
    assert unpng(files[3]) == b"\0\0\1\2\0\3\4\5"
    assert unpng(files[5]) == b"\0" + palette[:4] + palette[4:] + palette[:4] + b"\0" + palette[4:] * 3
    assert unpng(files[6]) == b"\0\xff\0\x08" and unpng(files[7]) == b"\0\1\2\3\x80"
    assert files[8][:4] == b"RIFF" and files[8][24:28] == struct.pack("<I", 44100) and files[8][-4:] == b"wave"
    assert files[9:] == [b"mp3", b"inner", b"main"]
    assert {r["status"] for r in rows} == {"ok"} and {r["compression"] for r in rows if r["name"].endswith("mp3")} == {"Zlib" if packed else "None"}


class RangeWriter:
    """The encoder for codecs._Ranges: what it holds is a number of 26 bits and as many as were shifted in."""

    def __init__(self):
        self.low, self.range, self.shifts = 0, 1 << 25, 0

    def put(self, weights, symbol):
        k = symbol - weights.first
        unit, below = self.range // weights.total, sum(weights.each[:k])
        self.low += unit * below
        self.range = self.range - unit * below if below + weights.each[k] == weights.total else unit * weights.each[k]
        weights.used(k)
        while self.range <= 1 << 24:
            self.range, self.low, self.shifts = self.range << 1, self.low << 1, self.shifts + 1

    def number(self, weights, value, bits):
        for i in range(bits):
            self.put(weights, value >> i & 1)

    def done(self):
        n = 26 + self.shifts
        return (self.low << -n % 8).to_bytes((n + 7) // 8, "big")


def arsenic_packed(data, disturbed=0):
    w, plain, kinds = RangeWriter(), codecs._Weights(0, 2, 1, 256), codecs._Weights(0, 11, 8, 1024)
    classes = [codecs._Weights(2 << k, 2 << k, step, 1024) for k, step in enumerate((8, 4, 4, 4, 2, 2, 1))]
    for b in b"As":
        w.number(plain, b, 8)
    w.number(plain, 1, 4)
    w.put(plain, 0 if data else 1)
    parts = [data[k : k + 700] for k in range(0, len(data), 700)]
    for n, part in enumerate(parts):
        runs, k = bytearray(), 0
        while k < len(part):
            same = 1
            while same < 259 and k + same < len(part) and part[k + same] == part[k]:
                same += 1
            # zeros that begin a block count as seen, but none of a run yet
            runs += part[k : k + 1] * min(same, 4) + (bytes([same - 4]) if same >= 4 else b"")
            k += same
        runs = bytes(runs)
        rows = sorted(range(len(runs)), key=lambda i: runs[i:] + runs[:i])
        w.put(plain, disturbed)
        w.number(plain, rows.index(0), 10)
        order, zeros = list(range(256)), 0

        def flush():
            nonlocal zeros
            while zeros:
                w.put(kinds, (zeros - 1) % 2)
                zeros = (zeros - 1) // 2

        for i in rows:
            at = order.index(runs[i - 1])
            order.insert(0, order.pop(at))
            if not at:
                zeros += 1
                continue
            flush()
            if at == 1:
                w.put(kinds, 2)
            else:
                w.put(kinds, at.bit_length() + 1), w.put(classes[at.bit_length() - 2], at)
        flush()
        w.put(kinds, 10)
        for x in (kinds, *classes):
            x.reset()
        w.put(plain, n == len(parts) - 1)
    if data:
        w.number(plain, zlib.crc32(data), 32)
    return w.done()


def test_arsenic():
    data = TEXT + b"\0" * 9 + b"z" * 700 + bytes(3) + random.Random(3).randbytes(500)
    assert codecs.arsenic(arsenic_packed(data), len(data)) == (data, zlib.crc32(data))
    assert codecs.arsenic(arsenic_packed(b""), 0) == (b"", 0)
    with pytest.raises(Unsupported):
        codecs.arsenic(arsenic_packed(data, 1), len(data))
    with pytest.raises(Damaged):
        codecs.arsenic(arsenic_packed(data), len(data) - 1)


def test_stuffit_5():
    password = hashlib.md5(b"secret").digest()[:5]

    def entry(title, above, data, resource=b"", method=0, kind=0, note=b"", key=b"", packed=None, many=None):
        packed = data if packed is None else packed
        head = 48 + len(key) + len(title) + (4 + len(note) if note else 0)
        tail = struct.pack(">H", many) if many is not None else bytes([method, len(key)])
        out = struct.pack(">IBxHxBIIIIIHHIIHxx", 0xA5A5A5A5, 1, head, kind, 3_000_000_000, 3_000_000_001, 0, 0, above, len(title), 0, len(data), len(packed), crc16(data)) + tail + key + title
        out += (struct.pack(">HH", len(note), 0) + note if note else b"") + struct.pack(">HH4s4sH22x", bool(resource), 0, b"TEXT", b"ttxt", 256)
        if resource:
            out += struct.pack(">IIHxxBB", len(resource), len(resource), crc16(resource), 0, 0)
        return out + resource + packed

    def archive(prefix=b""):
        lead = b"StuffIt (c)1997-1998 Aladdin Systems, Inc., http://www.aladdinsys.com/StuffIt/\r\n\0\0"
        parts = [entry(b"folder", 0, b"", kind=0x40, many=2)]
        parts.append(entry(b"in", 106, TEXT, b"fork", note=b"said"))
        parts.append(struct.pack(">IBxHxBIIIIIHHIIHxx", 0xA5A5A5A5, 1, 48, 0x40, 0, 0, 0, 0, 106, 0, 0, 0xFFFFFFFF, 0, 0) + b"\0\0")
        parts.append(entry(b"sorted", 106, TEXT, method=15, packed=arsenic_packed(TEXT)))
        parts.append(entry(b"locked", 0, b"hidden", kind=0x20, key=b"12345", packed=rc4(b"hidden", password + b"12345")))
        head = struct.pack(">BBIIHIH", 5, 0x80, 0, 0, 2, 106, 0) + bytes([5]) + hashlib.md5(password).digest()[:5]
        return prefix + lead + head + b"".join(parts)

    whole = archive()
    rows = list(rows_of(Source(whole), "x.sit", Options(content=True)))
    assert [(r["name"], r["is_resource_fork"], r["status"], r["content"]) for r in rows] == [
        ("folder", None, "not_tested", None), ("folder/in", None, "ok", TEXT), ("folder/in", True, "ok", b"fork"), ("folder/sorted", None, "ok", TEXT), ("locked", None, "password", None),
    ]
    assert rows[1]["comment"] == "said" and dict(rows[1]["extras"])["FileType"] == "TEXT" and rows[3]["compression"] == "Arsenic" and rows[0]["archive_status"] is None
    assert [r["content"] for r in rows_of(Source(whole), "x.sit", Options(content=True, password="secret"))][-1] == b"hidden"
    exe = archive(b"MZ".ljust(4100, b"\0") + b"\x42\x03\xe8\x53" + bytes(0x1A000 - 4104))
    assert [(r["format"], r["name"]) for r in rows_of(Source(exe), "x.exe", Options())][1] == ("StuffIt 5 (self-extracting)", "folder/in")
    changed = [r["status"] for r in rows_of(Source(whole.replace(b"fork", b"fark")), "x.sit", Options(test=True))]
    assert changed == ["not_tested", "ok", "checksum", "ok", "password"]


def test_crunch_is_listed():
    for head, title, note, inner in ((b"NOTES.TXT [a comment]", "NOTES.TXT", "a comment", None), (b"A.C  ", "A.C", None, None), (b"ALL.LBR", "ALL.LBR", None, True), (b"NAME", "NAME", None, None)):
        for kind, version, method in ((0xFE, 0x1F, "LZW 1.0"), (0xFE, 0x20, "LZW 2.0"), (0xFD, 0x20, "LZHUF 2.0")):
            whole = bytes([0x76, kind]) + head + b"\0" + bytes([0x20, version, 0, 0]) + b"codes" + b"\1\2"
            (row,) = rows_of(Source(whole), "x.czc", Options(test=True))
            assert (row["format"], row["name"], row["comment"], row["is_archive"], row["compression"], row["compressed_size"], row["status"]) == ("Crunch", title, note, inner, method, 5, "unsupported")
    assert [r["archive_status"] for r in rows_of(Source(b"\x76\xfeNAME\0\1\1\0\0"), "x", Options())] == ["unknown_format"]

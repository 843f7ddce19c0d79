"""PPMd variant H: the context model, and the two range coders that 7-Zip and RAR feed it with.

Contexts and states are objects. The model of the format lives in a memory of a given size and starts anew when that is
full; here a model that has certainly outgrown it is refused."""

from __future__ import annotations

from collections.abc import Callable

from .kernels import LIMIT, Damaged, TooLarge, Unsupported

#: Start values of the escape probabilities of contexts with one symbol, and of the escape estimate.
_FIRST_ESCAPES = (0x3CDD, 0x1F3F, 0x59BF, 0x48F3, 0x64A1, 0x5ABC, 0x6632, 0x6051)
_ESCAPE_STEPS = (25, 14, 9, 7, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2, 2)
_MOST, _SCALE = 124, 1 << 14
#: Bytes of a unit of the format's memory: a context, or two states.
_UNIT = 12


def _quantised() -> list[int]:
    """Classes of a number of symbols: each of the first three has its own, then ever more share one."""
    out, level, left = [0, 1, 2], 3, 1
    while len(out) < 256:
        out.append(level)
        left -= 1
        if not left:
            level += 1
            left = level - 2
    return out


_CLASS = _quantised()
_FEW = [0, 2] + [4] * 9 + [6] * 245


class _State:
    __slots__ = ("symbol", "freq", "next")

    def __init__(self, symbol: int, freq: int, next_=None) -> None:
        self.symbol, self.freq, self.next = symbol, freq, next_


class _Context:
    """next of a state is a context, or a place in the text that it will be made from, or None."""

    __slots__ = ("states", "total", "suffix")

    def __init__(self, states: list[_State], total: int, suffix: _Context | None) -> None:
        self.states, self.total, self.suffix = states, total, suffix


class SevenZipCoder:
    def __init__(self, byte: Callable[[], int]) -> None:
        self.byte, self.range, self.code = byte, 0xFFFFFFFF, 0
        if byte():
            raise Damaged("no range coder")
        for _ in range(4):
            self.code = self.code << 8 | byte()

    def threshold(self, total: int) -> int:
        self.range //= total
        return self.code // self.range

    def decode(self, start: int, size: int) -> None:
        self.code -= start * self.range
        self.range *= size
        while self.range < 1 << 24:
            self.code, self.range = (self.code << 8 | self.byte()) & 0xFFFFFFFF, self.range << 8

    def bit(self, zero: int) -> int:
        bound = (self.range >> 14) * zero
        one = self.code >= bound
        if one:
            self.code, self.range = self.code - bound, self.range - bound
        else:
            self.range = bound
        while self.range < 1 << 24:
            self.code, self.range = (self.code << 8 | self.byte()) & 0xFFFFFFFF, self.range << 8
        return int(one)


class RarCoder:
    def __init__(self, byte: Callable[[], int]) -> None:
        self.byte, self.low, self.range, self.code = byte, 0, 0xFFFFFFFF, 0
        for _ in range(4):
            self.code = self.code << 8 | byte()

    def threshold(self, total: int) -> int:
        self.range //= total
        return (self.code - self.low & 0xFFFFFFFF) // self.range

    def decode(self, start: int, size: int) -> None:
        self.low = self.low + start * self.range & 0xFFFFFFFF
        self.range *= size
        while True:
            if (self.low ^ self.low + self.range) & 0xFFFFFFFF >= 1 << 24:
                if self.range >= 1 << 15:
                    break
                self.range = -self.low & 0x7FFF
            self.code = (self.code << 8 | self.byte()) & 0xFFFFFFFF
            self.range, self.low = self.range << 8 & 0xFFFFFFFF, self.low << 8 & 0xFFFFFFFF

    def bit(self, zero: int) -> int:
        if self.threshold(_SCALE) < zero:
            self.decode(0, zero)
            return 0
        self.decode(zero, _SCALE - zero)
        return 1


class Model:
    def __init__(self, order: int, memory: int) -> None:
        self.order, self.memory = order, memory
        self.restart()

    def restart(self) -> None:
        self.fall, self.run0 = self.order, -min(self.order, 12) - 1
        self.run, self.success, self.high, self.escape0 = self.run0, 0, 0, 0
        self.text, self.units = bytearray(), 1 + 128
        self.least = self.most = _Context([_State(i, 1) for i in range(256)], 257, None)
        self.found = self.least.states[0]
        self.one = [[_SCALE - _FIRST_ESCAPES[k % 8] // (i + 2) for k in range(64)] for i in range(128)]
        self.see = [[[(5 * i + 10) << 3, 3, 4] for _ in range(16)] for i in range(25)]

    def symbol(self, coder) -> int:
        """The next byte, or -1 at the model's end mark."""
        context = self.least
        masked: set[int] = set()
        if len(context.states) > 1:
            at, high = coder.threshold(context.total), 0
            for i, s in enumerate(context.states):
                high += s.freq
                if at < high:
                    coder.decode(high - s.freq, s.freq)
                    self.found = s
                    self._hit(i)
                    return s.symbol
            if at >= context.total:
                raise Damaged("beyond the model")
            self.success = 0
            self.high = 8 if self.found.symbol >= 0x40 else 0
            coder.decode(high, context.total - high)
            masked.update(s.symbol for s in context.states)
        else:
            s = context.states[0]
            self.high = 8 if self.found.symbol >= 0x40 else 0
            row = self.one[s.freq - 1]
            at = self.success + _FEW[len(context.suffix.states) - 1] + self.high + (16 if s.symbol >= 0x40 else 0) + (32 if self.run < 0 else 0)
            mean = row[at] + 32 >> 7
            if not coder.bit(row[at]):
                row[at] += 128 - mean
                self.found = s
                s.freq += s.freq < 128
                self.success, self.run = 1, self.run + 1
                self._go_on()
                return s.symbol
            row[at] -= mean
            self.escape0 = _ESCAPE_STEPS[row[at] >> 10]
            masked.add(s.symbol)
            self.success = 0
        while True:
            had = len(self.least.states)
            while len(self.least.states) == had:
                self.fall += 1
                if self.least.suffix is None:
                    return -1
                self.least = self.least.suffix
            context = self.least
            free = [s for s in context.states if s.symbol not in masked]
            see, escape = self._see(had, len(free))
            sums = sum(s.freq for s in free)
            at = coder.threshold(sums + escape)
            if at < sums:
                high = 0
                for s in free:
                    high += s.freq
                    if at < high:
                        break
                coder.decode(high - s.freq, s.freq)
                if see[1] < 7:
                    see[2] -= 1
                    if not see[2]:
                        see[0] <<= 1
                        see[2] = 3 << see[1]
                        see[1] += 1
                self.found = s
                context.total += 4
                s.freq += 4
                if s.freq > _MOST:
                    self._rescale()
                self.run = self.run0
                self._update()
                return s.symbol
            if at >= sums + escape:
                raise Damaged("beyond the model")
            coder.decode(sums, escape)
            see[0] += sums + escape
            masked.update(s.symbol for s in free)

    def _see(self, masked: int, free: int) -> tuple[list[int], int]:
        c = self.least
        n = len(c.states)
        if n == 256:
            return [0, 7, 64], 1
        see = self.see[_CLASS[free - 1]][(free < len(c.suffix.states) - n) + 2 * (c.total < 11 * n) + 4 * (masked > free) + self.high]
        r = see[0] >> see[1]
        see[0] -= r
        return see, r or 1

    def _hit(self, i: int) -> None:
        """The i-th of the context's states was coded without an escape."""
        c, s = self.least, self.found
        if not i:
            self.success = int(2 * s.freq > c.total)
            self.run += self.success
        else:
            self.success = 0
        c.total += 4
        s.freq += 4
        if i and s.freq > c.states[i - 1].freq:
            c.states[i], c.states[i - 1] = c.states[i - 1], s
        if s.freq > _MOST:
            self._rescale()
        self._go_on()

    def _go_on(self) -> None:
        if not self.fall and isinstance(self.found.next, _Context):
            self.least = self.most = self.found.next
        else:
            self._update()

    def _rescale(self) -> None:
        c, s = self.least, self.found
        before = len(c.states)
        c.states.remove(s)
        c.states.insert(0, s)
        escape, adder = c.total - s.freq, int(self.fall != 0)
        s.freq = s.freq + 4 + adder >> 1
        total = s.freq
        for i in range(1, before):
            x = c.states[i]
            escape -= x.freq
            x.freq = x.freq + adder >> 1
            total += x.freq
            j = i
            while j and x.freq > c.states[j - 1].freq:
                j -= 1
            if j < i:
                c.states.insert(j, c.states.pop(i))
        if not c.states[-1].freq:
            kept = [x for x in c.states if x.freq]
            escape += before - len(kept)
            self.units -= (before + 1) // 2 - (len(kept) + 1) // 2
            c.states[:] = kept
            if len(kept) == 1:
                one = kept[0]
                while True:
                    one.freq -= one.freq >> 1
                    escape >>= 1
                    if escape <= 1:
                        break
                self.units -= 1
                self.found = one
                return
        c.total = total + escape - (escape >> 1)
        self.found = c.states[0]

    def _made(self, skip: bool) -> _Context:
        """The contexts that follow the found state, made from the text where they aren't there yet."""
        c, start, own = self.least, self.found.next, []
        if not skip:
            own.append(self.found)
        while c.suffix is not None:
            c = c.suffix
            s = next(x for x in c.states if x.symbol == self.found.symbol)
            if s.next is not start and s.next != start:
                c = s.next
                if not own:
                    return c
                break
            own.append(s)
        symbol, after = self.text[start], start + 1
        if len(c.states) == 1:
            freq = c.states[0].freq
        else:
            cf = next(x for x in c.states if x.symbol == symbol).freq - 1
            s0 = c.total - len(c.states) - cf
            freq = 1 + (int(5 * cf > s0) if 2 * cf <= s0 else (2 * cf + 3 * s0 - 1) // (2 * s0))
        for s in reversed(own):
            c = _Context([_State(symbol, freq, after)], 0, c)
            self.units += 1
            s.next = c
        return c

    def _update(self) -> None:
        found, least = self.found, self.least
        if found.freq < _MOST // 4 and least.suffix is not None:
            c = least.suffix
            if len(c.states) == 1:
                c.states[0].freq += c.states[0].freq < 32
            else:
                i = next(k for k, x in enumerate(c.states) if x.symbol == found.symbol)
                s = c.states[i]
                if i and s.freq >= c.states[i - 1].freq:
                    c.states[i], c.states[i - 1] = c.states[i - 1], s
                if s.freq < _MOST - 9:
                    s.freq += 2
                    c.total += 2
        if not self.fall:
            self.least = self.most = found.next = self._made(True)
            return
        self.text.append(found.symbol)
        after: object = len(self.text)
        if self.units * _UNIT + len(self.text) > self.memory:
            raise Unsupported("a PPMd model that outgrows its memory")
        if found.next is not None:
            target = found.next if isinstance(found.next, _Context) else self._made(False)
            self.fall -= 1
            if not self.fall:
                after = target
                if self.most is not least:
                    del self.text[-1:]
        else:
            found.next = after
            target = least
        n = len(least.states)
        s0 = least.total - n - (found.freq - 1) if n > 1 else 0
        c = self.most
        while c is not least:
            m = len(c.states)
            if m > 1:
                if not m % 2:
                    self.units += 1
                c.total += (2 * m < n) + 2 * ((4 * m <= n) & (c.total <= 8 * m))
            else:
                one = c.states[0]
                one.freq = one.freq * 2 if one.freq < _MOST // 4 - 1 else _MOST - 4
                c.total = one.freq + self.escape0 + (n > 3)
                self.units += 1
            cf, sf = 2 * found.freq * (c.total + 6), s0 + c.total
            if cf < 6 * sf:
                cf = 1 + (cf > sf) + (cf >= 4 * sf)
                c.total += 3
            else:
                cf = 4 + (cf >= 9 * sf) + (cf >= 12 * sf) + (cf >= 15 * sf)
                c.total += cf
            c.states.append(_State(found.symbol, cf, after))
            c = c.suffix
        self.most = self.least = target


def reader(data: bytes, at: int = 0) -> Callable[[], int]:
    """A function that gives the next byte, zeros for a while behind the end."""
    left = [at]

    def byte() -> int:
        left[0] += 1
        if left[0] > len(data) + 16:
            raise Damaged("data end too soon")
        return data[left[0] - 1] if left[0] <= len(data) else 0

    return byte


def seven_zip(data: bytes, order: int, memory: int, size: int) -> bytes:
    """PPMd of 7-Zip."""
    if size > LIMIT.get():
        raise TooLarge("too many bytes come out")
    model, coder, out = Model(order, memory), SevenZipCoder(reader(data)), bytearray()
    while len(out) < size:
        s = model.symbol(coder)
        if s < 0:
            raise Damaged("data end too soon")
        out.append(s)
    return bytes(out)

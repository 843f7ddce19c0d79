"""Names as bytes: encodings, their guess, escapes, and text helpers for listings."""

from __future__ import annotations

import codecs
import pkgutil
from collections.abc import Iterator
from encodings import aliases

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings that a guess tries, in this order if they fit alike.
CANDIDATES = ("utf-8", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr", "windows-1251", "koi8-r", "mac-roman", "windows-1252")


def escaped(raw: bytes) -> str:
    """ASCII as it is, other bytes as % and two hex digits."""
    return "".join(chr(b) if b < 128 else f"%{b:02x}" for b in raw)


def decode(raw: bytes, encoding: str) -> str:
    """Text of raw, escaped() where the encoding doesn't fit."""
    try:
        return raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return escaped(raw)


def decodes(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def decoded(raw: Column, encoding: str) -> Column:
    """decode() of binary names; Spark's own decode() knows only a few encodings."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda r: None if r is None else decode(bytes(r), encoding))

    return run(raw)


def can_decode(raw: Column, encoding: str) -> Column:
    @F.pandas_udf("boolean")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda r: None if r is None else decodes(bytes(r), encoding)).astype("boolean")

    return run(raw)


def split_raw(raw: bytes, encoding: str, separators: bytes = b"/\\") -> list[str]:
    """Parts between separator bytes. A separator counts only if what comes before it decodes: the second byte of a
    Shift-JIS character may be a backslash."""
    parts, start = [], 0
    for i, b in enumerate(raw):
        if b in separators and decodes(raw[start:i], encoding):
            parts.append(raw[start:i])
            start = i + 1
    parts.append(raw[start:])
    out = [decode(p, encoding) for p in parts if p]
    return ["/", *out] if raw[:1] and raw[0] in separators else out


def ascii_escaped(text: Column) -> Column:
    """Characters beyond ASCII as %u and four hex digits, beyond 16 bits as those of two surrogates."""
    four = lambda n: F.lpad(F.lower(F.hex(n)), 4, "0")
    code = lambda c: F.ascii(c).cast("bigint")
    wide = lambda c: F.concat(F.lit("%u"), four(F.lit(0xD800) + F.shiftright(code(c) - 0x10000, 10)), F.lit("%u"), four(F.lit(0xDC00) + (code(c) - 0x10000).bitwiseAND(F.lit(1023))))
    one = lambda c: F.when(c.rlike(r"^[\x00-\x7F]?$"), c).when(code(c) > 0xFFFF, wide(c)).otherwise(F.concat(F.lit("%u"), four(code(c))))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most so many characters, cut at blanks; longer words are cut."""
    return F.rtrim(F.regexp_replace(text, rf"(?s)(.{{1,{width}}})(?:[ ]+|$)|(.{{{width}}})", "$1$2\n"), F.lit("\n"))


def indented(text: Column, by: int) -> Column:
    return F.regexp_replace(text, r"(?m)^", " " * by)


def parsed_number(text: Column) -> Column:
    """A number written in decimal, in octal after 0, or in hexadecimal after 0x; null for other texts."""
    low = F.lower(F.trim(text))
    return (
        F.when(low.rlike(r"^0x[0-9a-f]{1,15}$"), F.conv(F.substring(low, 3, 20), 16, 10))
        .when(low.rlike(r"^0[0-7]{1,20}$"), F.conv(low, 8, 10))
        .when(low.rlike(r"^[0-9]{1,18}$"), low)
        .cast("bigint")
    )


def encodings(spark) -> DataFrame:
    """encoding and aliases (comma-joined) of all encodings of text that the engine can decode."""
    import encodings as package

    names = sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name not in ("aliases", "undefined", "idna", "punycode", "mbcs", "oem"))
    known = []
    for name in names:
        try:
            if codecs.lookup(name)._is_text_encoding:
                known.append((name, ",".join(sorted(a for a, t in aliases.aliases.items() if t == name))))
        except LookupError:
            continue
    return spark.createDataFrame(known, "encoding string, aliases string")


def _likely(raw: bytes, encoding: str) -> float:
    """How likely a name beyond ASCII is of an encoding: the share of letters among its characters beyond ASCII, a small
    one if it has control characters or letters of mixed scripts' case."""
    try:
        text = raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return 0.0
    wide = [c for c in text if ord(c) > 127]
    if not wide:
        return 0.0
    if any(ord(c) < 160 for c in wide):
        return 0.01
    odd = sum(1 for a, b in zip(text, text[1:], strict=False) if a.islower() and b.isupper())
    return sum(c.isalpha() for c in wide) / len(wide) / (1 + odd)


def guessed_encodings(names: DataFrame, archive: str = "archive", raw: str = "name_raw") -> DataFrame:
    """archive, encoding and confidence from all names of each archive (a grouped fold, combined before the shuffle).

    Names in ASCII alone give "ascii" and 1. Else confidence is the mean likelihood of the best candidate over the names
    beyond ASCII; UTF-8 that fits all of them is certain. Null names don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, list] = {}
            for where, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is None:
                    continue
                if name.isascii():
                    total.setdefault((where, "ascii"), [0, 0.0])[0] += 1
                    continue
                for e in CANDIDATES:
                    held = total.setdefault((where, e), [0, 0.0])
                    held[0] += 1
                    held[1] += 1.0 if e == "utf-8" and decodes(name, e) else _likely(name, e)
            rows = [{"archive": a, "encoding": e, "n": n, "s": s} for (a, e), (n, s) in total.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("archive", pa.string()), ("encoding", pa.string()), ("n", pa.int64()), ("s", pa.float64())]))

    counts = names.select(F.col(archive).cast("string").alias("archive"), raw).mapInArrow(run, "archive string, encoding string, n long, s double")
    sums = counts.groupBy("archive", "encoding").agg((F.sum("s") / F.sum("n")).alias("share"))
    rank = F.array_position(F.array(*map(F.lit, CANDIDATES)), F.col("encoding"))
    best = F.max_by(F.struct("encoding", "share"), F.struct(F.col("encoding") != "ascii", "share", -rank)).alias("b")
    return sums.groupBy("archive").agg(best).select("archive", F.col("b.encoding").alias("encoding"), F.when(F.col("b.encoding") == "ascii", 1.0).otherwise(F.col("b.share")).alias("confidence"))

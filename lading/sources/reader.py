"""Archives to rows: one row an entry, with content and verdict on request, archives in archives to a bounded depth."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import LIMIT, Damaged, TooLarge, Unsupported, WrongPassword
from .detect import HEADER, detect
from .formats.entry import Corrupt, Entry, text
from .source import Guarded, Slice, Source

PARSERS = {
    "zips": {"zip": "parse"}, "tar": {"tar": "parse"}, "sevenzip": {"sevenzip": "parse"},
    "streams": {k: k for k in ("gzip", "bzip2", "xz", "lzma_alone", "compress", "squeezed", "crunched")},
    "unix": {k: k for k in ("ar", "cpio", "rpm", "xar", "sar", "nsa", "lbr", "split", "warc", "iso")},
    "mac": {k: k for k in ("macbinary", "applesingle", "binhex", "packit", "stuffit", "stuffit5", "compact_pro")},
    "documents": {"pdf": "pdf"}, "flash": {"swf": "swf"}, "amiga": {"amiga_lzx": "amiga_lzx"},
    "dos": {k: k for k in ("lha", "arc", "zoo", "arj", "cab", "alzip", "rar", "rar5", "nds", "cfbf", "ppmd", "powerpacker")},
}
_WHERE = {name: (module, function) for module, own in PARSERS.items() for name, function in own.items()}

#: Columns of an entry. Null is unknown, unlike false and zero.
ENTRIES = (
    "archive string, format string, archive_status string, level int, idx int, name string, path array<string>, name_raw binary, encoding string, "
    "file_size bigint, compressed_size bigint, compression string, is_directory boolean, is_resource_fork boolean, is_archive boolean, is_hidden boolean, "
    "is_link boolean, is_hard_link boolean, link_destination string, is_character_device boolean, is_block_device boolean, is_fifo boolean, "
    "is_encrypted boolean, is_corrupted boolean, mtime timestamp, atime timestamp, created timestamp, posix_permissions int, uid bigint, gid bigint, "
    "user_name string, group_name string, dos_attributes int, comment string, data_offset bigint, is_solid boolean, first_solid_idx int, next_solid_idx int, "
    "solid_offset bigint, extras map<string,string>, status string, content binary"
)


@dataclass(frozen=True)
class Options:
    """content: fill that column. test: read each entry and tell how it went in status. depth: levels of archives in
    archives that are opened instead of listed. most_bytes: larger contents aren't read (status too_large), also if their
    size shows only while they are. most_entries: an archive with more ends there (archive_status too_many). keep: which rows
    are wanted, told before their content is read; others are left out. until: the archive ends after the first row for
    which it is true (archive_status stopped)."""

    content: bool = False
    test: bool = False
    depth: int = 0
    password: str | None = None
    encoding: str | None = None
    most_bytes: int = 1 << 30
    most_entries: int = 5_000_000
    keep: Callable[[dict[str, Any]], bool] | None = None
    until: Callable[[dict[str, Any]], bool] | None = None


#: Rows, and bytes of their contents, that a batch of entries has before it is handed on.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 22

_BLANK = {f.split()[0]: None for f in re.split(r", (?=[a-z_]+ )", ENTRIES)}


def _parser(name: str):
    module, function = _WHERE[name]
    return getattr(import_module(f"lading.sources.formats.{module}"), function)


def _verdict(e: Entry, options: Options) -> tuple[str | None, bytes | None]:
    if e.directory or e.link is not None or (e.decode is None and e.size in (0, None) and not e.corrupted):
        return "not_tested", None
    if e.decode is None:
        return "unsupported", None
    if (e.size or 0) > options.most_bytes:
        return "too_large", None
    LIMIT.set(options.most_bytes)
    try:
        data = e.decode(options.password.encode() if options.password is not None else None)
    except TooLarge:
        return "too_large", None
    except WrongPassword:
        return "password", None
    except Unsupported:
        return "unsupported", None
    except (Damaged, Corrupt, ValueError, IndexError, KeyError, OverflowError, EOFError, OSError, RecursionError):
        return "damaged", None
    if e.corrupted:
        return "damaged", data
    if e.check is not None:
        return ("ok" if e.check(data) else "checksum"), data
    return ("ok" if e.size is None or e.size == len(data) else "damaged"), data


def _row(e: Entry, archive: str, form: str, level: int, idx: int, options: Options) -> dict[str, Any]:
    name, encoding = text(e.name, options.encoding or e.encoding)
    for s in e.separators[1:]:
        name = name.replace(s, e.separators[0])
    parts = [p for p in name.split(e.separators[0] or "/") if p] if e.separators else [name]
    if e.separators and name.startswith(e.separators[0]):
        parts = ["/", *parts]
    kind = e.mode & 0xF000 if e.mode is not None else None
    known = lambda flag: True if flag else None
    return {
        "archive": archive, "format": form, "archive_status": None, "level": level, "idx": idx, "name": "/".join(p for p in parts if p != "/") if e.separators else name, "path": parts, "name_raw": e.name if isinstance(e.name, bytes) else e.name.encode("utf-8", "surrogatepass"), "encoding": encoding,
        "file_size": e.size, "compressed_size": e.packed, "compression": e.method, "is_directory": e.directory, "is_resource_fork": e.fork, "is_archive": e.archive, "is_hidden": known(e.dos is not None and e.dos & 2),
        "is_link": known(e.link is not None or kind == 0xA000), "is_hard_link": e.hard_link, "link_destination": e.link, "is_character_device": known(kind == 0x2000), "is_block_device": known(kind == 0x6000), "is_fifo": known(kind == 0x1000),
        "is_encrypted": e.encrypted, "is_corrupted": e.corrupted, "mtime": e.modified, "atime": e.accessed, "created": e.created, "posix_permissions": None if e.mode is None else e.mode & 0xFFFF, "uid": e.uid, "gid": e.gid,
        "user_name": e.user, "group_name": e.group, "dos_attributes": e.dos, "comment": e.comment, "data_offset": e.offset, "is_solid": None, "first_solid_idx": None, "next_solid_idx": None,
        "solid_offset": e.solid_offset, "extras": list(e.extras.items()), "status": None, "content": None,
    }


def rows_of(src: Source, archive: str, options: Options, level: int = 0) -> Iterator[dict[str, Any]]:
    """The rows of one archive. Damage stops it, with the rows so far; its last row, or one without an index if there is
    none, tells in archive_status."""
    if not level:
        src = Guarded(src)
    found = detect(src.at(0, HEADER), archive)
    blank = _BLANK | {"archive": archive, "level": level}
    if found is None:
        yield blank | {"archive_status": "unknown_format"}
        return
    form, at = found
    if not form.parser:
        yield blank | {"format": form.name, "archive_status": "unsupported"}
        return
    idx, status, held, first = 0, "ok", [], None
    entries = _parser(form.parser)(Slice(src, at) if form.parser in ("lha", "cab") and at else src, archive, 0 if form.parser in ("lha", "cab") else at)
    run: tuple | None = None
    while True:
        try:
            e = next(entries)
        except StopIteration:
            break
        except Unsupported:
            status = "unsupported"
            break
        except (Corrupt, Damaged, ValueError, IndexError, KeyError, OverflowError, UnicodeError, RecursionError, EOFError):
            status = "damaged"
            break
        if idx >= options.most_entries:
            status = "too_many"
            break
        row = _row(e, archive, form.name, level, idx, options)
        data, stop = None, bool(options.until and options.until(row))
        if options.keep and not options.keep(row):
            idx += 1
            if stop:
                status = "stopped"
                break
            continue
        inner = bool(e.archive) and level < options.depth
        if options.test or options.content or inner:
            row["status"], data = _verdict(e, options)
            row["content"] = data if options.content else None
        if e.solid is not None and run is not None and run[0] == e.solid:
            row["is_solid"], row["first_solid_idx"] = True, first
            run[1]["next_solid_idx"] = idx
        elif e.solid is not None:
            first = idx
        run = (e.solid, row) if e.solid is not None else None
        if held:
            yield held.pop()
        held = [row]
        idx += 1
        if stop:
            status = "stopped"
            break
        if inner and data is not None:
            yield held.pop()
            run = None
            yield from rows_of(Source(data), f"{archive}!{row['name']}", options, level + 1)
    if held:
        yield held.pop() | ({"archive_status": status} if status != "ok" else {})
    elif not idx or status != "ok":
        yield blank | {"format": form.name, "archive_status": status if status != "ok" else "empty"}


def list_entries(files: DataFrame, options: Options | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """The entries of archives in a DataFrame's columns (as of the binaryFile source). One archive is read by one task;
    without content or test only headers are looked at. Entries of many small archives share a batch."""
    chosen = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fixed)
        rows, size = [], 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in rows_of(Source(data.as_py() or b""), name or "", chosen):
                    rows.append(row)
                    size += len(row["content"] or b"")
                    if len(rows) >= BATCH_ROWS or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    fixed = files.sparkSession.createDataFrame([], ENTRIES).schema
    return files.select(F.col(path), F.col(content)).mapInArrow(run, ENTRIES)


def read_archives(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """The entries of all archives that a path or glob names, by Spark's own file source."""
    return list_entries(spark.read.format("binaryFile").load(path), options)


#: Names of volumes: a pattern, what the set's key is, and how its volumes are ordered.
_SETS = (
    (re.compile(r"(.*)\.([0-9]{3})"), "{0}", lambda m: (0, m[2])),
    (re.compile(r"(.*)\.part([0-9]+)\.rar"), "{0}.part", lambda m: (0, m[2].rjust(10, "0"))),
    (re.compile(r"(.*)\.(rar|r[0-9]{2})"), "{0}.r", lambda m: (0 if m[2] == "rar" else 1, m[2])),
    (re.compile(r"(.*)\.(zip|z[0-9]{2})"), "{0}.z", lambda m: (1 if m[2] == "zip" else 0, m[2])),
)


def volume_place(path: str) -> tuple[str, tuple]:
    """The key of the set that a file belongs to by its name, and its order there: name.001, .002 …; name.partN.rar;
    name.rar, .r00, .r01 …; name.z01 … name.zip. Without regard to case; other files are sets of their own."""
    low = path.lower()
    for pattern, key, order in _SETS:
        if m := pattern.fullmatch(low):
            return key.format(m[1]), order(m)
    return low, (0, "")


def volume_sets(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files with volumes of one set joined: a row for each set, named by its first volume, whose volumes a task joins
    in one pass. A set must fit a row (2 GB); the data source "lading" reads volumes of any size where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, key, n = [], "", None, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["path", "volumes", "content"])

        for batch in batches:
            for k, p, c in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if k != key:
                    if n:
                        yield done()
                    held, name, key, n = [], p, k, 0
                held.append(c.as_py() or b"")
                n += 1
        if n:
            yield done()

    @F.pandas_udf("struct<key: string, first: int, low: string>")
    def place(paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(key, first, low) for key, (first, low) in map(volume_place, paths)], columns=["key", "first", "low"])

    rows = files.select(place(F.col(path)).alias("at"), F.col(path).alias("path"), F.col(content).alias("content")).select("at.*", "path", "content")
    return rows.repartition("key").sortWithinPartitions("key", "first", "low", "path").select("key", "path", "content").mapInArrow(run, "path string, volumes int, content binary")

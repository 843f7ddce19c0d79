import bz2
import gzip
import io
import lzma
import shutil
import subprocess
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lading.sources.detect import FORMATS, detect
from lading.sources.formats.dos import vint
from lading.sources.formats.sevenzip import Reader
from lading.sources.reader import Options, rows_of
from lading.sources.source import FileSource, Joined, Slice, Source

ALL = Options(content=True, test=True)


def rows(data: bytes, name: str, options: Options = ALL):
    return list(rows_of(Source(data), name, options))


def zipped(**more) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/b.txt", "hello " * 20)
        z.writestr("é.bin", b"\0\1")
        z.writestr("d/", "")
        for k, v in more.items():
            z.writestr(k, v)
    return out.getvalue()


def test_registry():
    assert len(FORMATS) == 62
    assert len({f.name for f in FORMATS}) >= 60


def test_zip():
    got = rows(zipped(), "x.zip")
    assert [(r["name"], r["file_size"], r["status"], r["is_directory"]) for r in got] == [("a/b.txt", 120, "ok", None), ("é.bin", 2, "ok", None), ("d", 0, "not_tested", True)]
    assert got[0]["content"] == b"hello " * 20


def test_zip_without_directory():
    whole = zipped()
    assert [r["name"] for r in rows(whole[: whole.index(b"PK\1\2")], "x.zip")] == ["a/b.txt", "é.bin", "d"]


@pytest.mark.parametrize("before", [1, 20, 65535, 65536, 70000])
def test_zip_end_is_found_behind_a_comment(before):
    out = io.BytesIO(zipped())
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"c" * min(before, 65535)
    assert len(rows(out.getvalue(), "x.zip")) == 3


def test_embedded_signatures_go_by_the_smallest_offset():
    rar, zip_ = b"Rar!\x1a\7\0", b"PK\3\4"
    assert detect(b"MZ" + bytes(50) + rar + zip_)[0].name == "Embedded RAR"
    assert detect(b"MZ" + bytes(50) + zip_ + rar)[0].name == "Self-extracting Zip"
    assert detect(b"MZ" + bytes(50) + b"Rar!\x1a\7\1\0")[0].name == "Embedded RAR 5"
    assert detect(b"nothing") is None
    assert detect(b"") is None


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar(form):
    out, long = io.BytesIO(), "x/" + "y" * 90 + ".txt"
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, data in ((long, b"abc"), ("e", b"q" * 600)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        for kind, name in ((tarfile.SYMTYPE, "ln"), (tarfile.LNKTYPE, "hard"), (tarfile.FIFOTYPE, "pipe"), (tarfile.CHRTYPE, "char"), (tarfile.BLKTYPE, "block"), (tarfile.DIRTYPE, "dir")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, "e"
            t.addfile(info)
    got = {r["name"]: r for r in rows(out.getvalue(), "x.tar")}
    assert got[long]["content"] == b"abc"
    assert got["ln"]["is_link"] and got["ln"]["link_destination"] == "e"
    assert got["hard"]["is_hard_link"]
    assert got["pipe"]["is_fifo"] and got["char"]["is_character_device"] and got["block"]["is_block_device"] and got["dir"]["is_directory"]
    assert [r["idx"] for r in got.values()] == list(range(8))


@pytest.mark.parametrize(("end", "data"), [("gz", gzip.compress(b"one") + gzip.compress(b"two")), ("bz2", bz2.compress(b"one") + bz2.compress(b"two")), ("xz", lzma.compress(b"onetwo")), ("lzma", lzma.compress(b"onetwo", lzma.FORMAT_ALONE))])
def test_streams(end, data):
    (row,) = rows(data, f"t.tar.{end}")
    assert (row["name"], row["content"], row["status"], row["is_archive"]) == ("t.tar", b"onetwo", "ok", True)
    (row,) = rows(data[:-6], f"t.txt.{end}")
    assert row["status"] == "damaged"


@pytest.mark.parametrize("at", range(38, 46))
def test_flipped_content_is_told(at):
    data = bytearray(zipped(big="x" * 50))
    data[at] ^= 0x55
    statuses = {r["status"] for r in rows(bytes(data), "x.zip")} | {r["archive_status"] for r in rows(bytes(data), "x.zip")}
    assert statuses & {"damaged", "checksum"}


def test_nested_to_a_depth():
    data = gzip.compress(zipped())
    assert [r["level"] for r in rows(data, "x.zip.gz", Options(depth=0))] == [0]
    assert [r["level"] for r in rows(data, "x.zip.gz", Options(depth=1))] == [0, 1, 1, 1]


def test_too_large_is_not_read():
    (row, *_) = rows(zipped(), "x.zip", Options(content=True, most_bytes=10))
    assert (row["status"], row["content"]) == ("too_large", None)


def test_warc():
    def record(uri, body):
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n" % (uri, len(body)) + body + b"\r\n\r\n"

    data = record(b"http://a.com/x/y.html", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody") + record(b"http://a.com/x", b"HTTP/1.1 200 OK\r\n\r\nindex") + record(b"http://a.com/x/y.html", b"HTTP/1.1 200 OK\r\n\r\nagain") + record(b"http://a.com/z", b"HTTP/1.1 404 NO\r\n\r\n")
    assert [(r["name"], r["content"]) for r in rows(data, "w.warc") if not r["is_directory"]] == [("a.com/x/y.html", b"body"), ("a.com/x/index.html", b"index"), ("a.com/x/y.html.1", b"again")]


@pytest.mark.parametrize(("data", "value"), [(b"\0", 0), (b"\x7f", 127), (b"\x80\x01", 128), (b"\xff\xff\xff\xff\xff\xff\x01", (1 << 43) - 1)])
def test_rar5_numbers(data, value):
    assert vint(Source(data), 0) == (value, len(data))


@pytest.mark.parametrize(("data", "value"), [(b"\x05", 5), (b"\x80\x80", 128), (b"\xc1\x02\x03", 0x10302), (b"\xff" + b"\1" * 8, 0x0101010101010101)])
def test_7z_numbers(data, value):
    assert Reader(data).number() == value


def test_sources():
    joined = Joined([Source(b"abc"), Source(b""), Source(b"defg")])
    assert (joined.size, joined.at(2, 3), joined.at(6, 9), joined.at(9, 1)) == (7, b"cde", b"g", b"")
    assert Slice(joined, 2, 3).at(1, 9) == b"de"
    assert FileSource(io.BytesIO(b"xyz"), 3).find(b"z") == 2


@pytest.mark.skipif(not shutil.which("bsdtar"), reason="needs bsdtar")
@pytest.mark.parametrize("form", ["newc", "odc", "bin", "7zip", "iso9660", "xar", "v7tar", "gnutar", "zip"])
def test_archives_of_another_program(form, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "f1").write_text("one!")
    (tmp_path / "sub/f2").write_text("second file " * 400)
    subprocess.run(["bsdtar", f"--format={form}", "-cf", tmp_path / "o.x", "f1", "sub"], cwd=tmp_path, check=True)
    got = {r["name"]: r for r in rows((tmp_path / "o.x").read_bytes(), "o.x")}
    assert (got["f1"]["content"], got["f1"]["status"]) == (b"one!", "ok")
    assert (got["sub/f2"]["content"], got["sub/f2"]["status"]) == (b"second file " * 400, "ok")
    assert got["sub"]["is_directory"]


@pytest.mark.skipif(not shutil.which("zip"), reason="needs zip")
def test_passwords(tmp_path):
    (tmp_path / "f").write_text("secret text " * 9)
    subprocess.run(["zip", "-qP", "pass", "o.zip", "f"], cwd=tmp_path, check=True)
    data = (tmp_path / "o.zip").read_bytes()
    assert rows(data, "o.zip", Options(content=True, password="pass"))[0]["content"] == b"secret text " * 9
    assert [rows(data, "o.zip", Options(content=True, password=p))[0]["status"] for p in (None, "wrong")] == ["password", "password"]


HEADS = [b"PK\3\4", b"PK\5\6", b"Rar!\x1a\7\0", b"Rar!\x1a\7\1\0", b"7z\xbc\xaf\x27\x1c", b"\x1f\x8b\x08", b"BZh91AY&SY", b"SIT!\0\0\0\0\0\0rLau", b"(This file must be converted with BinHex 4.0)\n\n:", b"\0\5\x16\0", b"PMag", b"PMa4", b"\x8f\xaf\xac\x84", b"xar!\0\x1c\0\1", b"\x1f\x9d\x90", b"\xed\xab\xee\xdb", b"\xfd7zXZ\0", b"ALZ\1\0\0\0\0BLZ\1", b"MSCF\0\0\0\0", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"\x20\x20-lh5-", b"\x20\x20-lh0-", b"PP20", b"!<arch>\n", b"WARC/1.0\r\n", b"\x60\xea", b"\x1a\x02NAME.TXT\0", b"\x76\xff", b"\0" + b" " * 11 + b"\0\0\1\0", b"\x5d\0\0\x80\0", b"070701", b"\xc7\x71", bytes(0x14) + b"\xdc\xa7\xc4\xfd"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(HEADS), st.binary(max_size=400), st.sampled_from(["x", "arc1.nsa", "arc.sar", "x.001", "x.tar"]))
def test_noise_never_raises(head, tail, name):
    assert rows(head + tail, name, Options(content=True, test=True, depth=1, most_entries=500))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 5), st.integers(0, 10**6), st.integers(1, 255))
def test_damage_never_raises(which, at, flip):
    data = bytearray([zipped(), gzip.compress(zipped()), bz2.compress(b"x" * 99), lzma.compress(b"x" * 99), lzma.compress(b"y" * 99, lzma.FORMAT_ALONE), zipped(more="z" * 3000)][which])
    data[at % len(data)] ^= flip
    assert rows(bytes(data), "x", Options(content=True, test=True, depth=2))


def test_bombs():
    data = gzip.compress(bytes(5_000_000))
    (row,) = rows(data, "x.gz", Options(content=True, most_bytes=1_000_000))
    assert (row["status"], row["content"]) == ("too_large", None)
    assert rows(zipped(), "x.zip", Options(most_entries=2))[-1]["archive_status"] == "too_many"


def test_data_source_takes_both_limits():
    from lading.sources.datasource import _Reader

    options = _Reader({"path": "/x", "most_bytes": "10", "most_entries": "6000000"}).options
    assert (options.most_bytes, options.most_entries) == (10, 6_000_000)
    assert _Reader({"path": "/x"}).options == Options()

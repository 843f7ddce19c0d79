"""Operator 9, token-ID files of directly addressable codes.

A file holds, for some documents in order: the magic, a JSON header's length and the header (documents, tokens, codes of
each level), the document ids, where each document starts (one more than documents), and the levels. An id is cut into
chunks of eight bits, the lowest first. Level k holds the k-th chunk of each id that has one, a bitmap of which ids go on
to the next level, and a rank directory: the ones before every 512th bit. The place of an id in the next level is its
rank, so any token is read with a few look-ups and nothing is decoded before it."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shared_dir

MAGIC = b"LADDAC1\n"
RANKED = 512
#: Tokens in one file at most, but for a longer document, which stays whole.
FILE_TOKENS = 16_000_000
#: Words whose ids a worker process remembers, from task to task, before it starts anew.
REMEMBERED = 800_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of a text as little-endian 32-bit integers, the same as the library's for the whole text.

    The normaliser and the splitting pattern never join characters across ASCII white space, so a text's ids are those
    of its words; frequent words are remembered. Plain Latin letters, with full stops or commas behind them, go to the
    model straight, as the letters of one piece; any other word goes through the whole library."""

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        spec = json.loads(self.library.to_str())
        self.straight = spec["model"].get("end_of_word_suffix") == "</w>" and [x["type"] for x in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and not spec["model"].get("dropout")

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(key := piece.encode())
        if found is None:
            found = self.known[key] = np.array([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, key)))], "<u4").tobytes()
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.straight and (m := self._plain.fullmatch(text)):
            return self._piece(m[1].lower()) + (self._piece(m[2]) if m[2] else b"")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        words = text.encode().split()
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file for documents that start at `starts` (one more than there are documents) in ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), RANKED)))]) if len(more) else np.zeros(1)
        levels.append((chunk, bits, ones.astype("<u8")))
        if not more.any():
            break
        rest = rest[more]
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": [len(c) for c, _, _ in levels], "unnamed": [i for i, d in enumerate(doc_ids) if d is None]}).encode()
    return b"".join([MAGIC, np.array([len(head)], "<u4").tobytes(), head, named.tobytes(), np.asarray(starts, "<u8").tobytes(), *(part.tobytes() for level in levels for part in level)])


class TokenFile:
    """Random access to the tokens of one packed file."""

    def __init__(self, data) -> None:
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)
        size = int(np.frombuffer(data, "<u4", 1, at)[0])
        head = json.loads(bytes(data[at + 4 : at + 4 + size]))
        at += 4 + size
        self.doc_ids = np.frombuffer(data, "<i8", head["docs"], at)
        self.unnamed = set(head["unnamed"])
        self.starts = np.frombuffer(data, "<u8", head["docs"] + 1, at := at + 8 * head["docs"]).astype(np.int64)
        at += 8 * (head["docs"] + 1)
        self.tokens, self.levels = head["tokens"], []
        for n in head["levels"]:
            chunk = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at := at + n)
            ones = np.frombuffer(data, "<u8", (n + RANKED - 1) // RANKED + 1, at := at + len(bits))
            at += 8 * len(ones)
            self.levels.append((chunk, bits, ones))

    def _rank(self, level: int, i: int) -> int:
        _, bits, ones = self.levels[level]
        first = i // RANKED
        head = bits[first * RANKED // 8 : i // 8]
        tail = int(bits[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ones[first]) + int(np.bitwise_count(head).sum()) + tail.bit_count()

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(level, i), shift + 8
        raise ValueError("the last level goes on")

    def slice(self, first: int, after: int) -> np.ndarray:
        """Tokens [first, after), each level from its own place."""
        out, where, a, b = np.zeros(after - first, np.uint32), None, first, after
        for level, (chunk, bits, _) in enumerate(self.levels):
            part = chunk[a:b].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
                where = np.arange(after - first)
            else:
                out[where] |= part
            more = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = where[more]
            if not len(where):
                break
            a = self._rank(level, a)
            b = a + len(where)
        return out


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write the ids of docs (doc_id, text), an end id behind each text, in ascending doc_id order, and return the
    settled list of files: part, seq, file, docs, tokens.

    A range of ids goes to a partition, is sorted there (nulls first, rows of one id by a hash of their text, by which
    they are spread too if there are many) and written as
    files of at most FILE_TOKENS; a task that runs again writes the same bytes and renames them into place. folder is a
    URI that all executors reach. An empty or null text has just the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def write() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:04d}.dac"
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
            mine = f"{top}/.{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(mine) as out:
                out.write(pack(names, starts, np.concatenate(held)))
            fs.move(mine, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "docs": [len(names)], "tokens": [int(starts[-1])]})

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(encode(text.as_py() or "") + end, "<u4")
                if names and total + len(ids) > FILE_TOKENS:
                    yield write()
                    names, held, total, seq = [], [], 0, seq + 1
                names.append(doc)
                held.append(ids.astype(np.uint16) if len(ids) and ids.max() < 65536 else ids)
                total += len(ids)
        if names:
            yield write()

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return settle(ordered.mapInArrow(run, "part int, seq int, file string, docs long, tokens long"))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in files (part, seq, file, tokens), read from the files.

    A file's first token comes after those of all files before it: a running sum over one small row a file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("bigint").alias("base"))
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{file}") as source:
                    data = TokenFile(source.read())
                n = len(data.doc_ids)
                crc = [zlib.crc32(data.slice(int(data.starts[i]), int(data.starts[i + 1])).astype("<u4").tobytes()) for i in range(n)]
                ids = pa.array([None if i in data.unnamed else int(d) for i, d in enumerate(data.doc_ids)], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(data.starts[:-1] + base), pa.array(np.diff(data.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return settle(based).repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs to a new folder of token files and read them back: doc_id, start, n_tokens, ids_crc32.

    Each row is a document of its own, repeated rows too; an empty table gives no rows; other columns are ignored."""
    folder = shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, tokenizer, end_id, folder), folder)

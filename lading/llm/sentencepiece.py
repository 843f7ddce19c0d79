"""Operator 8, SentencePiece encoding and decoding over a relational lattice of pieces.

The lattice: substrings of bounded length of each distinct unit (a word with its marks before), equi-joined to the piece
table, grouped by unit, folded by a higher-order aggregate. The public model is of the BPE kind, for which a best path
by scores gives other ids than the library; so the fold replays the merges: edges in the order of their rank, where an
edge that covers just two tokens joins them. A trained piece's parts have lower ranks, so one pass over the edges ends
where the library's queue of merges does. The state is a mask of the places where tokens end: one long."""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

MARK = "▁"
UNITS = f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n"
#: The commonest units, so many, are encoded by the lattice and sent to all tasks: a bounded table.
COMMON = 50_000
#: Units that a task counts before it passes them on.
COUNTED = 500_000
#: Tasks of the lattice of those units.
LATTICE_TASKS = 32
#: Longest unit in the lattice: its places must fit a long.
LONGEST = 60
#: Units that a worker process remembers, from task to task, before it starts anew.
REMEMBERED = 600_000
#: Tokens of an output batch, about.
BATCH = 1_000_000


@dataclass(frozen=True)
class Model:
    """ranks: piece to (rank, id), better pieces first and those of one score together; table: bytes of each id."""

    ranks: dict[str, tuple[int, int]]
    table: list[bytes]
    bytes_from: int
    longest: int


def load(path: str) -> Model:
    """The pieces of a model file. Only byte-fallback BPE models without a normaliser of their own are read."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap:
        raise ValueError("not a byte-fallback BPE model with the identity normaliser")
    normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == 1]
    if bad := [p.piece for _, p in normal if re.search(f"[^{MARK}]{MARK}", p.piece) or "\n" in p.piece and p.piece != "\n"]:
        raise ValueError(f"pieces go beyond a unit: {bad[:3]}")
    rank = {s: r for r, s in enumerate(sorted({p.score for _, p in normal}, reverse=True))}
    table = [int(p.piece[3:5], 16).to_bytes(1, "big") if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
    first = next(i for i, p in enumerate(proto.pieces) if p.type == 6)
    return Model({p.piece: (rank[p.score], i) for i, p in normal}, table, first, max(len(p.piece) for _, p in normal))


def _id_bytes(model: Model, token: str) -> list[int]:
    found = model.ranks.get(token)
    return [found[1]] if found else [model.bytes_from + b for b in token.encode()]


def encode_unit(model: Model, unit: str) -> list[int]:
    """Ids of one unit by merging the best pair, the first of equals, as long as there is one."""
    ranks, far = model.ranks, (1 << 60, 0)
    n = len(unit)
    if n <= 200:
        tokens = list(unit)
        best = [ranks.get(a + b, far)[0] for a, b in zip(tokens, tokens[1:], strict=False)]
        while best and (low := min(best)) < far[0]:
            i = best.index(low)
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
            del best[i]
            if i < len(best):
                best[i] = ranks.get(tokens[i] + tokens[i + 1], far)[0]
            if i:
                best[i - 1] = ranks.get(tokens[i - 1] + tokens[i], far)[0]
    else:
        text, after, before = list(unit), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[a + b][0], i, a + b) for i, (a, b) in enumerate(zip(text, text[1:], strict=False)) if a + b in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if text[i] else -1
            if j < 0 or text[i] + text[j] != piece:
                continue
            text[i], text[j], after[i] = piece, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := text[left] + text[right]) in ranks:
                    heapq.heappush(heap, (ranks[pair][0], left, pair))
        tokens = [t for t in text if t]
    return [i for t in tokens for i in _id_bytes(model, t)]


_LATTICE = """
flatten(transform(sequence(1, char_length(unit)), s ->
  transform(sequence(1, least({longest}, char_length(unit) - s + 1)), l -> named_struct('s', s - 1, 'l', l, 'piece', substring(unit, s, l)))))
"""
_FOLD = """
transform(array(edges), e -> transform(
  array(aggregate(e, shiftleft(1L, char_length(unit) + 1) - 1, (m, x) ->
    if(x.l > 1 and (m & x.ends) = x.ends and bit_count(m & x.inner) = 1, m & ~x.inner, m))),
  m -> transform(
    array_sort(filter(e, x -> (m & x.ends) = x.ends and (m & x.inner) = 0), (a, b) -> a.s - b.s),
    x -> x.id))[0])[0]
"""


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """unit and ids for distinct units of up to LONGEST characters, none with two marks in a row (marks' own runs all
    have one score). An id of -1 - k stands for the character at place k, which has no piece
    and is written as its bytes.

    The piece table has a row a piece and is broadcast: its size is the vocabulary's. Grouping by unit needs no shuffle
    if units come from a grouping."""
    spark = units.sparkSession
    pieces = spark.createDataFrame([(p, r, i) for p, (r, i) in model.ranks.items()], "piece string, rank int, id int")
    edges = units.select("unit", F.explode(F.expr(_LATTICE.format(longest=model.longest))).alias("x")).select("unit", "x.s", "x.l", "x.piece")
    joined = edges.join(F.broadcast(pieces), "piece", "left").where("id is not null or l = 1")
    place = lambda e: F.expr(f"shiftleft(1L, {e})")
    edge = F.struct(F.coalesce("rank", F.lit(-1)).alias("rank"), "s", "l", (place("s").bitwiseOR(place("s + l"))).alias("ends"), (place("s + l") - place("s + 1")).alias("inner"), F.coalesce("id", -1 - F.col("s")).alias("id"))
    grouped = joined.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return grouped.select("unit", F.expr(_FOLD).alias("ids"))


_BEST = """
transform(array(edges), e -> transform(array(aggregate(e,
  transform(sequence(0, char_length(unit)), i -> named_struct('score', if(i = 0, 0D, cast('-infinity' as double)), 's', -1, 'id', -1)),
  (best, x) -> if(best[x.s].score + x.score > best[x.s + x.l].score,
    transform(best, (b, i) -> if(i = x.s + x.l, named_struct('score', best[x.s].score + x.score, 's', x.s, 'id', x.id), b)), best))),
  best -> reverse(aggregate(sequence(1, char_length(unit)), named_struct('at', char_length(unit), 'ids', cast(array() as array<int>)),
    (a, k) -> if(a.at > 0, named_struct('at', best[a.at].s, 'ids', concat(a.ids, array(best[a.at].id))), a), a -> a.ids)))[0])[0]
"""


def best_paths(units: DataFrame, scores: dict[str, float], ids: dict[str, int], unknown: float) -> DataFrame:
    """unit and ids of the path of the highest sum of scores (Viterbi), for models of the unigram kind, over distinct units
    of up to LONGEST characters.

    Edges of the lattice come in the order of their ends, so a fold over them has the best way to each place before any
    edge that starts there; of equal sums the edge that starts first stays. A character without a piece costs `unknown`,
    and -1 - its place stands for it."""
    longest = max(map(len, scores), default=1)
    pieces = units.sparkSession.createDataFrame([(p, float(s), ids[p]) for p, s in scores.items()], "piece string, score double, id int")
    edges = units.select("unit", F.explode(F.expr(_LATTICE.format(longest=longest))).alias("x")).select("unit", "x.s", "x.l", "x.piece")
    joined = edges.join(F.broadcast(pieces), "piece", "left").where("id is not null or l = 1")
    edge = F.struct((F.col("s") + F.col("l")).alias("end"), "s", "l", F.coalesce("score", F.lit(float(unknown))).alias("score"), F.coalesce("id", -1 - F.col("s")).alias("id"))
    grouped = joined.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return grouped.select("unit", F.expr(_BEST).alias("ids"))


def common_units(docs: DataFrame, model: Model, most: int = COMMON) -> dict[str, bytes]:
    """Ids (little-endian 32-bit) of the commonest units of all whole texts, encoded by the lattice.

    Each task counts the units of its texts, some at a time, and the counts are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(UNITS).findall, Counter()

        def counts() -> pa.RecordBatch:
            fit = [(u, n) for u, n in held.items() if len(u) <= LONGEST and MARK * 2 not in u]
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in fit], pa.string()), pa.array([n for _, n in fit], pa.int64())], ["unit", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.update(find(MARK + text.as_py().replace(" ", MARK)))
                if len(held) > COUNTED:
                    yield counts()
                    held = Counter()
        yield counts()

    fit = docs.where("text <> ''").select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("count"))
    top = settle(fit.orderBy(F.desc("count"), "unit").limit(most).select("unit"))
    return {u: np.array([j for i in ids for j in ([i] if i >= 0 else [model.bytes_from + b for b in u[-1 - i].encode()])], "<u4").tobytes() for u, ids in lattice(top.repartition(LATTICE_TASKS, "unit"), model).collect()}


class Encoder:
    """Ids of whole texts: common units from the lattice's table, others by their own merges, remembered for a while."""

    def __init__(self, model: Model, common: dict[str, bytes]) -> None:
        self.model, self.common, self.known = model, common, dict(common)
        self.find = re.compile(UNITS).findall

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        units = self.find(MARK + text.replace(" ", MARK))
        if len(self.known) > REMEMBERED + len(self.common):
            self.known = dict(self.common)
        known = self.known
        for u in set(units).difference(known):
            known[u] = np.array(encode_unit(self.model, u), "<u4").tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, units)), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(sent: tuple) -> Encoder:
    """The encoder of a _sent() result: a worker process keeps the last one from task to task."""
    name, broadcast = sent
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(*broadcast.value)
    return _ENCODERS[name]


def decode(model: Model, ids) -> str:
    """The text of ids: pieces and bytes put together, the mark in front dropped."""
    out = b"".join(map(model.table.__getitem__, ids))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def _sent(docs: DataFrame, path: str) -> tuple:
    """A name of its own, and the broadcast model and common units: both of bounded size."""
    model = load(path)
    return uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((model, common_units(docs, model)))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The columns of docs without text, and ids (array of int) of each row's whole text.

    The same ids as the library's. A null or empty text has none; repeated rows are encoded each; an empty table gives
    no rows; a column ids that docs has already gives way."""
    sent = _sent(docs, path)
    keep = [c for c in docs.columns if c not in ("text", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent)
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < batch.num_rows:
                to, size, held = at, 0, []
                while to < batch.num_rows and size < BATCH:
                    held.append(encode(texts[to].as_py()))
                    size += len(held[-1])
                    to += 1
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held).view(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in keep), ids], [*keep, "ids"])
                at = to

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)
    return docs.select(*(F.col(f"`{c}`") for c in keep), "text").mapInArrow(run, f"{kinds}, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with a column text that its ids (null: none) stand for, instead of ids."""
    sent = tokens.sparkSession.sparkContext.broadcast(load(path))
    keep = [c for c in tokens.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode(sent.value, i.as_py() or []) for i in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name != "ids")
    return tokens.select(*(F.col(f"`{c}`") for c in keep), "ids").mapInArrow(run, f"{kinds}, text string")


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and text_sha256 of the text
    decoded from the ids, for each row of docs (doc_id, text).

    A null or empty text has no pieces; repeated rows are encoded each, very long texts whole; an empty table gives no
    rows; other columns are ignored."""
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        encode = _encoder(sent)
        model = encode.model
        for batch in batches:
            n, crc, sha = [], [], []
            for text in batch.column("text"):
                ids = encode(text.as_py())
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                sha.append(sha256(decode(model, ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)], ["doc_id", "n_pieces", "ids_crc32", "text_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string")

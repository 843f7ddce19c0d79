"""Operator 7, embedding near-dedup: inverted lists with product-quantised residuals, table look-ups, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by, settle
from .graph import connected_components
from .runs import forest, whole_groups

#: The index is fitted on so many vectors at least and at most, those of the smallest hash; every vector is indexed.
SAMPLE, MOST_SAMPLE = 20_000, 65_536
#: Vectors a list, about, and the most lists; both bound what the driver and each task hold of the index.
LIST_ROWS, MOST_LISTS = 256, 16_384
SUBSPACES, CODES, ROUNDS = 8, 64, 8
#: A pair in two lists is found if one of the two looks into the other's list. Their distances to the border between the
#: lists add up to at most their own distance, so one of them is within half of it: a reach of 0.5 loses nothing.
EXACT = 0.5
#: Share of its way that a pair goes straight across a border, in deviations of 1 / sqrt(d), up to which it is found.
DEVIATIONS = 5.6
#: Rows of a list that meet in one cell; larger lists are cut into blocks.
CELL = 4096
PAIRS = 2_000_000


def default_reach(dim: int) -> float:
    """Of the radius, how near a list's border must be for a look into it: lossless below 32 dimensions; from there on a
    pair is missed if over 2 * reach of its way, 5.6 deviations of a direction by chance, is straight across."""
    return min(EXACT, DEVIATIONS / 2 / dim**0.5)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a list column; nulls inside are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    length = np.where(valid, np.diff(offsets), 0)
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        yield rows, values[offsets[rows][:, None] + np.arange(d)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, key (a digest of the components) and raw (the components' bytes) of each row; a vector that can't be
    compared (null, empty, zero, with a null or non-finite component) has only its vec_id."""
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dim, key, raw = np.zeros(n, np.int32), [None] * n, [None] * n
            for rows, x in _matrices(batch.column("embedding")):
                fit = np.isfinite(x).all(axis=1)
                fit[fit] = np.abs(x[fit]).max(axis=1) > 0
                for i, v in zip(rows[fit], (x[fit] + 0.0).astype(kind), strict=True):
                    dim[i], raw[i] = len(v), v.tobytes()
                    key[i] = blake2b(raw[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dim), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "dim", "key", "raw"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, key binary, raw binary")


@dataclass(frozen=True)
class Index:
    centers: np.ndarray
    books: np.ndarray
    kind: type

    def vectors(self, raw) -> np.ndarray:
        x = unit(np.frombuffer(b"".join(raw), self.kind).reshape(len(raw), -1).astype(np.float64))
        return np.pad(x, ((0, 0), (0, self.centers.shape[1] - x.shape[1])))

    def parts(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), SUBSPACES, -1)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each lies from what its codes stand for."""
        parts = self.parts(rest)
        codes = np.stack([_nearest(parts[:, m], self.books[m]) for m in range(SUBSPACES)], axis=1)
        off = parts - self.books[np.arange(SUBSPACES)[None], codes]
        return codes.astype(np.uint8), np.sqrt((off**2).sum(axis=(1, 2)))

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """For each residual, subspace and code the squared distance."""
        parts, books = self.parts(rest.astype(np.float32)), self.books.astype(np.float32)
        dots = np.einsum("pmd,mcd->pmc", parts, books, optimize=True)
        return (parts**2).sum(axis=2)[:, :, None] - 2 * dots + (books**2).sum(axis=2)[None]


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    norm, step = (centers**2).sum(axis=1)[None], max(1, 4_000_000 // len(centers))
    return np.concatenate([np.argmin(norm - 2 * x[at : at + step] @ centers.T, axis=1) for at in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    centers = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))]
    for _ in range(ROUNDS):
        near = _nearest(x, centers)
        counts = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=column, minlength=k) for column in x.T], axis=1)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def lists_for(rows: int) -> int:
    return max(1, min(MOST_LISTS, rows // LIST_ROWS))


def fit(raw: list[bytes], rows: int, kind: type) -> Index:
    x = unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64))
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))
    centers = _means(x, max(1, min(lists_for(rows), len(x) // 4)), 1)
    rest = (x - centers[_nearest(x, centers)]).reshape(len(x), SUBSPACES, -1)
    books = np.stack([_means(rest[:, m], min(CODES, len(x)), 2 + m) for m in range(SUBSPACES)])
    return Index(centers, books, kind)


def _reached(x: np.ndarray, centers: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's own list, and (row, list) of all lists whose border with the own list lies within a distance, the
    own ones included."""
    norm, step = (centers**2).sum(axis=1), max(1, 4_000_000 // len(centers))
    owns, rows, lists = [], [], []
    for at in range(0, len(x), step):
        part = x[at : at + step]
        far = norm[None] - 2 * part @ centers.T
        own = far.argmin(axis=1)
        apart = np.sqrt(np.maximum(norm[own][:, None] + norm[None] - 2 * centers[own] @ centers.T, 0))
        row, k = np.nonzero((far - far[np.arange(len(part)), own][:, None] <= 2 * within * apart) | (np.arange(len(centers))[None] == own[:, None]))
        owns.append(own)
        rows.append(row + at)
        lists.append(k)
    return tuple(np.concatenate(a) if a else np.zeros(0, np.int64) for a in (owns, rows, lists))


_FIXED = 32767.0


def _packed(x: np.ndarray) -> list[bytes]:
    """Unit vectors as 16-bit fixed-point numbers: what the shuffle carries instead of raw vectors."""
    return [v.tobytes() for v in np.rint(x * _FIXED).astype("<i2")]


def _numbered(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each of the counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


_CELLS = "list long, i long, j long, kind int, node long, weight long, own int, codes binary, off double, asks binary, vec binary"


def searched(nodes: DataFrame, index: Index, cosine: float, reach: float) -> DataFrame:
    """Rows (kind, node, other, n) from nodes (node, weight, raw).

    kind 0: n is a weight of neighbours that node has; 1: a link between node and other, which join just what all found
    pairs join; 2: a pair too near the limit to be told by the 16-bit copies, to be told by the raw vectors; n is 1 if
    other is to be credited as well. A pair is credited to both sides once: where only one of the two looks into the
    other's list, that look credits both."""
    radius = float(np.sqrt(2 - 2 * cosine))
    lists, width = index.centers.shape
    sent = nodes.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = sent.value, np.zeros((2, lists), np.int64)
        for batch in batches:
            own, _, asked = _reached(index.vectors(batch.column("raw").to_pylist()), index.centers, radius * reach)
            total[0] += np.bincount(own, minlength=lists)
            total[1] += np.bincount(asked, minlength=lists)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists)), pa.array(total[0]), pa.array(total[1])], ["list", "own", "asked"])

    blocks = np.ones((2, lists), np.int64)
    for k, own, asked in nodes.select("raw").mapInArrow(count, "list long, own long, asked long").groupBy("list").agg(F.sum("own"), F.sum("asked")).collect():
        blocks[:, k] = max(1, -(-own // CELL)), max(1, -(-asked // CELL))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            node, weight = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            x = index.vectors(batch.column("raw").to_pylist())
            own, row, k = _reached(x, index.centers, radius * reach)
            codes, off = index.encode(x - index.centers[own])
            codes, vec = pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(_packed(x), pa.binary())
            ends = np.searchsorted(row, np.arange(len(node) + 1))
            asks = pa.array([k[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            mixed = ((node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            # Kind 0 asks and is asked in the only cell of its own list, 1 asks in each block of a list, 2 is asked in each cell of its own block.
            both = (k == own[row]) & (blocks[0, k] == 1) & (blocks[1, k] == 1)
            ask, mine = np.flatnonzero(~both), np.flatnonzero(~both & (k == own[row]))
            na, nm = blocks[0, k[ask]], blocks[1, k[mine]]
            at = np.concatenate([np.flatnonzero(both), np.repeat(ask, na), np.repeat(mine, nm)])
            i = np.concatenate([np.zeros(both.sum(), np.int64), _numbered(na), np.repeat(mixed[row[mine]] % blocks[0, k[mine]], nm)])
            j = np.concatenate([np.zeros(both.sum(), np.int64), np.repeat(mixed[row[ask]] % blocks[1, k[ask]], na), _numbered(nm)])
            kind = np.repeat(np.array([0, 1, 2], np.int32), [both.sum(), na.sum(), nm.sum()])
            for a in range(0, len(at), 10_000):
                c = slice(a, a + 10_000)
                r, hidden = row[at[c]], pa.array(kind[c] == 1)
                only = lambda column, r=r, hidden=hidden: pc.if_else(hidden, None, column.take(pa.array(r)))
                yield pa.RecordBatch.from_arrays([pa.array(k[at[c]]), pa.array(i[c]), pa.array(j[c]), pa.array(kind[c]), pa.array(node[r]), pa.array(weight[r]), pa.array(own[r].astype(np.int32)), only(codes), only(pa.array(off)), only(asks), vec.take(pa.array(r))], [f.split()[0] for f in _CELLS.split(", ")])

    # 16-bit rounding moves a unit vector by `error` at most, and a cosine by about twice that; 1e-5 is for 32-bit sums.
    error = 0.5 / _FIXED * width**0.5
    doubt = 2 * error + error**2 + 1e-5

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        centers = index.centers.astype(np.float32)

        def told(kind, node, other, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), kind, np.int32)), pa.array(node), pa.array(other), pa.array(n)], ["kind", "node", "other", "n"])

        def sent_out(links, counted):
            if links:
                x, y = forest(*(np.concatenate(side) for side in zip(*links, strict=True)))
                yield told(1, x, y, np.zeros(len(x), np.int64))
            if counted:
                whose, n = (np.concatenate(side) for side in zip(*counted, strict=True))
                whose, place = np.unique(whose, return_inverse=True)
                yield told(0, whose, np.zeros(len(whose), np.int64), np.bincount(place, weights=n).astype(np.int64))

        links, counted, held = [], [], 0
        for rows in whole_groups(batches, ["list", "i", "j"]):
            cell = np.stack([rows.column(c).to_numpy() for c in ("list", "i", "j")])
            cuts = np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1, [rows.num_rows]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, here = rows.slice(lo, hi - lo), cell[0, lo]
                kind, node, weight, own = (part.column(c).to_numpy() for c in ("kind", "node", "weight", "own"))
                inner, asking = np.flatnonzero(kind != 1), np.flatnonzero(kind != 2)
                if not len(inner) or not len(asking):
                    continue
                x = np.frombuffer(b"".join(part.column("vec").to_pylist()), "<i2").reshape(len(node), -1).astype(np.float32) / np.float32(_FIXED)
                codes = np.frombuffer(b"".join(part.column("codes").drop_null().to_pylist()), np.uint8).reshape(len(inner), SUBSPACES).astype(np.int64)
                limit = ((radius + part.column("off").to_numpy()[inner] + 2 * error + 1e-3) ** 2).astype(np.float32)
                looks = [np.frombuffer(b, "<i4").astype(np.int64) for b in part.column("asks").drop_null().to_pylist()]
                looks = np.concatenate([n * lists + ks for n, ks in enumerate(looks)])
                step = max(1, PAIRS // len(inner))
                for at in range(0, len(asking), step):
                    ask = asking[at : at + step]
                    table = index.tables(x[ask] - centers[here])
                    far = np.take(table[:, 0], codes[:, 0], axis=1)
                    for m in range(1, SUBSPACES):
                        far += np.take(table[:, m], codes[:, m], axis=1)
                    p, q = np.nonzero(far <= limit[None])
                    if len(p) > 0.02 * far.size:
                        cos = (x[ask] @ x[inner].T)[p, q]
                    else:
                        cos = np.concatenate([np.einsum("ij,ij->i", x[ask[p[s : s + 50_000]]], x[inner[q[s : s + 50_000]]]) for s in range(0, len(p), 50_000)] or [np.zeros(0, np.float32)])
                    good = (cos >= cosine - doubt) & (node[ask[p]] != node[inner[q]])
                    p, q, cos = ask[p[good]], q[good], cos[good]
                    if not len(p):
                        continue
                    wanted = q * lists + own[p]
                    found = np.minimum(np.searchsorted(looks, wanted), len(looks) - 1)
                    alone = (own[p] != here) & (looks[found] != wanted)  # the other one doesn't look into this one's list
                    q = inner[q]
                    sure = cos >= cosine + doubt
                    if not sure.all():
                        yield told(2, node[p[~sure]], node[q[~sure]], alone[~sure].astype(np.int64))
                    p, q, alone = p[sure], q[sure], alone[sure]
                    if len(p):
                        n = np.bincount(p, weights=weight[q], minlength=len(node)) + np.bincount(q[alone], weights=weight[p[alone]], minlength=len(node))
                        some = np.flatnonzero(n)
                        counted.append((node[some], n[some]))
                        links.append(forest(node[p], node[q]))
                        held += len(some) + len(links[-1][0])
            if held > 200_000:
                yield from sent_out(links, counted)
                links, counted, held = [], [], 0
        yield from sent_out(links, counted)

    placed = nodes.select("node", "weight", "raw").mapInArrow(place, _CELLS)
    return placed.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(look, "kind int, node long, other long, n long")


def told_by_raw(pairs: DataFrame, nodes: DataFrame, kind: type, cosine: float) -> DataFrame:
    """Those of pairs (node, other, n) whose raw vectors have the cosine, in double precision, with both weights."""
    of = lambda side, tag: nodes.select(F.col("node").alias(side), F.col("weight").alias(f"w{tag}"), F.col("raw").alias(f"r{tag}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (unit(np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64)) for c in ("r1", "r2"))
                good = pa.array(np.einsum("ij,ij->i", x, y) >= cosine)
                yield batch.select(["node", "other", "n", "w1", "w2"]).filter(good)

    return pairs.join(of("node", 1), "node").join(of("other", 2), "other").select("node", "other", "n", "w1", "w2", "r1", "r2").mapInArrow(run, "node long, other long, n long, w1 long, w2 long")


def linked(vectors: DataFrame, cosine: float = 0.95, reach: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding).

    Vectors link if their cosine, in double precision, is at least `cosine`. Equal vectors are one node with a weight,
    so a large group of copies costs one row. Vectors that are null, zero or hold null or non-finite components link
    with nothing. Vectors of each length are fitted and searched by themselves. Repeated rows count as vectors of their
    own; an empty table gives no rows; other columns are ignored. Links are symmetric and exact; reach says how many
    lists are looked into, EXACT (0.5) finds every pair, None takes default_reach() of the length."""
    marked = settle(keyed(vectors))
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    out = marked.where("dim = 0").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for (dim,) in marked.where("dim > 0").select("dim").distinct().orderBy("dim").collect():
        out = out.unionByName(_of_length(marked.where(F.col("dim") == dim), kind, cosine, default_reach(dim) if reach is None else reach))
    return out


def _of_length(marked: DataFrame, kind: type, cosine: float, reach: float) -> DataFrame:
    """linked() of the rows of keyed() with vectors of one length."""
    nodes = settle(marked.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("raw").alias("raw")).withColumn("node", F.monotonically_increasing_id()))
    rows = nodes.count()
    sample = [r[0] for r in nodes.orderBy(F.xxhash64("key"), "key").limit(min(MOST_SAMPLE, max(SAMPLE, 4 * lists_for(rows)))).select("raw").collect()]
    found = settle(searched(nodes, fit(sample, rows, kind), cosine, reach))
    doubted = found.where("kind = 2")
    counts, links = found.where("kind = 0").select("node", "n"), found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if not doubted.isEmpty():
        told = settle(told_by_raw(doubted.select("node", "other", "n"), nodes, kind, cosine))
        counts = counts.unionByName(told.select("node", F.col("w2").alias("n"))).unionByName(told.where("n = 1").select(F.col("other").alias("node"), F.col("w1").alias("n")))
        links = links.unionByName(told.select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = connected_components(links)
    rooted = settle(nodes.drop("raw").join(counts.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(joined, "node", "left").select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    named = joined_by(rooted, rooted.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("key", "n_links", "component_id")
    rows = joined_by(marked.select("vec_id", "key"), settle(named), "key")
    return rows.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

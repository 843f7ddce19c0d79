"""Operator 2, SimHash near-dedup by the general pigeonhole principle, with thresholds allocated by dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by, settle
from .graph import connected_components
from .runs import forest, group_starts, ranged_pairs, whole_groups

BITS = 64
#: Bits of a block, the grain at which partitions are cut.
BLOCK = 4
#: What a row of the index or a probe costs, in pairs compared: measured at 8 microseconds, written, sorted and read
#: twice, against 20 nanoseconds.
ROW_COST = 400.0
#: Rows of one key that are compared with each other in one cell; a key with more is cut into blocks.
CELL = 4096
#: So many keys with more rows than a cell may be broadcast.
FEW_KEYS = 10_000
SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text, A-Z lower-cased; the whole sequence if it has fewer words."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    flat = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    cut = map(flat.__getitem__, map(slice, starts[:n].tolist(), last.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, n)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is in over half of the text's hashes."""
    counts = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.concatenate([hashes[i] for i in some]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(ones * 2 > counts[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row; texts without words, null too, have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            fps, size = [], 0
            for text in batch.column("text"):
                held.append(shingle_hashes(text.as_py() or "", words))
                size += len(held[-1])
                if size > 200_000:
                    fps.append(majority(held))
                    held, size = [], 0
            fps.append(majority(held))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(fps).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """order: bits, correlated ones side by side; parts: (first, after, threshold) in that order, thresholds unequal."""

    order: tuple[int, ...]
    parts: tuple[tuple[int, int, int], ...]


def bit_order(together: np.ndarray, n: int) -> list[int]:
    """Bits ordered so that each block holds correlated ones: a block starts with the free bit of the strongest
    correlation and takes the bits that correlate most with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, order = set(range(BITS)), []
    while free:
        rest = sorted(free)
        block = [max(rest, key=lambda b: (strength[b, rest].max(), -b))]
        free.discard(block[0])
        while free and len(block) < BLOCK:
            block.append(max(sorted(free), key=lambda b: (strength[b, block].sum(), -b)))
            free.discard(block[-1])
        order += block
    return order


def allocate(histograms: np.ndarray, n: int, threshold: int) -> list[tuple[int, int, int]]:
    """Partitions (first bit, bit after, threshold) of least estimated cost.

    By the general pigeonhole principle two fingerprints at most `threshold` apart agree, in some partition, up to that
    partition's own threshold, if thresholds plus one add up to threshold plus one; -1 leaves a partition out. The
    candidates of a range of blocks are estimated from all fingerprints' block histograms: the distribution of the
    distance of two values of a block, convolved over blocks."""
    near = []
    for h in histograms:
        p = h / max(h.sum(), 1)
        at = np.zeros(BLOCK + 1)
        for x in range(len(p)):
            for y in range(len(p)):
                at[(x ^ y).bit_count()] += p[x] * p[y]
        near.append(at)
    blocks, best = len(near), {(0, 0): (0.0, ())}
    for end in range(1, blocks + 1):
        for first in range(end):
            d = np.ones(1)
            for b in range(first, end):
                d = np.convolve(d, near[b])
            width = (end - first) * BLOCK
            for t in range(-1, threshold + 1):
                ball = sum(comb(width, k) for k in range(t + 1))
                if ball > 50_000:
                    break
                cost = 0.0 if t < 0 else n * ROW_COST * (1 + (ball - 1) / 2) + n * n / 2 * float(d[: t + 1].sum())
                for spent in range(threshold + 1 - t):
                    if (first, spent) in best:
                        whole = best[first, spent][0] + cost
                        if whole < best.get((end, spent + t + 1), (np.inf,))[0]:
                            best[end, spent + t + 1] = (whole, (*best[first, spent][1], (first * BLOCK, end * BLOCK, t)))
    return [p for p in best[blocks, threshold + 1][1] if p[2] >= 0]


def _reordered(fp: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for to, bit in enumerate(order):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out


def _summed(fps: DataFrame, cells: int, count) -> np.ndarray:
    """Counts in a fixed number of cells, added up over all fingerprints: each task sends its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            total += count(batch.column("fp").to_numpy().view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(cells, np.int64)
    for cell, n in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


def make_plan(fps: DataFrame, threshold: int) -> Plan:
    """A plan from the statistics of all distinct fingerprints; any plan finds the same links."""

    def together(fp: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        return (bits.T @ bits).astype(np.int64).ravel()

    n = fps.count()
    order = tuple(bit_order(_summed(fps, BITS * BITS, together).reshape(BITS, BITS), n))

    def blocks(fp: np.ndarray) -> np.ndarray:
        at = _reordered(fp, order)
        return np.concatenate([np.bincount(((at >> np.uint64(b)) & np.uint64(2**BLOCK - 1)).astype(np.int64), minlength=2**BLOCK) for b in range(0, BITS, BLOCK)])

    return Plan(order, tuple(allocate(_summed(fps, BITS // BLOCK * 2**BLOCK, blocks).reshape(-1, 2**BLOCK), n, threshold)))


def probes(fps: DataFrame, plan: Plan) -> DataFrame:
    """Rows (part, key, kind, fp): each fingerprint's own key in each partition (kind 0), and every larger key within
    the partition's threshold (kind 1), so that of two fingerprints with different keys just one probes the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.array([sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(range(hi - lo), k)], np.uint64) for lo, hi, t in plan.parts]
        for batch in batches:
            whole = batch.column("fp").to_numpy()
            for at in range(0, len(whole), 2048):
                fp = whole[at : at + 2048]
                turned = _reordered(fp.view(np.uint64), plan.order)
                for part, (lo, hi, _) in enumerate(plan.parts):
                    key = (turned >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
                    other = key[:, None] ^ masks[part][None, :]
                    row, col = np.nonzero(other > key[:, None])
                    keys = np.concatenate([key, other[row, col]]).view(np.int64)
                    kind = np.concatenate([np.zeros(len(key), np.int32), np.ones(len(row), np.int32)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array(kind), pa.array(np.concatenate([fp, fp[row]]))], ["part", "key", "kind", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, key long, kind int, fp long")


def celled(rows: DataFrame) -> DataFrame:
    """rows with the cells (i, j) in which each is compared.

    A key with up to CELL rows of each kind is one cell. A larger one is cut into blocks by hash: each pair of index
    blocks is a cell, as is each index block with each probe block, so no task gets an unbounded group."""
    counts = rows.groupBy("part", "key").agg(F.sum(1 - F.col("kind")).alias("n"), F.sum("kind").alias("p")).where(f"n > {CELL} or (p > {CELL} and n > 0)")
    hot = settle(counts.select("part", "key", F.ceil(F.col("n") / CELL).cast("int").alias("ni"), F.ceil(F.col("p") / CELL).cast("int").alias("np")))
    found = hot.limit(FEW_KEYS + 1).count()
    if not found:
        return rows.select("part", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "kind", "fp")
    joined = rows.join(F.broadcast(hot) if found <= FEW_KEYS else hot, ["part", "key"], "left")
    block = F.pmod(F.xxhash64("fp"), F.when(F.col("kind") == 0, F.col("ni")).otherwise(F.greatest("np", F.lit(1)))).cast("int").alias("block")
    joined = joined.select("*", block)
    cells = F.expr("""case when ni is null then array(named_struct('i', 0, 'j', 0, 'kind', kind))
      when kind = 0 then concat(
        transform(sequence(0, ni - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block), 'kind', if(x < block, 1, 0))),
        if(np > 0, transform(sequence(0, greatest(np, 1) - 1), x -> named_struct('i', block, 'j', ni + x, 'kind', 0)), array()))
      else transform(sequence(0, ni - 1), x -> named_struct('i', x, 'j', ni + block, 'kind', 1)) end""")
    return joined.select("part", "key", F.explode(cells).alias("c"), "fp").select("part", "key", "c.i", "c.j", "c.kind", "fp")


def links(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that join just what the links of at most `threshold` bits join.

    Every candidate is verified, then what a task finds is reduced to a forest of each fingerprint and the first of its
    component, so a dense group of m fingerprints gives about m pairs a cell, not m * m."""
    plan = make_plan(fps, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["part", "key", "i", "j"]):
            part, key, i, j, kind, fp = (rows.column(c).to_numpy() for c in ("part", "key", "i", "j", "kind", "fp"))
            start = group_starts([part, key, i, j])
            last = np.searchsorted(start, start, side="right")
            index = np.zeros(len(fp) + 1, np.int64)
            np.cumsum(kind == 0, out=index[1:])
            after = start + index[last] - index[start]
            high = np.where(kind == 0, np.where(i == j, np.arange(len(fp)), start), after)
            bits, a, b, held = fp.view(np.uint64), [], [], 0
            for row, other in ranged_pairs(start, high):
                near = np.bitwise_count(bits[row] ^ bits[other]) <= threshold
                a.append(fp[row[near]])
                b.append(fp[other[near]])
                held += len(a[-1])
                if held > 1_000_000:
                    x, y = forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], len(x)
            if held:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    cells = celled(probes(fps, plan))
    return cells.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j", "kind").mapInArrow(run, "a long, b long")


def clustered(docs: DataFrame, words: int = 4, threshold: int = 4) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text).

    Equal fingerprints are one node, so a group of exact copies costs one row however large it is. component_id is the
    smallest doc_id reachable; rows with a null doc_id count, but never name a component unless it has no other id.
    Repeated rows link with each other; an empty table gives no rows; other columns are ignored."""
    marked = settle(fingerprints(docs, words))
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = connected_components(links(nodes, threshold))
    rooted = settle(nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    named = joined_by(rooted, rooted.groupBy("component").agg(F.min("first").alias("component_id")), "component")
    return joined_by(marked, settle(named.select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each row of docs; see clustered()."""
    return clustered(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Near-dedup by exact shingle similarity, on operator 2: SimHash links name the first candidates, min-wise fingerprints
those beyond its radius, and every link is verified on whole sets."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import identified, joined_by, made_since, settle, shared_dir, with_small
from .graph import connected_components
from .runs import forest, group_starts, whole_groups
from .simhash import links as simhash_links
from .simhash import majority, shingle_hashes

#: SimHash fingerprints of sets' texts that differ in so many bits at most are candidates, tested before all others.
RADIUS = 6

#: Fingerprints of a set, and minima in each: a pair of similarity s shares none with a chance of (1 - s ** MINIMA) **
#: BANDS, which is 1 in 20,000 at 0.8 and less above.
BANDS, MINIMA = 25, 5
#: Rounds that test neighbours of a bucket only, before what is left of it is tested pair by pair.
ROUNDS = 2
#: Nodes of a bucket whose pairs are made as rows, and that meet in one cell of a larger bucket.
SMALL, CELL = 16, 2048
#: So many nodes with a candidate, or pairs, may be broadcast.
FEW_NODES = 1_000_000
#: Shingles that are held at once.
HELD = 200_000

_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * MINIMA), dtype=np.int64).view(np.uint64)


def _hashed(texts, words: int) -> Iterator[list[np.ndarray]]:
    """The shingle hashes of texts, some at a time."""
    held: list[np.ndarray] = []
    size = 0
    for text in texts:
        held.append(shingle_hashes(text.as_py() or "", words))
        size += len(held[-1])
        if size > HELD:
            yield held
            held, size = [], 0
    yield held


def _digest(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def _buckets(held: list[np.ndarray]) -> list[np.ndarray]:
    """The BANDS fingerprints of each set; an empty one has none."""
    some = [i for i, h in enumerate(held) if len(h)]
    out = [np.zeros(0, np.int64)] * len(held)
    if some:
        flat = np.concatenate([held[i] for i in some])
        starts = np.concatenate([[0], np.cumsum([len(held[i]) for i in some])[:-1]])
        found = np.empty((len(some), BANDS), np.uint64)
        for band in range(BANDS):
            bucket = np.full(len(some), band + 1, np.uint64)
            for k in range(band * MINIMA, (band + 1) * MINIMA):
                x = (flat ^ _MIX[0, k]) * (_MIX[1, k] | np.uint64(1))
                x ^= x >> np.uint64(32)
                bucket = (bucket ^ np.minimum.reduceat(x, starts)) * np.uint64(0x9E3779B97F4A7C15)
                bucket ^= bucket >> np.uint64(29)
            found[:, band] = bucket
        for row, i in enumerate(some):
            out[i] = found[row].view(np.int64)
    return out


_MARKED = "row struct<file: long, at: long>, doc_id long, key binary, size long, fp long, buckets array<long>"


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """row, doc_id, key (a digest of the set of shingles), size, SimHash fingerprint and buckets of each of identified rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for held in _hashed(batch.column("text"), words):
                fps = pa.array(majority(held).view(np.int64))
                sets = [np.unique(h) for h in held]
                own = [batch.column(c).slice(at, len(held)) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), fps, pa.array(_buckets(sets), pa.list_(pa.int64()))], ["row", "doc_id", "key", "size", "fp", "buckets"])
                at += len(held)

    return rows.select("row", "doc.doc_id", "doc.text").mapInArrow(run, _MARKED)


def by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp, size), to be verified: nodes with one fingerprint, and the first nodes of
    fingerprints that operator 2 links."""
    some = nodes.where("size > 0")
    heads = settle(some.groupBy("fp").agg(F.min("node").alias("head")))
    same = joined_by(some.select("node", "fp"), heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    linked = settle(simhash_links(heads, RADIUS))
    a = linked.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
    both = joined_by(a, heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return same.unionByName(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) have a Jaccard similarity of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.unique(shingle_hashes(t.as_py() or "", words)) for t in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(same / (len(x) + len(y) - same) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    few = with_small(pairs, FEW_NODES)
    x = texts.withColumnRenamed("text", "x").join(few, F.col("node") == F.col("a")).select("a", "b", "x")
    y = texts.withColumnRenamed("text", "y").join(few, F.col("node") == F.col("b")).select("a", "b", "y")
    return x.join(y, ["a", "b"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def in_cells(rows: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) that join just what all similar pairs of a bucket in rows (bucket, n, node) join.

    A task has a bucket's texts, counts the shingles that they share and makes no rows of pairs. A bucket of over CELL
    nodes is cut into blocks, each two of which meet in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["bucket", "i", "j"]):
            cell = [group.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cuts = np.append(np.unique(group_starts(cell)), group.num_rows)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = group.slice(lo, hi - lo)
                node = part.column("node").to_numpy()
                held = [np.unique(shingle_hashes(t.as_py() or "", words)) for t in part.column("text")]
                size = np.array([len(h) for h in held])
                row = np.repeat(np.arange(len(held)), size)
                _, col = np.unique(np.concatenate(held), return_inverse=True)
                owners = row[np.argsort(col, kind="stable")]
                start = np.concatenate([[0], np.cumsum(np.bincount(col))])
                ends, a, b = np.cumsum(size), [], []
                for i in range(len(held)):
                    mine = col[ends[i] - size[i] : ends[i]]
                    same = np.bincount(np.concatenate([owners[start[c] : start[c + 1]] for c in mine]), minlength=len(held))
                    near = np.flatnonzero(same / (size[i] + size - same) >= least)
                    near = near[near > i]
                    a.append(np.full(len(near), node[i]))
                    b.append(node[near])
                x, y = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    blocks = F.ceil(F.col("n") / CELL).cast("int")
    block = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = block.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("node", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    placed = texts.join(with_small(settle(cells), FEW_NODES), "node").select("bucket", "i", "j", "node", "text")
    return placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def joined(nodes: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """node and component of each of nodes (node, first_row, size, fp, buckets) that is similar to another one.

    First the candidates of SimHash are tested, then nodes that share a bucket. Rounds test neighbours in a bucket, in
    another order each, and skip what is joined already, so most groups are joined at about the cost of their size. In
    buckets that still hold nodes not joined, all pairs of nodes are tested: as rows in buckets of up to SMALL nodes, else
    within a task."""
    order = Window.partitionBy("bucket").orderBy("node")
    rows = nodes.select("node", "size", F.explode("buckets").alias("bucket")).distinct()
    rows = settle(rows.select("*", F.lag("node").over(order).alias("before"), F.lead("node").over(order).alias("after")).where("before is not null or after is not null").select("bucket", "node", "size"))
    sizes = nodes.select("node", "size")
    likely = settle(by_simhash(nodes).distinct())
    active = rows.select("node").union(likely.select("a")).union(likely.select("b")).distinct().join(nodes.select("node", F.col("first_row").alias("row")), "node")
    texts = settle(docs.join(with_small(settle(active), FEW_NODES), "row").select("node", F.col("doc.text").alias("text")))
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * (least - 1e-9)
    both = likely.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("x")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("y")), "b")
    tested = settle(both.where(fits(F.col("x"), F.col("y"))).select("a", "b"))
    links = settle(verified(tested, texts, words, least))
    components = settle(connected_components(links))
    for k in range(ROUNDS + 1):
        now = rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n")
        now = settle(now.join(mixed, "bucket"))
        if k < ROUNDS:
            order = Window.partitionBy("bucket").orderBy(F.xxhash64("node", F.lit(k)), "node")
            near = now.select("*", *(F.lag(c).over(order).alias(f"{c}2") for c in ("node", "size", "component")))
        else:
            few = now.where(F.col("n") <= SMALL)
            near = few.join(few.select("bucket", *(F.col(c).alias(f"{c}2") for c in ("node", "size", "component"))), "bucket").where("node < node2")
        pairs = near.where((F.col("component") != F.col("component2")) & fits(F.col("size"), F.col("size2"))).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        pairs = settle(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(pairs)
        more = verified(pairs, texts, words, least)
        if k == ROUNDS and not (large := now.where(F.col("n") > SMALL)).isEmpty():
            more = more.unionByName(in_cells(large.select("bucket", "n", "node"), texts, words, least))
        more = settle(more)
        if not more.isEmpty():
            links = links.unionByName(more)
            components = settle(connected_components(links))
    return components


def _grouped(docs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """row, doc_id, component_id and best of each of identified rows: best is the row of its component that has the
    smallest doc_id, null last, and of rows with one id the first by file and place."""
    marked = settle(_marked(rows, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = settle(marked.groupBy("key").agg(first, *(F.first(c).alias(c) for c in ("size", "buckets")), F.min("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()).withColumn("first_row", F.col("first.row")))
    components = joined(nodes, rows, words, least)
    rooted = settle(nodes.select("key", "node", "first").join(components, "node", "left").select("key", "first", F.coalesce("component", "node").alias("component")))
    named = joined_by(rooted, rooted.groupBy("component").agg(F.min("first").alias("best")), "component")
    named = settle(named.select("key", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best")))
    return joined_by(marked.select("row", "doc_id", "key"), named, "key").select("row", "doc_id", "component_id", "best")


def clustered(docs: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id and component_id of each row of docs (doc_id, text).

    Rows with equal sets of shingles are one node; nodes link if the Jaccard similarity of their sets is at least
    `least`. component_id is the smallest doc_id reachable. Null and empty texts are one group; repeated rows link with
    each other; an empty table gives no rows; other columns are ignored."""
    path = shared_dir(docs.sparkSession)
    out = settle(_grouped(docs, identified(docs), words, least).select("doc_id", "component_id"), path)
    made_since(docs.sparkSession, path)
    return out


def one_of_each(docs: DataFrame, words: int, least: float) -> DataFrame:
    """docs with the best row of each group of near duplicates: that of the smallest doc_id, null last, and of several
    rows with that id the first by file and place. Rows, not ids, are compared, so unlike texts of one id both stay, as
    do those of null ids. An empty table gives no rows; any other columns are kept."""
    rows, path = identified(docs), shared_dir(docs.sparkSession)
    dropped = settle(_grouped(docs, rows, words, least).where("row <> best").select("row"), path)
    made_since(docs.sparkSession, path)
    return rows.join(with_small(dropped, FEW_NODES), "row", "left_anti").select("doc.*")

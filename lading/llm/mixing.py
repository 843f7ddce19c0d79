"""Operator 5, mixing sources to target weights: block quotas dealt to shards by a splitting tree of exact draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, identified, settle, with_small, words_sql

WEIGHTS = (1.0, 2.0, 3.0)
#: A source is taken at most so many times over.
MOST_TIMES = 3
#: Words in a block, and output shards (a power of two); a corpus of whole documents gets more shards, of so many rows.
BLOCK_WORDS = 256
SHARDS, SHARD_ROWS = 16, 65_536
SEED = 20240229
#: Blocks of one source that are ranked together in a task, about.
RANKED = 4_000
#: Rows of per-source or per-bucket tables, and of draws, that may be broadcast.
FEW, FEW_DRAWS = 100_000, 500_000
#: Up to this standard deviation a draw inverts its summed distribution; wider ones are drawn by rejection, exactly too.
WIDE = 200.0
#: Tries of a rejection; each succeeds with a chance of over a half, so all fail with one below 1 in 10 ** 18.
TRIES = 64
#: Sources that a fold of the tree adds to one array, so that appending takes linear time.
CHUNK = 256


def _unit(*salt) -> Column:
    """A number in (0, 1) that depends on the salt alone."""
    return (F.shiftrightunsigned(F.xxhash64(*(s if isinstance(s, Column) else F.lit(s) for s in salt)), 11).cast("double") + 0.5) / float(2**53)


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size and key of each row of docs, settled; see _sized()."""
    return _sized(identified(docs))


def _sized(rows: DataFrame) -> DataFrame:
    """row, doc_id, source, size (words of the whole text, null: 0) and key, a hash of the id, source and text, of each
    of identified rows, settled."""
    key = F.xxhash64(F.lit(SEED), "doc.doc_id", "doc.source", "doc.text").alias("key")
    return settle(rows.select("row", "doc.doc_id", "doc.source", F.expr(f"cast(size({words_sql('doc.text')}) as bigint)").alias("size"), key))


def targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: place (code point order, null last), source, source_size and target.

    Filling by water level: sources in order of size a weight stop at MOST_TIMES their size as long as the level that
    the rest would share lies above. A few numbers a source; only these meet in one task."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("place"), F.lit(len(WEIGHTS))) + 1)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by) - 1).withColumn("w", w)
    rows = rows.withColumn("most", F.col("source_size") * MOST_TIMES).withColumn("ratio", F.col("most") / F.col("w"))
    whole = Window.orderBy("ratio", "place")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    after = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") >= F.col("ratio"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return rows.select("place", "source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(shared * F.col("w")).alias("target"))


def blocks(sizes: DataFrame, block_words: int | None) -> DataFrame:
    """Every block of every document with words: (row, doc_id, source, block, words, rank, before).

    rank is the block's place in its source's permuted order, before the words of the blocks of lower rank. Ranks come
    from a hash cut into buckets: buckets' sums add up, and only a bucket's blocks are sorted together, so a source
    with a third of all blocks is ranked by many tasks. The hash is of id, source, text and block, not of the place in a
    file; rows that repeat so often that they crowd a bucket are alike, and are spread by their place."""
    if block_words:
        number = F.explode(F.expr(f"sequence(0L, (size - 1) div {block_words}L)"))
        rows = sizes.where("size > 0").select("*", number.alias("block")).withColumn("words", F.least(F.lit(block_words).cast("bigint"), F.col("size") - F.col("block") * block_words))
    else:
        rows = sizes.where("size > 0").withColumn("block", F.lit(0).cast("bigint")).withColumn("words", F.col("size"))
    rows = rows.select("row", "doc_id", "source", "block", "words", F.xxhash64("key", "block").alias("key"))
    buckets = max(1, rows.count() // RANKED)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    totals = lambda: settle(rows.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("sum")))
    sums = totals()
    crowded = sums.where(F.col("n") > 4 * RANKED).select("bucket").distinct()
    if not crowded.isEmpty():
        often = settle(rows.join(with_small(crowded, FEW), "bucket").groupBy("key").count().where(F.col("count") > RANKED).select("key", F.lit(True).alias("often")))
        rows = rows.join(with_small(often, FEW), "key", "left").withColumn("bucket", F.when(F.col("often"), F.pmod(F.xxhash64("key", "row"), F.lit(buckets))).otherwise(F.col("bucket"))).drop("often")
        sums = totals()
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.struct("source", "bucket").alias("g"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum0"))
    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "block", "row")
    ranked = rows.withColumn("r", F.row_number().over(own) - 1).withColumn("s", F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    joined = ranked.join(with_small(settle(base), FEW), F.struct("source", "bucket").eqNullSafe(F.col("g")))
    return joined.select("row", "doc_id", "source", "block", "words", (F.col("n0") + F.col("r")).alias("rank"), (F.col("sum0") + F.col("s")).alias("before"))


def _factorials_apart(a: Column, d: Column) -> Column:
    """ln((a + d)!) - ln(a!) by Stirling's series, put so that large terms don't cancel; both from ten on."""
    rest = lambda x: 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    a, d = a.cast("double"), d.cast("double")
    return (a + 0.5) * F.log1p(d / a) + d * (F.ln(a + d) - 1) + rest(a + d) - rest(a)


def _draw(total: Column, marked: Column, taken: Column, *salt) -> Column:
    """How many marked ones are among `taken` of `total`: an exact hypergeometric draw, the same for the same salt.

    Up to WIDE by inversion: the weights are summed by their recurrence over eight deviations about the mean. Wider ones
    by ratio of uniforms: a point of the hat's box, from hashed numbers, is taken if it lies under the distribution, whose
    logarithm follows from factorials; values of fewer than ten of a kind, whose chance is below 10 ** -300, are left out."""
    low, high = F.greatest(F.lit(0).cast("bigint"), taken - (total - marked)), F.least(marked, taken)
    mean = taken.cast("double") * marked / total
    variance = mean * (1 - marked / total) * (total - taken) / F.greatest(total - 1, F.lit(1))

    def inverted(d: Column) -> Column:
        span = F.sequence(F.greatest(d["low"], F.floor(d["mean"] - 8 * d["dev"] - 8)), F.least(d["high"], F.ceil(d["mean"] + 8 * d["dev"] + 8)))
        grow = lambda k: (marked - k).cast("double") * (taken - k) / ((k + 1).cast("double") * F.greatest(total - marked - taken + k + 1, F.lit(1)))
        one, none = F.lit(1.0), F.lit(0.0)
        whole = F.aggregate(span, F.struct(one.alias("p"), none.alias("s")), lambda a, k: F.struct((a["p"] * grow(k)).alias("p"), (a["s"] + a["p"]).alias("s")), lambda a: a["s"])
        return bind(whole * _unit("inverse", *salt), lambda want: F.aggregate(
            span, F.struct(one.alias("p"), none.alias("s"), d["high"].alias("x"), F.lit(False).alias("found")),
            lambda a, k: F.struct((a["p"] * grow(k)).alias("p"), (a["s"] + a["p"]).alias("s"), F.when(~a["found"] & (a["s"] + a["p"] >= want), k).otherwise(a["x"]).alias("x"), (a["found"] | (a["s"] + a["p"] >= want)).alias("found")),
            lambda a: a["x"],
        ))

    def rejected(d: Column) -> Column:
        mode = F.floor((taken + 1).cast("double") * (marked + 1) / (total + 2)).cast("bigint")
        width = F.sqrt(d["dev"] * d["dev"] + 0.5) * 1.7155277699214135 + 0.8989161620588988

        def under(m: Column, z: Column, u: Column) -> Column:
            t, rest = z - m, total - marked - taken
            least = F.least(z, marked - z, taken - z, rest + z)
            return (least >= 10) & (2 * F.ln(u) <= -(_factorials_apart(m, t) + _factorials_apart(marked - m, -t) + _factorials_apart(taken - m, -t) + _factorials_apart(rest + m, t)))

        def attempt(a: Column, k: Column) -> Column:
            u = _unit("under", k, *salt)
            z = F.floor(d["mean"] + 0.5 + width * (_unit("aside", k, *salt) - 0.5) / u).cast("bigint")
            return bind(F.struct(z.alias("z"), u.alias("u")), lambda p: F.when(under(a["x"], p["z"], p["u"]), F.struct(p["z"].alias("x"), F.lit(True).alias("found"))).otherwise(a))

        start = F.struct(mode.alias("x"), F.lit(False).alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), start, lambda a, k: F.when(a["found"], a).otherwise(attempt(a, k)), lambda a: a["x"])

    return bind(F.struct(low.alias("low"), high.alias("high"), mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("dev")), lambda d: F.when(d["low"] >= d["high"], d["low"]).when(d["dev"] > WIDE, rejected(d)).otherwise(inverted(d)))


_CUT = "struct<place:int,q:bigint,x:bigint>"


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, place, blocks) from quotas (place, quota): each shard's part of each source's exact quota.

    A tree: a node holds the quotas of its shards, half of the shards get half of its blocks, and how many of each
    source is a multivariate hypergeometric draw, source by source without replacement. A node is one row with a few
    bytes a source."""
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("place", F.col("quota").cast("bigint").alias("q")))).alias("qs")).select(F.lit(0).alias("shard"), "qs")
    width = shards
    while width > 1:
        width //= 2

        def one(a: Column, x: Column, at: int) -> Column:
            drawn = F.when(a["total"] > 0, _draw(a["total"], x["q"], a["left"], SEED, at, F.col("shard"), x["place"])).otherwise(F.lit(0).cast("bigint"))
            return bind(drawn, lambda n: F.struct((a["total"] - x["q"]).alias("total"), (a["left"] - n).alias("left"), F.concat(a["out"], F.array(F.struct(x["place"].alias("place"), x["q"].alias("q"), n.alias("x")))).alias("out")))

        def cut(qs: Column, at: int = width) -> Column:
            total = F.aggregate(qs, F.lit(0).cast("bigint"), lambda a, x: a + x["q"])
            state = lambda total, left, kind: F.struct(total.alias("total"), left.alias("left"), F.array().cast(kind).alias("out"))
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(qs) - 1) / CHUNK).cast("int")), lambda c: F.slice(qs, c * CHUNK + 1, CHUNK))
            inner = lambda a, part: F.aggregate(part, state(a["total"], a["left"], f"array<{_CUT}>"), lambda b, x: one(b, x, at))
            outer = lambda a, part: bind(inner(a, part), lambda b: F.struct(b["total"].alias("total"), b["left"].alias("left"), F.concat(a["out"], F.array(b["out"])).alias("out")))
            folded = lambda t: F.aggregate(chunks, state(t, F.floor(t / 2), f"array<array<{_CUT}>>"), outer, lambda a: F.flatten(a["out"]))
            return F.when(F.size(qs) > 0, bind(total, folded)).otherwise(F.array().cast(f"array<{_CUT}>"))

        split = node.select("shard", cut(F.col("qs")).alias("cut"))
        half = lambda f: F.transform("cut", lambda x: F.struct(x["place"].alias("place"), f(x).alias("q")))
        pair = F.array(F.struct(F.col("shard").alias("shard"), half(lambda x: x["x"]).alias("qs")), F.struct((F.col("shard") + width).alias("shard"), half(lambda x: x["q"] - x["x"]).alias("qs")))
        node = split.select(F.explode(pair).alias("n")).select("n.*")
    return node.select("shard", F.explode("qs").alias("x")).select("shard", "x.place", F.col("x.q").alias("blocks"))


def mix(sizes: DataFrame, block_words: int | None = BLOCK_WORDS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(draws, targets) for sizes as of sized().

    draws has a row for each block that the mix takes, once for each time: row, doc_id, source, block, words, epoch,
    shard and order (blocks of a shard, sorted by it, are shuffled). A source's quota of blocks is what comes nearest to
    its target: whole runs through its permuted order, then as far as the rest goes. The tree splits the quotas among
    the shards, and each shard draws the run of that sequence that its own quotas mark, disjoint from all others; what
    no shard's quota covers isn't taken. The same rows give the same draws; a source without words gets none; an empty
    table gives no rows."""
    aims = settle(targets(sizes))
    few = with_small(aims, FEW)
    ranked = blocks(sizes, block_words)
    joined = ranked.join(few.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    more = F.col("before") + F.col("words") / 2 <= F.col("target") - F.col("times") * F.col("source_size")
    held = settle(joined.withColumn("times", times).select("row", "doc_id", "source", "place", "block", "words", "rank", "times", more.alias("more")))
    quotas = settle(held.groupBy("place").agg(F.count("*").alias("n"), (F.max("times") * F.count("*") + F.count_if("more")).alias("quota")))
    shares = settle(split_quotas(quotas, shards))
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = shares.withColumn("end", F.sum("blocks").over(upto)).groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    runs = with_small(settle(ends.join(quotas.select("place", "n"), "place")), FEW)
    last = F.element_at("ends", -1)
    drawn = held.drop("times", "more").join(runs, "place").where(F.col("rank") < last)
    drawn = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((last - 1 - F.col("rank")) / F.col("n")).cast("bigint"))).alias("epoch"))
    at = F.col("epoch") * F.col("n") + F.col("rank")
    shard = F.size(F.filter("ends", lambda e: e <= at))
    return drawn.select("row", "doc_id", "source", "block", "words", "epoch", shard.alias("shard"), F.xxhash64(F.lit(SEED + 1), "place", at).alias("order")), aims


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (those that drew from it, comma-joined) of each row of docs
    (doc_id, source, text).

    A null or empty text has size 0 and is not taken; a null source is a source, the last one; repeated rows are drawn
    each; other columns are ignored; an empty table gives no rows."""
    sizes = sized(docs)
    draws, aims = mix(sizes)
    taken = draws.groupBy("row").agg(F.sum("words").alias("taken"), F.array_join(F.array_sort(F.collect_set("shard")), ",").alias("shards"))
    rows = sizes.join(with_small(aims, FEW).select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def mixed(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """docs as the mix has them: whole documents, each as often as it is drawn, with all their columns.

    A partition is a shard, and its rows are shuffled: written, each shard is a file. Documents without words are in
    none. Texts travel once, to their shards, unless there are too many draws to broadcast."""
    rows = identified(docs)
    sizes = _sized(rows)
    if shards is None:
        shards = max(SHARDS, 1 << (sizes.count() // SHARD_ROWS).bit_length())
    draws, _ = mix(sizes, None, shards)
    to = settle(draws.groupBy("row").agg(F.collect_list(F.struct("shard", "order")).alias("to")))
    placed = rows.join(with_small(to, FEW_DRAWS), "row").select("doc", F.explode("to").alias("to")).select("doc", "to.shard", "to.order")
    return placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "order").select("doc.*")

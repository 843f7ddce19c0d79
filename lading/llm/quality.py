"""Operator 6, quality rules: thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, with_small, words_sql

#: Relative error of a quantile from the sketch.
ERROR = 0.02
#: For each measure: the least spread that counts, and whether low values are outliers too.
MEASURES = {"symbols_a_word": (0.1, False), "word_length": (1.0, True), "dup_lines": (0.15, False), "repeats": (0.15, False)}
#: So many spreads beyond the quartiles is an outlier.
FENCE = 3.0
#: Groups whose thresholds may be broadcast; beyond, the join is an ordinary one.
FEW_GROUPS = 50_000

#: Bits by which windows' hashes are shortened further; tests set it to have many of them equal.
SHORTENED = 0

#: One struct a text: w are its words; s has a long for each window, the upper bits of its hash above its place, sorted.
#: Neighbours in s with one hash are a pair, by their places. Where a pair's words differ, which takes two windows of one
#: hash, the pairs are had from windows sorted by their words instead, so repeats are exact.
_MEASURED = r"""
transform(array({words}), w -> named_struct(
  'n_words', cast(size(w) as bigint),
  'word_chars', cast(char_length(array_join(w, '')) as bigint),
  'n_symbols', cast(regexp_count(coalesce({text}, ''), r'[#*$%&|<>]') as bigint),
  'lines', transform(array(filter(split(coalesce({text}, ''), '\n'), x -> x rlike r'[^\x20\x09-\x0D]')), l ->
      named_struct('all', cast(size(l) as bigint), 'dup', cast(size(l) - size(array_distinct(l)) as bigint)))[0],
  'n_repeat_words', if(size(w) < 4, 0L, transform(array(length(bin(size(w))) + {shortened}), b ->
    transform(array(sort_array(transform(slice(w, 1, size(w) - 2), (x, i) -> shiftleft(xxhash64(x, w[i + 1], w[i + 2]), b) | i))), s ->
      transform(array(transform(
          array_compact(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (x, y) -> if(shiftrightunsigned(x ^ y, b) = 0, array(x, y), null))),
          p -> transform(p, x -> cast(x & (shiftleft(1L, b) - 1) as int)))), ps ->
        aggregate(
          sort_array(flatten(if(
            exists(ps, p -> w[p[0]] <> w[p[1]] or w[p[0] + 1] <> w[p[1] + 1] or w[p[0] + 2] <> w[p[1] + 2]),
            transform(array(sort_array(transform(slice(w, 1, size(w) - 2), (x, i) -> named_struct('x', x, 'y', w[i + 1], 'z', w[i + 2], 'i', i)))), e ->
              array_compact(zip_with(slice(e, 1, size(e) - 1), slice(e, 2, size(e) - 1), (p, q) -> if(p.x = q.x and p.y = q.y and p.z = q.z, array(p.i, q.i), null))))[0],
            ps))),
          named_struct('n', 0L, 'to', 0),
          (a, p) -> named_struct('n', a.n + 3L - greatest(0, least(3, a.to - p)), 'to', p + 3),
          a -> a.n))[0])[0])[0])
))[0]
"""


def measured(text: str = "text") -> Column:
    """A struct of n_words, word_chars, n_symbols, lines (all, dup) and n_repeat_words of a whole text column."""
    return F.expr(_MEASURED.format(text=text, words=words_sql(text), shortened=SHORTENED))


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The measures of each document beside the columns in keep; a null text counts as empty.

    base_failed and kept by the base rules follow the fixed limits; lang and source stay for grouping."""
    rows = docs.select(*keep, measured("text").alias("m"))
    m = F.col("m")
    return rows.select(
        *keep,
        *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols")),
        m["lines"]["all"].alias("n_lines"), m["lines"]["dup"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
    )


def _values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_a_word": F.col("n_symbols") / words,
        "word_length": F.col("word_chars") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }


def sketch(measures: DataFrame, *by: str) -> DataFrame:
    """A quantile sketch for each group and measure: rows (by, measure, bucket, n).

    Buckets grow by a fixed factor, so a bucket's middle is within ERROR of each of its values, and sketches merge by
    adding counts: exact, in any order. A group has a few hundred buckets at most, however many rows it has."""
    grow = math.log((1 + ERROR) / (1 - ERROR))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in _values().items()))).alias("p")
    bucket = F.when(F.col("p.value") > 0, F.ceil(F.ln(F.col("p.value")) / grow).cast("int")).otherwise(F.lit(-(2**30)))
    return measures.select(*by, pairs).groupBy(*by, F.col("p.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketched: DataFrame, *by: str) -> DataFrame:
    """Rows (by, measure, q1, q3) from a sketch."""
    grow = (1 + ERROR) / (1 - ERROR)
    value = lambda b: F.when(b <= -(2**30), 0.0).otherwise(F.pow(F.lit(grow), b) * (2 / (grow + 1)))
    held = sketched.groupBy(*by, "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("held"), F.sum("n").alias("total"))
    at = lambda share: F.aggregate(
        "held", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bucket")),
        lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bucket"].isNull() & (a["seen"] + x["n"] >= F.col("total") * share), x["bucket"]).otherwise(a["bucket"]).alias("bucket")),
        lambda a: value(a["bucket"]),
    )
    return held.select(*by, "measure", at(0.25).alias("q1"), at(0.75).alias("q3"))


def thresholds(measures: DataFrame, *by: str) -> DataFrame:
    """A row for each group with low_<measure> and high_<measure>, FENCE spreads beyond the group's quartiles."""
    rows = quartiles(sketch(measures, *by), *by)
    picked = []
    for name, (least, low) in MEASURES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * FENCE
        mine = F.col("measure") == name
        picked.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"high_{name}"))
        if low:
            picked.append(F.max(F.when(mine, F.col("q1") - spread)).alias(f"low_{name}"))
    return rows.groupBy(*by).agg(*picked)


def judge(measures: DataFrame) -> DataFrame:
    """measures (settled, with lang and source) with base_failed and kept.

    The thresholds of a document's language and source are joined to it: by broadcast where the groups are counted to
    be few, else by an ordinary join, whose large partitions Spark splits. A null language or source is a group of its
    own. A document is kept unless it fails a base limit or lies outside a fence."""
    limits = with_small(settle(thresholds(measures, "lang", "source")).select(F.struct("lang", "source").alias("g"), "*").drop("lang", "source"), FEW_GROUPS)
    joined = measures.join(limits, F.struct("lang", "source").eqNullSafe(F.col("g")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    outside = F.lit(False)
    for name, (_, low) in MEASURES.items():
        value = _values()[name]
        outside = outside | (value > F.col(f"high_{name}"))
        if low:
            outside = outside | (value < F.col(f"low_{name}"))
    return joined.select(*measures.columns, failed.alias("base_failed"), (~failed & ~F.coalesce(outside, F.lit(False))).alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): the measures, base_failed and kept.

    Empty and null texts have no words and fail; repeated rows are judged each, ties at a fence are kept, and very long
    texts are measured whole, in the time of sorting their words; an empty table gives no rows; other columns are ignored."""
    return judge(settle(measure(docs, "doc_id", "lang", "source")))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Texts travel once, as part of the settled rows, so that judging them needs no second pass and no shuffle of texts."""
    held = settle(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "lang", "source", measured("text").alias("m")))
    m = F.col("m")
    measures = held.select("row", "lang", "source", *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")), m["lines"]["all"].alias("n_lines"), m["lines"]["dup"].alias("n_dup_lines"))
    return judge(measures).where("kept").select("row.*")

"""Ordered derivations as windows, pairings as joins, summaries as aggregates. Every window is partitioned by archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag


def _in(archive: str, *order: str):
    return Window.partitionBy(archive).orderBy(*order)


# Windows


def with_index(entries: DataFrame, archive: str = "archive", *order: str) -> DataFrame:
    """idx: the place of an entry among the archive's, from 0."""
    return entries.withColumn("idx", F.row_number().over(_in(archive, *order)) - 1)


def solid_runs(entries: DataFrame, object_: str, archive: str = "archive", idx: str = "idx") -> DataFrame:
    """Neighbours with one object are a run; none, or another, ends it. A run's first entry isn't marked, later ones are
    and know the first; each but the last knows the next."""
    w = _in(archive, idx)
    same = F.coalesce(F.col(object_) == F.lag(object_).over(w), F.lit(False))
    rows = entries.withColumn("_same", same)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(w))
    first = F.min(idx).over(Window.partitionBy(archive, "_run"))
    after = F.when(F.lead("_same").over(w), F.lead(idx).over(w))
    rows = rows.withColumn("is_solid", F.when(F.col("_same"), True)).withColumn("first_solid_idx", F.when(F.col("_same"), first)).withColumn("next_solid_idx", after)
    return rows.drop("_same", "_run")


def solid_offsets(entries: DataFrame, run: str, size: str = "file_size", archive: str = "archive", idx: str = "idx") -> DataFrame:
    """solid_offset: the sizes before in the same run."""
    w = Window.partitionBy(archive, run).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("solid_offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def running_total(entries: DataFrame, size: str = "file_size", archive: str = "archive", idx: str = "idx") -> DataFrame:
    """progress: the sizes so far, this entry's included."""
    return entries.withColumn("progress", F.sum(size).over(_in(archive, idx).rowsBetween(Window.unboundedPreceding, 0)))


def carried_forward(entries: DataFrame, value: str, archive: str = "archive", idx: str = "idx") -> DataFrame:
    """carried: the last value that isn't null, here or before."""
    return entries.withColumn("carried", F.last(value, ignorenulls=True).over(_in(archive, idx).rowsBetween(Window.unboundedPreceding, 0)))


def inferred_directories(entries: DataFrame, name: str = "name", archive: str = "archive", idx: str = "idx") -> DataFrame:
    """inferred_directory: the next name goes on below this one."""
    return entries.withColumn("inferred_directory", F.coalesce(F.lead(name).over(_in(archive, idx)).startswith(F.concat(name, F.lit("/"))), F.lit(False)))


def numbered_names(entries: DataFrame, name: str = "name", archive: str = "archive", idx: str = "idx") -> DataFrame:
    """unique_name: the first of a name keeps it, others get .1, .2 and so on."""
    n = F.row_number().over(Window.partitionBy(archive, name).orderBy(idx)) - 1
    return entries.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") > 0, F.concat_ws(".", name, F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def renamed(entries: DataFrame, name: str = "name", archive: str = "archive", idx: str = "idx") -> DataFrame:
    """new_name: later files of a name get -1, -2 before the extension."""
    n = F.row_number().over(Window.partitionBy(archive, name).orderBy(idx)) - 1
    stem, ending = F.regexp_extract(name, r"(?s)^(.+?)(\.[^./]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^./]*)?$", 2)
    return entries.withColumn("_n", n).withColumn("new_name", F.when(F.col("_n") > 0, F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ending)).otherwise(F.col(name))).drop("_n")


def method_codes(methods: DataFrame, name: str = "compression") -> DataFrame:
    """code: the first letters of a method's words, four at most; of methods that share one the later ones get a number
    in place of its last letters. A method whose own letters look like that may still share its code."""
    code = F.substring(F.regexp_replace(F.initcap(name), r"[^A-Z0-9]", ""), 1, 4)
    rows = methods.select(name).distinct().withColumn("code", F.rpad(code, 4, "-"))
    n = F.row_number().over(Window.partitionBy("code").orderBy(name)) - 1
    digits = F.col("_n").cast("string")
    return rows.withColumn("_n", n).withColumn("code", F.when(F.col("_n") > 0, F.concat(F.expr("substring(code, 1, greatest(4 - length(cast(_n as string)), 0))"), digits)).otherwise(F.col("code"))).drop("_n")


# Joins


def paired_forks(entries: DataFrame, archive: str = "archive", path: str = "name", fork: str = "is_resource_fork", idx: str = "idx") -> DataFrame:
    """Data and resource forks of a path side by side (data_idx, resource_idx): a fork fills the empty place of the
    latest row of its path, or begins a new row. In a run of forks that alternate, each two are a row."""
    w = Window.partitionBy(archive, path).orderBy(idx)
    rows = entries.select(archive, path, idx, flag(F.col(fork)).alias("_fork"))
    rows = rows.withColumn("_new", F.when(F.col("_fork") == F.lag("_fork").over(w), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    rows = rows.withColumn("_row", F.floor((F.row_number().over(Window.partitionBy(archive, path, "_run").orderBy(idx)) - 1) / 2))
    return rows.groupBy(archive, path, "_run", "_row").agg(F.min(F.when(~F.col("_fork"), F.col(idx))).alias("data_idx"), F.min(F.when(F.col("_fork"), F.col(idx))).alias("resource_idx")).drop("_run", "_row")


def apple_doubles(entries: DataFrame, archive: str = "archive", path: str = "name", idx: str = "idx") -> DataFrame:
    """archive, idx and file_idx of each ._ entry: the file whose resource fork and attributes it holds. That is the last
    entry before with the path without ._ (and without __MACOSX/ in front), else the next one, else none."""
    name = F.regexp_extract(path, r"(?s)([^/]*)$", 1)
    target = F.regexp_replace(F.regexp_replace(path, r"(?s)^__MACOSX/", ""), r"(?s)(^|/)\._([^/]*)$", "$1$2")
    rows = entries.select(archive, idx, name.startswith("._").alias("_double"), F.when(name.startswith("._"), target).otherwise(F.regexp_replace(path, "/$", "")).alias("_path"))
    file = F.when(~F.col("_double"), F.col(idx))
    w = Window.partitionBy(archive, "_path").orderBy(idx)
    before = F.last(file, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(file, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("file_idx", F.coalesce(before, after)).where("_double").select(archive, idx, "file_idx")


def without_macosx(entries: DataFrame, path: str = "name", directory: str = "is_directory") -> DataFrame:
    """Without the directory __MACOSX itself; what lies in it is paired by apple_doubles()."""
    return entries.where(~(flag(F.col(directory)) & F.regexp_replace(path, "/$", "").eqNullSafe("__MACOSX")))


def merged_forks(pairs: DataFrame, entries: DataFrame, columns: list[str], archive: str = "archive", path: str = "name", idx: str = "idx") -> DataFrame:
    """A row a file of paired_forks(): the columns as the resource fork has them, else as the data fork has."""
    d = entries.select(archive, F.col(idx).alias("data_idx"), *(F.col(c).alias(f"_d_{c}") for c in columns))
    r = entries.select(archive, F.col(idx).alias("resource_idx"), *(F.col(c).alias(f"_r_{c}") for c in columns))
    both = pairs.join(d, [archive, "data_idx"], "left").join(r, [archive, "resource_idx"], "left")
    return both.select(archive, path, "data_idx", "resource_idx", *(F.coalesce(f"_r_{c}", f"_d_{c}").alias(c) for c in columns))


def with_ordinal(rows: DataFrame, stream: str, *order: str) -> DataFrame:
    """ordinal: the place of a fork in its stream, from 0."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(stream).orderBy(*order)) - 1)


def last_reference(items: DataFrame, references: DataFrame, key: str, place: str) -> DataFrame:
    """items with the last place that refers to each, or none."""
    return items.join(references.groupBy(key).agg(F.max(place).alias(place)), key, "left")


def moved(entries: DataFrame, renames: DataFrame, path: str = "name") -> DataFrame:
    """entries with new_path: a rename (old, new) of a leading folder, of one or more parts, holds for all below it; the
    longest one wins. Each path is joined by its prefixes, so no pairs are made."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = entries.withColumn("_row", F.monotonically_increasing_id())
    found = rows.select("_row", F.explode(prefixes).alias("old")).join(renames.select("old", "new"), "old")
    best = found.groupBy("_row").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("_best"))
    new = F.concat(F.col("_best.new"), F.substring(F.col(path), F.length("_best.old") + 1, F.length(path)))
    return rows.join(best, "_row", "left").withColumn("new_path", F.coalesce(new, F.col(path))).drop("_row", "_best")


def answered(responses: DataFrame, requests: DataFrame, key: str, order: str) -> DataFrame:
    """Each response with the last request of its key, or none."""
    last = requests.groupBy(key).agg(F.max_by(F.struct(*[c for c in requests.columns if c != key]), order).alias("request"))
    return responses.join(last, key, "left")


def located(points: DataFrame, ranges: DataFrame, group: str, at: str, start: str) -> DataFrame:
    """As-of: each point with the range of its group that starts last at or before it. One sort of both sides together:
    starts are carried forward to the points behind them, so no pairs are made."""
    a = ranges.select(group, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(*[c for c in ranges.columns if c != group]).alias("_range"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point"))
    b = points.select(group, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_range"].dataType).alias("_range"), F.struct(*points.columns).alias("_point"))
    w = Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_range", F.last("_range", ignorenulls=True).over(w)).where("_kind = 1")
    return rows.select("_point.*", F.col("_range").alias("range"))


def not_there(entries: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    return entries.join(listing.select(path).distinct(), path, "left_anti")


def there(entries: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    return entries.join(listing.select(path).distinct(), path, "left_semi")


def tree_paths(nodes: DataFrame, depth: int, key: str = "id", above: str = "parent", name: str = "name") -> DataFrame:
    """Paths of nodes that know their parent, level by level; a bound on the depth ends cycles. All levels merge with one
    exchange of the nodes: these aren't broadcast, which would have each task hold them whole, level after level."""
    level = nodes.where(F.col(above).isNull()).select(F.col(key).alias("id"), F.col(name).alias("path"), F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        level = nodes.join(level.select(F.col("id").alias(above), F.col("path").alias("_p")).hint("merge"), above).select(F.col(key).alias("id"), F.concat_ws("/", "_p", name).alias("path"), F.lit(k).alias("depth"))
        out = out.unionByName(level)
    return out


# Aggregates


def total_size(size: Column, ignore_unknown: bool = False) -> Column:
    """The sum of sizes; -1 if one of them is unknown, unless these are ignored."""
    whole = F.coalesce(F.sum(size), F.lit(0))
    return whole if ignore_unknown else F.when(F.count_if(size.isNull()) > 0, F.lit(-1)).otherwise(whole)


def shared_top(path: Column, first: Column) -> Column:
    """The one first part that all paths have, or null. first: of the first entry: it must have a slash or be a directory."""
    top = F.element_at(F.split(path, "/"), 1)
    return F.when((F.count_distinct(top) == 1) & F.bool_or(first), F.min(top))


def verdict_counts(entries: DataFrame, *by: str) -> DataFrame:
    """passed (directories and links count as that), failed and unknown."""
    passed = F.col("status").isin("ok", "not_tested")
    failed = F.col("status").isin("damaged", "checksum", "password", "unsupported")
    return entries.groupBy(*by).agg(F.count_if(passed).alias("passed"), F.count_if(failed).alias("failed"), F.count_if(~passed & ~failed).alias("unknown"))


def extraction_total(size: Column, directory: Column) -> Column:
    """The sum of sizes that extraction writes: directories don't count, an unknown size makes it -1."""
    kept = ~flag(directory)
    return F.when(F.count_if(kept & size.isNull()) > 0, F.lit(-1)).otherwise(F.coalesce(F.sum(F.when(kept, size)), F.lit(0)))


def any_flag(column: Column) -> Column:
    """Whether a flag is set for any entry; unknown ones are not."""
    return F.coalesce(F.bool_or(flag(column)), F.lit(False))


def prorated(entries: DataFrame, folder: str, size: str, packed: str) -> DataFrame:
    """packed_share: a folder's packed size, dealt to its entries by their sizes."""
    whole = F.sum(size).over(Window.partitionBy(folder))
    return entries.withColumn("packed_share", F.when(whole > 0, F.floor(F.col(packed) * F.col(size) / whole)).otherwise(0).cast("bigint"))


def overlaid(under: Column, over: Column) -> Column:
    """The entries of two maps; where both have a key, the second one's."""
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def sorted_keys(values: Column) -> Column:
    return F.array_sort(F.map_keys(values))


def representative_size(size: Column, packed: Column) -> Column:
    """A size to weigh an entry by: its own, else what it takes up, else 1000."""
    return F.coalesce(size, packed, F.lit(1000).cast("bigint"))


def legend(compression: Column) -> Column:
    return F.array_sort(F.collect_set(compression))


# Sorts


def volume_order(name: Column, first: Column) -> list[Column]:
    """The first volume, then by name without regard to case."""
    return [first.desc(), F.lower(name).asc()]


def directory_order(path: Column, fork: Column) -> list[Column]:
    """Deepest first, data before resource forks."""
    return [F.size(path).desc(), flag(fork).asc()]

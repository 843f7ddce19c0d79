"""Extraction: entries with content written below a folder, safe names only, by the tasks that hold them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag, fork_path, sanitised, unsafe_link, without_extension

POLICIES = ("overwrite", "skip", "rename")


def planned(entries: DataFrame, forks: str = "visible", on_collision: str = "rename", enclosing: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """entries with target, where each goes, and action: file, directory, link, unsafe_link or skip.

    Each archive has a folder of its own unless all it holds is below one part. Of several entries with one target the
    last stays (overwrite), the first (skip), or later ones get -1, -2 … (rename), as far as it takes to be a target that
    neither another entry nor existing (path, what is there already) has. With skip, what exists stays too."""
    if on_collision not in POLICIES:
        raise ValueError(f"on_collision is one of {', '.join(POLICIES)}")
    inner = fork_path(sanitised(F.col("path")), F.col("is_resource_fork"), forks)
    rows = entries.withColumn("_inner", inner).where("_inner is not null")
    own = without_extension(F.regexp_extract("archive", r"([^/]*)$", 1))
    if enclosing:
        top = F.element_at(F.split("_inner", "/"), 1)
        tops = rows.groupBy("archive").agg((F.min(top) != F.max(top)).alias("_many"))
        rows = rows.join(tops, "archive").withColumn("target", F.when(F.col("_many"), F.concat(own, F.lit("/"), "_inner")).otherwise(F.col("_inner"))).drop("_many")
    else:
        rows = rows.withColumn("target", F.col("_inner"))
    kind = F.when(flag(F.col("is_directory")), "directory").when(F.col("link_destination").isNotNull(), F.when(unsafe_link(F.col("link_destination")), "unsafe_link").otherwise("link")).otherwise("file")
    rows = rows.withColumn("action", kind).drop("_inner")
    there = existing.select(F.col("path").alias("target")).distinct().withColumn("_there", F.lit(True)) if existing is not None else None
    rows = rows.join(there, "target", "left") if there is not None else rows.withColumn("_there", F.lit(None).cast("boolean"))
    w = Window.partitionBy("target", F.col("action") == "directory").orderBy("archive", "idx")
    rows = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("_left", F.lead("idx").over(w).isNotNull())
    taken = flag(F.col("_there"))
    again = (F.col("action") != "directory") & ((F.col("_n") > 0) | taken)
    if on_collision == "rename":
        return _renamed(rows, again, F.col("_n") + F.when(taken, 1).otherwise(0), there).drop("_n", "_left", "_there")
    drop = again if on_collision == "skip" else (F.col("action") != "directory") & F.col("_left")
    return rows.withColumn("action", F.when(drop, "skip").otherwise(F.col("action"))).drop("_n", "_left", "_there")


def _renamed(rows: DataFrame, again: Column, nth: Column, there: DataFrame | None) -> DataFrame:
    """rows whose targets are all different: the k-th of a name that must be renamed gets the k-th number that is free.

    Numbers in use are those that other targets of the same stem and ending have; they are gathered for each stem, a few
    numbers each, and joined, so rows aren't compared with each other."""
    split = r"(?s)^(.*/)?(.[^/]*?)(?:-([0-9]{1,9}))?(\.[^./]*)?$"
    part = lambda k: F.regexp_extract("target", split, k)
    whole = F.regexp_extract("target", r"(?s)^((?:.*/)?.[^/]*?)(\.[^./]*)?$", 1)
    ending = F.regexp_extract("target", r"(?s)^((?:.*/)?.[^/]*?)(\.[^./]*)?$", 2)
    rows = rows.withColumn("_again", again).withColumn("_k", nth)
    all_ = rows.select("target") if there is None else rows.select("target").unionByName(there.select("target"))
    used = all_.where(part(3) != "").select(F.concat(part(1), part(2)).alias("_stem"), part(4).alias("_ending"), part(3).cast("int").alias("_used"))
    used = used.groupBy("_stem", "_ending").agg(F.collect_set("_used").alias("_used"))
    joined = rows.withColumn("_stem", F.when(F.col("_again"), whole)).withColumn("_ending", ending).join(used, ["_stem", "_ending"], "left")
    taken = F.coalesce("_used", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(1), F.col("_k") + F.size(taken)), taken)
    new = F.concat("_stem", F.lit("-"), F.element_at(free, F.col("_k").cast("int")).cast("string"), "_ending")
    return joined.withColumn("target", F.when(F.col("_again"), new).otherwise(F.col("target"))).drop("_again", "_k", "_stem", "_ending", "_used")


#: Results of contents that are written; others leave no file.
_WRITTEN = ("ok", "not_tested", "checksum", "damaged")


def written(plan: DataFrame, folder: str) -> DataFrame:
    """Write planned entries (with content and status) below a folder, a URI that all executors reach, and return
    archive, idx, target and result.

    A file is written under a name of the attempt's own and renamed into place, so tasks that run again, or twice at once,
    do no harm. A damaged entry of which nothing came out leaves no file. On a local file system modes and times follow
    the entry; those of directories are set by with_directory_attributes(), once all is written. Links come back as
    results link and unsafe_link: object stores have none, so they aren't made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            results = []
            for row in batch.to_pylist():
                place, result = f"{top}/{row['target']}", row["action"]
                if result == "directory":
                    fs.create_dir(place, recursive=True)
                elif result == "file" and row["status"] in _WRITTEN and not (row["status"] == "damaged" and not row["content"]):
                    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    part = f"{place}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as out:
                        out.write(row["content"] or b"")
                    _attributes(fs, part, row)
                    fs.move(part, place)
                    result = "file" if row["status"] in ("ok", "not_tested") else row["status"]
                elif result == "file":
                    result = row["status"]
                results.append(result)
            yield pa.RecordBatch.from_arrays([batch.column("archive"), batch.column("idx"), batch.column("target"), pa.array(results, pa.string())], ["archive", "idx", "target", "result"])

    return plan.select("archive", "idx", "target", "action", "status", "content", "posix_permissions", "mtime").mapInArrow(run, "archive string, idx int, target string, result string")


def _attributes(fs, place: str, row: dict) -> None:
    """Permissions (no set-id bits) and time of last change, on a local file system."""
    if isinstance(fs, pafs.LocalFileSystem):
        if row["posix_permissions"] is not None:
            os.chmod(place, row["posix_permissions"] & 0o777 | (0o700 if os.path.isdir(place) else 0o600))
        if row["mtime"] is not None:
            os.utime(place, (row["mtime"].timestamp(),) * 2)


def with_directory_attributes(plan: DataFrame, folder: str) -> DataFrame:
    """Set what planned directories have as modes and times, the deepest of an archive first; call it after written()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{top}/{row['target']}").type == pafs.FileType.Directory:
                    _attributes(fs, f"{top}/{row['target']}", row)
            yield batch.select(["archive", "idx", "target"])

    rows = plan.where("action = 'directory'").repartition("archive").sortWithinPartitions("archive", F.size(F.split("target", "/")).desc())
    return rows.select("archive", "idx", "target", "posix_permissions", "mtime").mapInArrow(run, "archive string, idx int, target string")


def failed_files(results: DataFrame) -> DataFrame:
    """Files that failed, of each archive."""
    bad = ~F.col("result").isin("file", "directory", "link", "skip")
    return results.groupBy("archive").agg(F.count_if(bad).alias("failed"))

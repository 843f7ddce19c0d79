"""Listings of entries: short, medium and long lines, key and value rows, and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import carets, flag, permissions, ratio, short_size, utc_minute

#: Labels of the key and value listing, in their order.
LABELS = {"name": "Name", "comment": "Comment", "file_size": "Size", "compressed_size": "Compressed size", "compression": "Compression type", "is_directory": "Is a directory", "is_link": "Is a link", "link_destination": "Link destination", "is_encrypted": "Is encrypted", "mtime": "Last modified", "created": "Created", "posix_permissions": "Unix permissions", "user_name": "User", "group_name": "Group"}


def short_line() -> Column:
    return F.concat(carets(F.col("name")), F.when(flag(F.col("is_directory")), "/").otherwise(""))


def medium_line() -> Column:
    tags = F.array_compact(F.array(
        F.when(flag(F.col("is_directory")), "dir").when(flag(F.col("is_link")), "link").otherwise(F.coalesce(F.col("file_size").cast("string"), F.lit("?"))),
        F.when(flag(F.col("is_resource_fork")), "rsrc"), F.when(flag(F.col("is_corrupted")), "corrupted"),
    ))
    return F.concat(short_line(), F.lit("  ("), F.array_join(tags, ", "), F.lit(")"))


def long_line(code: Column) -> Column:
    """Index, flags (directory, resource fork, link, encrypted, corrupted), size, ratio, method code, date in UTC and name."""
    flags = F.concat(*(F.when(flag(F.col(c)), letter).otherwise("-") for c, letter in (("is_directory", "D"), ("is_resource_fork", "R"), ("is_link", "L"), ("is_encrypted", "E"), ("is_corrupted", "@"))))
    saved = F.coalesce(F.format_string("%.1f%%", ratio(F.col("file_size"), F.col("compressed_size"))), F.lit("-----"))
    when = F.coalesce(utc_minute(F.coalesce("mtime", "created", "atime")), F.lit("----------------"))
    return F.concat_ws("  ", F.col("idx").cast("string"), flags, F.coalesce(F.col("file_size").cast("string"), F.lit("?")), saved, code, when, F.concat(short_line(), F.coalesce(F.concat(F.lit(" -> "), "link_destination"), F.lit(""))))


def described(entries: DataFrame) -> DataFrame:
    """archive, idx, rank, label and value of each known property: a row a property."""
    shown = {"file_size": F.concat(F.col("file_size").cast("string"), F.lit(" ("), short_size(F.col("file_size")), F.lit(")")), "posix_permissions": permissions(F.col("posix_permissions"))}
    yes = lambda k: F.when(F.col(k), "Yes").when(~F.col(k), "No")
    pairs = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(label).alias("label"), (yes(k) if k.startswith("is_") else shown.get(k, F.col(k).cast("string"))).alias("value")) for i, (k, label) in enumerate(LABELS.items())))
    return entries.select("archive", "idx", F.explode(pairs).alias("p")).select("archive", "idx", "p.rank", "p.label", "p.value").where("value is not null")


def json_line(*columns: str, exclude: tuple[str, ...] = ()) -> Column:
    """One JSON object an entry, unknown fields and excluded ones left out."""
    return F.to_json(F.struct(*(c for c in columns if c not in exclude)), {"ignoreNullFields": "true"})


#: Fixed value: the version of the JSON listing.
JSON_VERSION = 2


def json_documents(entries: DataFrame, *columns: str, exclude: tuple[str, ...] = (), encodings: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """archive and json, one document an archive: FormatVersion, Contents in order, FormatName, Error, and, from encodings
    (archive, encoding, confidence), Encoding and Confidence of names. prefix goes before these keys, for readers that know
    them by one. An archive's entries meet in one row, as its document has to hold them."""
    line = F.struct(*(c for c in columns if c not in exclude))
    rows = entries.groupBy("archive").agg(F.min(F.when(F.col("level") == 0, F.col("format"))).alias("format"), F.max("archive_status").alias("error"), F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", line.alias("e"))))).alias("es"))
    rows = rows.join(encodings, "archive", "left") if encodings is not None else rows.withColumns({"encoding": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    own = {"FormatVersion": F.lit(JSON_VERSION), "Contents": F.transform("es", lambda x: x["e"]), "Encoding": F.col("encoding"), "Confidence": F.col("confidence"), "FormatName": F.col("format"), "Error": F.col("error")}
    body = F.struct(*(v.alias(prefix + k) for k, v in own.items()))
    return rows.select("archive", F.to_json(body, {"ignoreNullFields": "true"}).alias("json"))


def entry_at(entries: DataFrame, n: int, *columns: str) -> DataFrame:
    """What the n-th entry of each archive has in some columns."""
    return entries.where(F.col("idx") == n).select("archive", *columns)

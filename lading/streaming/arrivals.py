"""Archives that arrive in a folder, as a stream of their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.reader import Options, list_entries

#: Columns of Spark's binaryFile source.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_entries(spark: SparkSession, folder: str, options: Options | None = None, files_a_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame of the entries of archives as they arrive. Nothing is kept between triggers but which files
    were seen; watermarks and windows may follow."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    return list_entries(files, options)

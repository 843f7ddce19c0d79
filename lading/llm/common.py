"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII white space only.
GAP = r"[\x20\x09-\x0D]"


def words_sql(text: str) -> str:
    """SQL for the array of words of a text (null: none); a one-character pattern splits faster than one with a plus."""
    return f"array_remove(split(coalesce({text}, ''), r'{GAP}'), '')"


#: Folders that this process named; release() deletes them.
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Only a local session without that setting gets a temporary folder, for tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = tempfile.mkdtemp(prefix="lading-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(f"file://{base}")
            base = f"file://{base}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _MADE.append(path := f"{base.rstrip('/')}/lading-{uuid.uuid4().hex}")
    return path


def settle(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: later jobs read the files, not the lineage."""
    path = at or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that settle() wrote, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def identified(docs: DataFrame) -> DataFrame:
    """row, which tells each row of docs from all others and stays the same whenever docs is read, and doc, a struct of
    docs' own columns: no names clash.

    Rows of a plain table of files are known by file and place. Any other DataFrame is settled first, since numbers given
    while a plan runs may differ when a lost task runs again."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = settle(docs)
    row = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.select(row.alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; it must be cheap to read, as after settle()."""
    return df.limit(rows + 1).count() <= rows


def with_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it is checked to have at most so many rows, else df as it is."""
    return F.broadcast(df) if small(df, rows) else df


#: A key with more rows is hot, and so many keys may be.
HOT_ROWS, HOT_KEYS = 1_000, 1_000_000


def joined_by(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right, which has a row for each value of key, however many rows of left share one.

    Keys with over HOT_ROWS rows of left are joined by broadcast, so their rows stay where they are; there are HOT_KEYS of
    them at most, since with more rows than HOT_ROWS * HOT_KEYS a hot key has more. Both should be cheap to read."""
    least = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = settle(left.groupBy(key).count().where(F.col("count") > least).select(key).join(right, key))
    if hot.isEmpty():
        return left.join(right, key)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return cold.unionByName(left.join(F.broadcast(hot), key))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def made_since(spark: SparkSession, path: str) -> None:
    """Delete the folders that were named after path was."""
    while _MADE[-1] != path:
        discard(spark, _MADE.pop())


def settle_alone(df: DataFrame, begun: str) -> DataFrame:
    """settle(df), and then delete the folders that were named since begun was, df's own inputs among them."""
    path = shared_dir(df.sparkSession)
    out = settle(df, path)
    for old in _MADE[_MADE.index(begun) + 1 :]:
        if old != path:
            _MADE.remove(old)
            discard(df.sparkSession, old)
    return out


def release(spark: SparkSession) -> None:
    """Delete all folders that operators wrote so far; call it once their results are stored elsewhere."""
    while _MADE:
        discard(spark, _MADE.pop())

"""Parquet tables of the store and the one post schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeflow.operators.staging import shuffles_removed
from themeflow.schemas import EXTENSIONS, POST_COLUMNS


def base_posts(posts: DataFrame) -> DataFrame:
    """The columns shared by all platforms."""
    return posts.select(*POST_COLUMNS)


def extension(posts: DataFrame, platform: str) -> DataFrame:
    """The columns of one platform, keyed by ``post_id``."""
    names = [name for name in EXTENSIONS[platform].fieldNames() if name != "post_id"]
    return posts.filter(F.col("platform") == platform).select(F.col("id").alias("post_id"), *names)


def unify(sources: Iterable[DataFrame]) -> DataFrame:
    """One wide table of all sources; columns a source lacks are null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), sources)


def write_table(
    df: DataFrame, path: str, mode: str = "append", partition_by: Iterable[str] = (), compression: str | None = None
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path, compression=compression)


def write_posts(
    posts: DataFrame, path: str, mode: str = "append", compression: str | None = None, apart: Sequence[str] = ()
) -> None:
    """Partitioned by platform and day, so both prune the scan.

    Rows of a platform and day are brought together first, then split by size: adaptive execution
    deals a busy day to as many tasks as it has advised partitions
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), a small one has one file.

    Platforms named by ``apart`` are written one after the other, then the posts of all others, each by a
    job of its own whose shuffle is deleted when it ends: for staged posts, which every job reads, so that
    the disk holds the shuffle of one platform only.  A failure leaves what was written before.
    """
    if not apart:
        parts = [posts]
    elif mode not in ("append", "overwrite"):
        raise ValueError(f"platforms can't be written apart with mode {mode!r}")
    else:
        others = posts.filter(F.col("platform").isNull() | ~F.col("platform").isin(*apart))
        parts = [posts.filter(F.col("platform") == name) for name in dict.fromkeys(apart)]
        parts += [] if others.select("platform").isEmpty() else [others]
    with shuffles_removed(posts.sparkSession):
        for part in parts:
            dated = part.withColumn("created_date", F.to_date("created_at"))
            together = dated.hint("rebalance", F.col("platform"), F.col("created_date"))
            write_table(together, path, mode, ("platform", "created_date"), compression)
            mode = "append"


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """Days that ``write_posts`` has written, newest first, from the names of the folders alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    days = set()
    for platform in files.listStatus(root):
        if platform.isDirectory():
            names = (x.getPath().getName() for x in files.listStatus(platform.getPath()))
            days |= {name.removeprefix("created_date=") for name in names if name.startswith("created_date=")}
    return sorted((date.fromisoformat(x) for x in days if x[:1].isdigit()), reverse=True)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)

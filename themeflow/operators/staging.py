"""Write an intermediate table once when several jobs read it."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


_LOCAL_ROOTS: dict[str, tempfile.TemporaryDirectory] = {}
_STAGED: dict[str, list[str]] = {}
_SCOPE = threading.local()
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A local session (tests) without the setting gets its own temporary folder; a cluster session
    must name one, because a machine-local folder dies with its executor.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.TemporaryDirectory(
            prefix="themeflow-", ignore_cleanup_errors=True
        )
    return _LOCAL_ROOTS[context.applicationId].name


def staging_path(spark: SparkSession, name: str) -> str:
    path = f"{staging_root(spark)}/themeflow/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    for scope in getattr(_SCOPE, "open", []):
        scope.append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> int:
    removed = 0
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return removed


@contextmanager
def staged_within(spark: SparkSession) -> Iterator[None]:
    """Delete what this thread stages inside the block when it ends: for each batch of a stream that never does."""
    scope: list[str] = []
    _SCOPE.open = [*getattr(_SCOPE, "open", []), scope]
    try:
        yield
    finally:
        _SCOPE.open = [x for x in _SCOPE.open if x is not scope]
        staged = _STAGED.get(spark.sparkContext.applicationId, [])
        staged[:] = [p for p in staged if p not in scope]
        _remove(spark, scope)


def remove_staged(spark: SparkSession) -> int:
    """Delete what this application has staged, and say how many folders went.

    Call it at the end of a run, when every result that reads staged tables has been written.
    """
    return _remove(spark, _STAGED.pop(spark.sparkContext.applicationId, []))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query run inside go when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str, compression: str | None = None, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, with the session's codec unless one is named.

    Cuts the lineage, survives lost executors, and later jobs read only the columns they use.  With
    ``release`` the shuffles behind it are deleted as soon as it is written.
    """
    path = staging_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession) if release else nullcontext():
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(
    spark: SparkSession, name: str, make: Callable[[], DataFrame], compression: str | None = None
) -> DataFrame:
    """The table that ``make`` returns, staged; what making it stages or shuffles goes when it is written."""
    path = staging_path(spark, name)
    with staged_within(spark), shuffles_removed(spark):
        made = make()
        made.write.parquet(path, compression=compression)
    return spark.read.schema(made.schema).parquet(path)

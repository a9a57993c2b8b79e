"""Index of stored ids: hash buckets with a Bloom filter each.

A segment holds the ids of one load, cut into buckets by hash; the number of buckets follows the
number of ids, so a bucket never grows with the store.  Each bucket has a Bloom filter, an array of
64-bit words merged from the tasks' parts by a bitwise or.  A look-up tests the asked ids against the filters
and reads only the buckets where one may be stored; what it finds there is compared exactly, so
filters save reading and never change a result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeflow.operators.staging import stage

_IDS = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("bucket", T.LongType())]
)
_FILTERS = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("buckets", T.LongType()),
     T.StructField("words", T.ArrayType(T.LongType())), T.StructField("segment", T.LongType())]
)
#: Ids asked of one bucket that go into one list, about.
IDS_PER_LIST = 10_000


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at ``path``, or ``None`` where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _power(n: int) -> int:
    """The smallest power of two from ``n`` on."""
    return 1 << max(0, (n - 1).bit_length())


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("id"), buckets)


def _bits(size: Column, probes: int, name: Column | str = "id") -> Column:
    """Positions of an id in a filter of ``size`` bits: a start and a step from two hashes."""
    first, step = F.xxhash64(name, F.lit(1)), F.xxhash64(name, F.lit(2))
    return F.transform(
        F.sequence(F.lit(0), F.lit(probes - 1)),
        lambda i: F.pmod(F.pmod(first, size) + i * F.pmod(step, size), size),
    )


@dataclass(frozen=True)
class IdIndex:
    """The index in folder ``path``.  Segments are numbered; one that is added again replaces itself.

    ``ids_per_bucket`` and ``bits_per_id`` set the size of the filters of new segments, ``probes`` the
    bits an id sets (the same for all segments of an index).
    """

    path: str
    ids_per_bucket: int = 50_000
    bits_per_id: int = 12
    probes: int = 7

    def add(self, ids: DataFrame, segment: int) -> None:
        """Store the ids of one load (column ``id``; nulls and repeats are left out)."""
        ids = stage(ids.select("id").filter(F.col("id").isNotNull()).distinct(), "index-ids")
        n = ids.count()
        buckets = _power(-(-n // self.ids_per_bucket))
        words = _power(-(-min(self.ids_per_bucket, max(1, n)) * self.bits_per_id // 64))
        placed = ids.withColumn("bucket", _bucket(F.lit(buckets)))
        placed.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{self.path}/ids/segment={segment}")

        bits = placed.select("bucket", F.explode(_bits(F.lit(64 * words), self.probes)).alias("bit"))
        # Each task folds its ids into at most one row per word; rows of one word meet by a bitwise or.
        word = bits.groupBy("bucket", F.floor(F.col("bit") / 64).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set")
        )
        # The words of a bucket in order, zeros where no bit is set.
        blank = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(words - 1).cast("long"))).alias("word")
        zeros = placed.select("bucket").distinct().select("bucket", blank).withColumn("set", F.lit(0).cast("long"))
        whole = word.unionByName(zeros).groupBy("bucket", "word").agg(F.bit_or("set").alias("set"))
        filters = whole.groupBy("bucket").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words")
        )
        filters.select("bucket", F.lit(buckets).cast("long").alias("buckets"), "words").write.mode(
            "overwrite"
        ).parquet(f"{self.path}/filters/segment={segment}")

    def filters(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """``segment``, ``bucket``, ``buckets`` and ``words``; of segments before one if it is given."""
        found = _read(spark, f"{self.path}/filters", _FILTERS)
        return found if found is None or before is None else found.filter(F.col("segment") < before)

    def candidates(self, ids: DataFrame, before: int | None = None) -> DataFrame | None:
        """``segment``, ``bucket`` and ``id`` wherever a filter says that the id may be stored.

        Asked ids meet their bucket's filter in lists of bounded length, and each list is tested where
        the filter lies: a filter is joined once per list and never copied for each id.
        """
        filters = self.filters(ids.sparkSession, before)
        if filters is None:
            return None
        sizes = [r["buckets"] for r in filters.select("buckets").distinct().collect()]  # powers of two, so few
        if not sizes:
            return None
        asked = stage(ids.select("id").filter(F.col("id").isNotNull()).distinct(), "asked-ids")
        n_asked = asked.count()

        def placed(n: int) -> DataFrame:
            part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(-(-n_asked // (n * IDS_PER_LIST)) or 1))
            return asked.select("id", F.lit(n).cast("long").alias("buckets"), _bucket(F.lit(n)).alias("bucket"), part.alias("part"))

        lists = reduce(DataFrame.unionByName, map(placed, sizes)).groupBy("buckets", "bucket", "part").agg(
            F.collect_list("id").alias("ids")
        )
        size = F.size("words").cast("long") * 64

        def is_set(name: Column) -> Column:
            return F.forall(
                _bits(size, self.probes, name),
                lambda bit: F.getbit(F.get("words", F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1,
            )

        met = lists.join(filters, ["buckets", "bucket"]).select("segment", "bucket", F.filter("ids", is_set).alias("ids"))
        # The outer form, because the inner one makes Spark test every id a second time for its size filter.
        return met.select("segment", "bucket", F.explode_outer("ids").alias("id")).filter(F.col("id").isNotNull())

    def read(self, spark: SparkSession, buckets: list[tuple[int, int]] | None = None) -> DataFrame:
        """Stored ids, of the given (segment, bucket) only; both are folders, so others aren't read."""
        found = _read(spark, f"{self.path}/ids", _IDS)
        if found is None:
            return spark.createDataFrame([], _IDS)
        if buckets is None:
            return found
        chosen = F.lit(False)
        for segment in sorted({s for s, _ in buckets}):
            mine = sorted(b for s, b in buckets if s == segment)
            chosen = chosen | ((F.col("segment") == segment) & F.col("bucket").isin(mine))
        return found.filter(chosen)

    def known(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """Those of ``ids`` that are stored (in segments before ``before``), each once."""
        spark = ids.sparkSession
        found = self.candidates(ids, before)
        if found is None:
            return spark.createDataFrame([], ids.select("id").schema)
        found = stage(found, "index-candidates")
        # At most the number of buckets of the index.
        buckets = [(r["segment"], r["bucket"]) for r in found.select("segment", "bucket").distinct().collect()]
        return self.read(spark, buckets).select("id").join(found.select("id"), "id", "left_semi").distinct()

    def compacted(self, path: str, spark: SparkSession, before: int) -> IdIndex:
        """An index in a new folder with the segments before ``before`` as one, and no other.

        The old folder stays as it is, so a run that still reads it, or one that is repeated, is safe.
        """
        merged = replace(self, path=path)
        merged.add(self.read(spark).filter(F.col("segment") < before), before - 1)
        return merged

"""Sets of members of any size: an order-free digest and long membership tables.

One theme may hold a third of all posts.  Nothing here gathers its members: the digest is a partial
aggregate, the same for every size and every setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIMBS = 4
_HEX = 10  # digits of a limb: 40 bits, so sums of 10**25 members fit a decimal of 38 digits


def limb_sums(member: Column | str) -> list[Column]:
    """Aggregates: the SHA-1 of each member in four whole numbers, each added up."""
    digest = F.sha1(member)
    return [
        F.sum(F.conv(F.substring(digest, 1 + _HEX * i, _HEX), 16, 10).cast("decimal(13,0)")).alias(limb(i))
        for i in range(_LIMBS)
    ]


def limb(i: int) -> str:
    return f"_limb{i}"


LIMBS = tuple(limb(i) for i in range(_LIMBS))


def members_digest(count: Column) -> Column:
    """SHA-1 of the number of members and of the sums ``LIMBS``, joined by ``|``."""
    return F.sha1(F.concat_ws("|", count.cast("string"), *[F.col(x).cast("string") for x in LIMBS]))


def digests(pairs: DataFrame, key: str, member: str) -> DataFrame:
    """``key, members_digest`` of a table of distinct pairs."""
    return (
        pairs.groupBy(key)
        .agg(F.count("*").alias("_n"), *limb_sums(member))
        .select(key, members_digest(F.col("_n")).alias("members_digest"))
    )

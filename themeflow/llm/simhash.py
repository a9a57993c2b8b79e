"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distances.

Fingerprints are made in numpy from Arrow batches.  Documents with equal fingerprints fold into
one before the join.  A fingerprint is split into blocks so that two of them within the distance
share some of the blocks; each choice of such blocks is one key.  Keys of few fingerprints are
joined and their pairs verified; a key of many is split further by the bits it leaves open, so a
crowd of similar texts never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.llm.components import components
from themeflow.llm.text import Shield, with_results
from themeflow.operators.staging import stage

SEED = 42
#: Keys of more fingerprints are split by their open bits instead of joined.
CROWD = 64
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the ``shingle``-word shingles; 0 for a text without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    set_bits = np.zeros(64, np.int64)
    for begin in range(0, n, _CHUNK):
        end = min(n, begin + _CHUNK)
        columns = [words[begin + k : end + shingle - 1][: end - begin] for k in range(shingle)]
        pieces = zip(*columns) if len(words) >= shingle else [words]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in pieces), np.uint64, end - begin
        )
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def with_fingerprint(
    docs: DataFrame, text_col: str = "text", shingle: int = 3, name: str = "fingerprint"
) -> DataFrame:
    """Columns of ``docs`` but the text, and ``name``: the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c not in (text_col, name)]
    source = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = docs.select(*keep, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (fingerprint_of(t.as_py(), shingle) for t in batch.column("__text")),
                np.uint64,
                batch.num_rows,
            )
            columns = [batch.column(c) for c in keep] + [pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, name])

    return source.mapInArrow(run, schema)


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(offset, width) of ``blocks`` blocks of 64 bits, as even as possible."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_masks(distance: int, blocks: int) -> list[int]:
    """One mask per choice of blocks that two fingerprints within ``distance`` may share.

    At most ``distance`` blocks differ, so some choice of ``blocks - distance`` agrees.
    """
    if blocks <= distance:
        raise ValueError("there must be more blocks than differing bits")
    cuts = _cuts(blocks)
    return [
        sum(((1 << width) - 1) << offset for offset, width in chosen)
        for chosen in combinations(cuts, blocks - distance)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(
    prints: DataFrame, name: str = "fingerprint", distance: int = 2, blocks: int = 5, crowd: int = CROWD
) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints that connect all those within ``distance``.

    Every pair is verified.  Pairs of a crowded key are not all listed, but two fingerprints of
    any key within the distance are connected by listed pairs.
    """
    masks = block_masks(distance, blocks)
    keyed = stage(
        prints.select(F.col(name).alias("fp"))
        .filter(F.col("fp").isNotNull())
        .distinct()
        .select(
            "fp",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("choice"),
                            F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"),
                        )
                        for i, m in enumerate(masks)
                    ]
                )
            ).alias("k"),
        )
        .select("fp", "k.choice", "k.bits"),
        "block-keys",
    )
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(keyed.join(sizes, ["choice", "bits"]), "shared-keys")
    few = shared.filter(F.col("n") <= crowd)
    pairs = (
        few.select("choice", "bits", F.col("fp").alias("a"))
        .join(few.select("choice", "bits", F.col("fp").alias("b")), ["choice", "bits"])
        .filter((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= distance))
        .select("a", "b")
    )
    return pairs.unionByName(_crowd_links(shared.filter(F.col("n") > crowd), masks, distance)).distinct()


def _crowd_links(many: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links inside crowded keys, by the bits that a key leaves open.

    Two fingerprints are within the (even) distance exactly if some value differs from both in
    half of it at most.  So each fingerprint names all such values, and all that name one value
    are linked to the smallest of them: as many rows as fingerprints times values, no pairs.
    """
    if distance % 2:
        raise ValueError("the distance must be even")
    flips = [
        F.array(
            *[
                F.lit(_signed(sum(1 << p for p in chosen)))
                for size in range(distance // 2 + 1)
                for chosen in combinations([p for p in range(64) if not m >> p & 1], size)
            ]
        )
        for m in masks
    ]
    around = many.select(
        "fp", "choice", F.explode(F.get(F.array(*flips), F.col("choice"))).alias("flip")
    ).select("fp", "choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    least = around.groupBy("choice", "hub").agg(F.min("fp").alias("a"), F.count("*").alias("n"))
    return (
        around.join(least.filter("n > 1"), ["choice", "hub"])
        .filter((F.col("fp") != F.col("a")) & (_distance(F.col("fp"), F.col("a")) <= distance))
        .select("a", F.col("fp").alias("b"))
    )


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 2,
    blocks: int = 5,
    crowd: int = CROWD,
) -> DataFrame:
    """``__id``, ``__hash`` (of the text), ``fingerprint``, ``root`` and ``component`` of each row.

    ``root`` names the group by its smallest fingerprint; ``component`` is the smallest document id that links of at most ``distance`` bits reach.  A
    null or empty text has fingerprint 0 and links like any other.  A null id names no component:
    a group of null ids only has a null component.  Repeated rows link to each other.
    """
    prints = stage(
        with_fingerprint(
            docs.select(
                F.col(id_col).alias("__id"),
                F.xxhash64(F.col(text_col)).alias("__hash"),
                F.col(text_col).alias("__text_in"),
            ),
            "__text_in",
            shingle,
        ),
        "fingerprints",
    )
    classes = stage(
        prints.groupBy("fingerprint").agg(F.min("__id").alias("least")), "fingerprint-classes"
    )
    roots = components(links(classes, "fingerprint", distance, blocks, crowd))
    rooted = classes.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    found = rooted.join(least, "root").select("fingerprint", "root", "component")
    return prints.join(found, "fingerprint")


def hex_print(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``found`` (``__id``, ``__hash``, ``root``); same columns.

    It is the row of the smallest id; of several with this id, the one with the smallest text hash.
    Ids that are null come after all others.
    """
    first = F.min(F.struct(F.col("__id").isNull().alias("unnamed"), "__id", "__hash")).alias("first")
    chosen = found.groupBy("root").agg(first).select(
        "first.__id", "first.__hash", F.lit(True).alias("__keep")
    )
    kept = with_results(docs, chosen, id_col, text_col).filter("__keep").drop("__keep")
    repeated = found.groupBy("__id", "__hash").count().filter("count > 1").limit(1).count()
    if repeated:
        kept = kept.withColumn("__h", F.xxhash64(F.col(text_col))).dropDuplicates([id_col, "__h"]).drop("__h")
    return kept.select(*docs.columns)


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 2,
    blocks: int = 5,
    crowd: int = CROWD,
) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id; same columns.

    Of several rows with this id, the one with the smallest text hash stays; ids that are null
    come after all others.
    """
    shield = Shield(docs)
    docs, id_col, text_col = shield.docs, shield.name(id_col), shield.name(text_col)
    found = stage(
        near_copies(docs, id_col, text_col, shingle, distance, blocks, crowd).select(
            "__id", "__hash", "root"
        ),
        "near-copies",
    )
    return shield.back(keep_first(docs, found, id_col, text_col))

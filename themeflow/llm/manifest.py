"""Merkle manifest of a dataset: a SHA-256 tree that keeps the hash states inside its parents.

Each row is a leaf; the rows of a group form a tree in the order of their ids, and the roots of the
groups form the last tree.  A child's digest is hashed as 64 hexadecimal characters, which are
exactly one block of SHA-256, so the state of a parent before each of its child slots is eight
numbers.  Parents retain copies of these states.  To fold a changed row, each parent resumes the
state of the row's slot, takes the replacement and the siblings to its right, and is done: what is
to the left is in the state already.

The tree is stored in pages of ``HEIGHT`` levels.  A page is built by one task from at most
``FANOUT ** HEIGHT`` children, and its top is a leaf of the pages above, so groups of any size are
split evenly and the driver only counts levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from themeflow.operators.staging import stage

FANOUT = 2
#: Levels of a page: with two children each, 2,048 leaves.
HEIGHT = 11
#: Counts of rows by group and range are broadcast up to this number.
BROADCAST_ROWS = 200_000


def _root_bits(n: int, degree: int) -> int:
    """First 32 bits of the fraction of a root of ``n``."""
    target, low, high = n << (32 * degree), 0, n << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**degree <= target else (low, middle - 1)
    return low & 0xFFFFFFFF


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, int(n**0.5) + 1))]
_STEPS = [np.uint32(_root_bits(p, 3)) for p in _PRIMES]
_START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), ">u2")


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def absorbed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8 x n) after one more block (16 x n) each, SHA-256's compression."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        low = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
        high = _turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))
        w.append(w[t - 16] + low + w[t - 7] + high)
    a, b, c, d, e, f, g, h = state
    for step, word in zip(_STEPS, w):
        mixed = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g)) + step + word
        chosen = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = mixed + chosen, a, b, c, d + mixed, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _as_bytes(words: np.ndarray) -> np.ndarray:
    """Digests or states (8 x n) as n rows of 32 bytes."""
    return np.ascontiguousarray(words.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def _as_words(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).reshape(-1, 8).T


def _taken(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the hexadecimal text of one digest (8 x n) each."""
    text = np.ascontiguousarray(_HEX[_as_bytes(digests)])
    return absorbed(state, np.ascontiguousarray(text.view(">u4").astype(np.uint32).T))


def _closed(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of parents whose children, so many each, have all been taken."""
    block = np.zeros((16, state.shape[1]), np.uint32)
    block[0], block[15] = 0x80000000, 512 * children
    return absorbed(state, block)


@dataclass
class Level:
    """The parents above ``children`` (8 x m): ``states`` (slots x 8 x parents) before each child slot."""

    children: np.ndarray
    states: np.ndarray


def grow(leaves: np.ndarray, top: bool, height: int, fanout: int) -> tuple[list[Level], np.ndarray]:
    """Levels above ``leaves`` (8 x m) and the digest at their top.

    A page at the top of its tree ends at one node; one below has all its levels, of single
    children too.
    """
    levels, nodes = [], leaves
    while nodes.shape[1] > 1 if top else len(levels) < height:
        m = nodes.shape[1]
        parents = -(-m // fanout)
        state = np.repeat(_START[:, None], parents, axis=1)
        kept = np.empty((fanout, 8, parents), np.uint32)
        for slot in range(fanout):
            kept[slot] = state
            there = nodes[:, slot::fanout]
            state[:, : there.shape[1]] = _taken(state[:, : there.shape[1]], there)
        levels.append(Level(nodes, kept))
        nodes = _closed(state, np.minimum(fanout, m - fanout * np.arange(parents)).astype(np.uint32))
    return levels, nodes


def _fold_level(level: Level, place: np.ndarray, digests: np.ndarray, fanout: int) -> np.ndarray:
    """Parents of children with new ``digests``: resumed states, the replacement, right siblings."""
    m = level.children.shape[1]
    parent, slot = place // fanout, place % fanout
    state = _taken(level.states[slot, :, parent].T, digests)
    for right in range(1, fanout):
        some = np.flatnonzero((slot + right < fanout) & (place + right < m))
        state[:, some] = _taken(state[:, some], level.children[:, place[some] + right])
    return _closed(state, np.minimum(fanout, m - fanout * parent).astype(np.uint32))


# --- Pages in tables --------------------------------------------------------------------------

_PAGE = "grp string, page long, size long, top binary, digests binary, states binary"
_STEP = "array<struct<state: binary, left: binary, right: binary>>"


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return _as_words(np.frombuffer(b"".join(column.to_pylist()), np.uint8))


def _binary(words: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in _as_bytes(words)], pa.binary())


def _page_of(size: int, page: int, height: int, fanout: int) -> tuple[int, bool]:
    """Number of children of a page, and whether it is the top of its tree."""
    room = fanout**height
    return min(room, size - page * room), size <= room


def _levels(digests: bytes, states: bytes, size: int, page: int, height: int, fanout: int) -> list[Level]:
    """The levels of a stored page."""
    m, top = _page_of(size, page, height, fanout)
    nodes, kept = (_as_words(np.frombuffer(x, np.uint8)) for x in (digests, states))
    levels, at, state_at = [], 0, 0
    while m > 1 if top else len(levels) < height:
        parents = -(-m // fanout)
        block = kept[:, state_at : state_at + fanout * parents].reshape(8, fanout, parents)
        levels.append(Level(nodes[:, at : at + m], block.transpose(1, 0, 2)))
        at, state_at, m = at + m, state_at + fanout * parents, parents
    return levels


def _pages(nodes: DataFrame, height: int, fanout: int) -> DataFrame:
    """One row per page over ``nodes``: ``grp``, ``pos``, ``size`` (of the group), ``digest``."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        grp, page, size = (table[c][0].as_py() for c in ("grp", "page", "size"))
        levels, top = grow(_digests(table["digest"]), _page_of(size, page, height, fanout)[1], height, fanout)
        digests = b"".join(_as_bytes(x.children).tobytes() for x in levels)
        states = b"".join(_as_bytes(s).tobytes() for x in levels for s in x.states)
        row = [pa.array([grp], pa.string()), pa.array([page]), pa.array([size]), _binary(top)]
        return pa.Table.from_arrays(
            [*row, pa.array([digests], pa.binary()), pa.array([states], pa.binary())],
            names=["grp", "page", "size", "top", "digests", "states"],
        )

    paged = nodes.select("grp", "pos", "size", "digest", F.floor(F.col("pos") / fanout**height).alias("page"))
    return paged.groupBy("grp", "page").applyInArrow(build, _PAGE)


def _tree(nodes: DataFrame, height: int, fanout: int) -> list[DataFrame]:
    """Pages over ``nodes``, tier by tier; a group ends in the tier whose pages hold it whole."""
    room, tiers = fanout**height, []
    while True:
        tiers.append(stage(_pages(nodes, height, fanout), "manifest-pages"))
        higher = tiers[-1].filter(F.col("size") > room)
        if higher.select("grp").isEmpty():
            return tiers
        nodes = higher.select(
            "grp", F.col("page").alias("pos"), F.ceil(F.col("size") / room).alias("size"), F.col("top").alias("digest")
        )


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 in its group by ``order``, and ``size`` of the group.

    Rows are sorted by ranges and counted by group and range, so a group of any size is sorted in
    parts.  Rows that are equal in ``order`` follow each other in some order.
    """
    parted = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    parted = stage(
        parted.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()),
        "manifest-order",
    )
    counts = parted.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    so_far = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        group, "part",
        (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("n").over(Window.partitionBy(group)).alias("size"),
    )
    offsets = stage(offsets, "manifest-offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return parted.join(offsets, [group, "part"]).withColumn("pos", F.col("pos") + F.col("offset")).drop("part", "offset")


# --- Leaves -----------------------------------------------------------------------------------


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns, each as its UTF-8 length, ``:`` and its text, or ``-`` for null."""
    return F.sha2(F.concat(*map(_framed, columns)), 256)


def _group_key(group: Column) -> Column:
    """Null first, then by bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group.cast("string")))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``grp``, ``pos``, ``size``, ``digest``, the id and what else was kept of each row;
    ``tiers`` and ``top_tiers``: the pages of the groups' trees and of the tree above them;
    ``subroots``: ``grp``, ``pos``, ``size``, ``digest`` of each group."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    subroots: DataFrame
    height: int
    fanout: int

    def root(self) -> str | None:
        """Digest of the dataset; ``None`` for one without rows."""
        room = self.fanout**self.height
        found = self.top_tiers[-1].filter(F.col("size") <= room).select(F.lower(F.hex("top"))).first()
        return found[0] if found else None


def build(
    rows: DataFrame, group_col: str, order: Sequence[str], digest_col: str, height: int = HEIGHT, fanout: int = FANOUT
) -> Manifest:
    """The manifest of ``rows``, whose ``digest_col`` has a SHA-256 in hexadecimal.

    Leaves of a group stand by ``order``, nulls first, equal ones by their digest; so the tree does
    not depend on how rows are stored.  A group of one row is its leaf itself.
    """
    if fanout < 2 or height < 1:
        raise ValueError("a page needs a level and parents two children")
    keyed = rows.withColumn("grp", _group_key(F.col(group_col))).withColumn("digest", F.unhex(digest_col))
    leaves = stage(ranked(keyed, "grp", [*order, "digest"]), "manifest-leaves")
    tiers = _tree(leaves, height, fanout)
    room = fanout**height
    tops = None
    for tier in tiers:
        whole = tier.filter(F.col("size") <= room).select(F.col("grp").alias("name"), F.col("top").alias("digest"))
        tops = whole if tops is None else tops.unionByName(whole)
    subroots = stage(ranked(tops.withColumn("grp", F.lit("")), "grp", ["name"]), "manifest-subroots")
    return Manifest(leaves, tiers, _tree(subroots, height, fanout), subroots, height, fanout)


# --- Folding ----------------------------------------------------------------------------------


def _steps_of(levels: list[Level], place: int, fanout: int) -> list[dict[str, bytes]]:
    """What a node needs to go up: per level its parent's state before it, and its siblings."""
    steps = []
    for level in levels:
        parent, slot = divmod(place, fanout)
        run = _as_bytes(level.children[:, parent * fanout : (parent + 1) * fanout])
        state = _as_bytes(level.states[slot, :, parent : parent + 1])
        steps.append({"state": state.tobytes(), "left": run[:slot].tobytes(), "right": run[slot + 1 :].tobytes()})
        place = parent
    return steps


def _child_paths(pages: DataFrame, height: int, fanout: int) -> DataFrame:
    """``grp``, ``pos`` and ``path`` of the children of ``pages``, which have a ``path`` themselves."""

    def spread(table: pa.Table) -> pa.Table:
        row = table.drop_columns(["path"]).to_pylist()[0]
        above = table["path"][0].as_py()
        levels = _levels(row["digests"], row["states"], row["size"], row["page"], height, fanout)
        m = _page_of(row["size"], row["page"], height, fanout)[0]
        paths = pa.array([_steps_of(levels, i, fanout) + above for i in range(m)], table["path"].type)
        first = row["page"] * fanout**height
        return pa.Table.from_arrays(
            [pa.array([row["grp"]] * m, pa.string()), pa.array(range(first, first + m), pa.int64()), paths],
            names=["grp", "pos", "path"],
        )

    return pages.groupBy("grp", "page").applyInArrow(spread, f"grp string, pos long, path {_STEP}")


def _paths(tiers: list[DataFrame], tops: DataFrame, height: int, fanout: int) -> DataFrame:
    """The first tier's pages with their ``path`` to the root.

    ``tops`` has the path of each group's top (``grp``, ``path``).  Paths go down tier by tier.
    """
    room, path = fanout**height, None
    for tier in reversed(tiers):
        found = tier.filter(F.col("size") <= room).join(tops, "grp")
        if path is not None:
            below = path.select("grp", F.col("pos").alias("page"), "path")
            found = found.unionByName(tier.join(below, ["grp", "page"]).select(found.columns))
        if tier is tiers[0]:
            return found
        path = stage(_child_paths(found, height, fanout), "manifest-paths")
    raise ValueError("a tree has pages")


def fold(manifest: Manifest, replaced_col: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` of each leaf, ``subroot``, ``root``, ``folded_root`` and ``proof``.

    ``replaced_col`` is a column of the leaves with a SHA-256 in hexadecimal that takes the place of
    that leaf alone; null leaves it as it is.  ``folded_root`` comes from the states the parents
    retain.  ``proof`` lists the digests of all siblings from the leaf to the root, left to right.
    """
    height, fanout = manifest.height, manifest.fanout
    spark = manifest.leaves.sparkSession
    nothing = spark.createDataFrame([("", [])], f"grp string, path {_STEP}")
    top_pages = _paths(manifest.top_tiers, nothing, height, fanout)
    named = _child_paths(top_pages, height, fanout).join(manifest.subroots.select("grp", "pos", "name", "digest"), ["grp", "pos"])
    tops = stage(named.select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot")), "manifest-tops")
    pages = _paths(manifest.tiers, tops.select("grp", "path"), height, fanout)
    pages = pages.join(tops.select("grp", "subroot"), "grp").select("grp", "page", "digests", "states", "path", "subroot")

    room = fanout**height
    leaves = manifest.leaves.select(
        "grp", "pos", "size", "digest", F.coalesce(F.unhex(replaced_col), "digest").alias("replaced"),
        F.floor(F.col("pos") / room).alias("page"), F.struct(*keep).alias("kept"),
    )
    text = T.StringType()
    schema = T.StructType(
        [leaves.schema["kept"], T.StructField("subroot", text), T.StructField("folded_root", text),
         T.StructField("proof", T.ArrayType(text))]
    )

    def folded(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.drop_columns(["path"]).to_pylist()[0]
        size = left["size"][0].as_py()
        levels = _levels(row["digests"], row["states"], size, row["page"], height, fanout)
        above = right["path"][0].as_py()
        place = left["pos"].to_numpy() - row["page"] * room
        digests = _digests(left["replaced"])
        siblings: list[list[str]] = [[] for _ in place]
        for level in levels:
            digests = _fold_level(level, place, digests, fanout)
            names = [x.tobytes().hex() for x in _as_bytes(level.children)]
            for found, at in zip(siblings, place.tolist()):
                first = at - at % fanout
                found += names[first:at] + names[at + 1 : first + fanout]
            place = place // fanout
        shared: list[str] = []
        for step in above:
            lefts, rights = (_as_words(np.frombuffer(step[x], np.uint8)) for x in ("left", "right"))
            shared += [x.tobytes().hex() for part in (lefts, rights) for x in _as_bytes(part)]
            state = np.repeat(_as_words(np.frombuffer(step["state"], np.uint8)), len(place), axis=1)
            state = _taken(state, digests)
            for k in range(rights.shape[1]):
                state = _taken(state, np.repeat(rights[:, k : k + 1], len(place), axis=1))
            children = lefts.shape[1] + 1 + rights.shape[1]
            digests = _closed(state, np.full(len(place), children, np.uint32))
        roots = [x.tobytes().hex() for x in _as_bytes(digests)]
        return pa.Table.from_arrays(
            [
                left["kept"].combine_chunks(),
                pa.array([row["subroot"].hex()] * len(place), pa.string()),
                pa.array(roots, pa.string()),
                pa.array([own + shared for own in siblings], pa.list_(pa.string())),
            ],
            names=["kept", "subroot", "folded_root", "proof"],
        )

    found = leaves.groupBy("grp", "page").cogroup(pages.groupBy("grp", "page")).applyInArrow(folded, schema)
    return found.select("kept.*", "subroot", F.lit(manifest.root()).alias("root"), "folded_root", "proof")


def plain_digest(digests: Sequence[str]) -> str:
    """H of the digests' texts, one after the other, by the standard library."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def tampered_chars(id_col: str, chars_col: str, every: int) -> Column:
    """``chars_col`` plus one where ``every`` divides the checksum of the id, else null."""
    chosen = F.crc32(F.col(id_col).cast("string")) % every == 0
    return F.when(chosen, F.col(chars_col).cast("decimal(37,0)") + 1)


def verified(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
    chars_col: str = "n_chars", text_col: str = "text", tamper_every: int = 7, height: int = HEIGHT, fanout: int = FANOUT,
) -> DataFrame:
    """``id_col``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root`` and ``verified`` of each row.

    Some rows, by the checksum of their id, are tampered with: one is added to ``chars_col``.  Their
    ``folded_root`` differs from ``root``, which the others reach.  A null id is never tampered with and
    comes first in its group; a null number stays null, so its row stays as it is.  Repeated ids
    stand by their digests, equal rows are leaves of their own.  No rows, no result.
    """
    names = [id_col, source_col, lang_col, chars_col, text_col]
    before = [F.col(c) for c in names]
    number = tampered_chars(id_col, chars_col, tamper_every)
    after = [*before[:3], number, before[4]]
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), leaf_digest(before).alias("leaf"),
        F.when(number.isNotNull(), leaf_digest(after)).alias("changed"),
    )
    rows = stage(rows, "manifest-rows")
    if rows.isEmpty():
        empty = rows.select(F.col("id").alias(id_col), "leaf")
        strings = {c: F.lit("") for c in ("subroot", "root", "folded_root")}
        return empty.withColumns({**strings, "proof": F.array(F.lit("")), "verified": F.lit(True)})
    found = fold(build(rows, "lang", ["id"], "leaf", height, fanout), "changed", ["id", "leaf"])
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)

"""Repeated byte strings across documents: enhanced suffix arrays, bucketed by content.

A suffix array of the whole corpus fits no machine, so it is cut by content.  Every window of
``MIN_BYTES`` bytes is assigned to the smallest hash of the ``GRAM``-byte strings in it; a run of
neighbouring windows with one such hash, its *stretch*, goes to the bucket of that hash.  Equal
windows have equal hashes wherever they stand, so all that could repeat a window is in its bucket.

1. Stretches travel as hashes.  Equal ones form a class; one of each class that something could
   repeat represents it, all its occurrences are kept in a long table.
2. The representatives fetch their bytes and travel in compressed units, as the texts do to meet their
   lists.  Their suffixes are sorted by bucket hash, and a stack scan
   over the common prefixes of neighbours walks the interval tree.  An interval whose occurrences have
   different bytes to the left is a maximal repeat; so is the whole string of a class of several
   occurrences.  Each interval is expanded to all occurrences of its classes by the long table.
3. A hash with more classes than fit a task is settled by its windows instead, with a partial
   aggregate of the smallest document per window.

Memory of a task is bounded by the bucket size; the number of buckets grows with the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeflow.llm.manifest import ranked
from themeflow.llm.text import RESULT_BYTES
from themeflow.operators.staging import stage

MIN_BYTES = 50
GRAM = 20
#: Longest stretch in windows; longer runs (periodic text) are cut.
STRETCH = 64
#: Bytes of text scanned at once, and per bucket of stretches.
PIECE = 1 << 18
BUCKET_BYTES = 12 << 20
#: Stretches that a task holds before it folds and sends them.
FLUSH = 1 << 18
#: Classes per suffix array; a hash with more than ``CROWD`` is settled by windows.
ARRAY_STRETCHES = 10_000
CROWD = 5_000
#: Representatives that travel to one task, and those that a task holds before it packs and sends them.
UNIT = 1 << 16
FETCHED = 1 << 17
NO_ID = (1 << 63) - 1
#: Bits of a packed span for its length; strings within a stretch are far shorter.
LENGTH_BITS = 20
#: Rows of the batches that tasks give back.
ROWS_OUT = 512

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    return x ^ (x >> _U(27))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, and a value for each byte."""

    def __init__(self) -> None:
        self.bytes = _mixed((np.arange(1, 257, dtype=np.uint64)) * _U(0xD1342543DE82EF95))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) > n:
            return
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_POWERS = _Powers()


def stretches(
    data: bytes, min_bytes: int = MIN_BYTES, gram: int = GRAM, longest: int = STRETCH
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, content hash, first window and number of windows of each stretch of ``data``.

    The windows of the stretches are all windows of ``data``, each once.  A stretch of ``r``
    windows from ``s`` on holds the bytes ``s`` to ``s + r + min_bytes - 1``.
    """
    parts = []
    windows = len(data) - min_bytes + 1
    for begin in range(0, max(windows, 0), PIECE):
        end = min(windows, begin + PIECE)
        parts.append(_piece(data[begin : end + min_bytes - 1], begin, min_bytes, gram, longest))
    if not parts:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _piece(data: bytes, at: int, min_bytes: int, gram: int, longest: int):
    n = len(data)
    _POWERS.reach(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_POWERS.bytes[np.frombuffer(data, np.uint8)] * _POWERS.down[:n], out=sums[1:])
    low = _mixed((sums[gram:] - sums[: n - gram + 1]) * _POWERS.up[: n - gram + 1])
    wide, step = min_bytes - gram + 1, 1
    while 2 * step <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < wide:
        low = np.minimum(low[: len(low) - (wide - step)], low[wide - step :])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(first, len(low)))
    if size.max() > longest:
        pieces = -(-size // longest)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole, base = np.repeat(size, pieces), np.repeat(first, pieces)
        first = base + inner * longest
        size = np.minimum(longest, whole - inner * longest)
    last = first + size + min_bytes - 1
    content = _mixed((sums[last] - sums[first]) * _POWERS.up[first] + size.astype(np.uint64))
    # 48 bits: the bucket hash adds 64 more wherever contents are compared.
    return low[first], content & _U((1 << 48) - 1), first + at, size


# Step 1: stretches, packed by bucket.

#: Hashes, place and size of a stretch, and whether equal ones of its batch left before it.
_ENTRY = [("m", "<u8"), ("c", "<u8"), ("id", "<i8"), ("tag", "<i4"), ("s", "<i8"), ("r", "u1"), ("d", "u1")]


def _packed(columns: dict[str, np.ndarray], kinds: list[tuple[str, str]] = _ENTRY, rest: bytes = b"") -> bytes:
    """The columns, each sorted by the first, byte planes apart, and ``rest``, compressed."""
    planes = []
    for name, kind in kinds:
        values = np.ascontiguousarray(columns[name].astype(kind))
        planes.append(values.view(np.uint8).reshape(len(values), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*planes, rest]))


def _unpacked(
    blob: bytes, kinds: list[tuple[str, str]] = _ENTRY, n: int | None = None
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The ``n`` values (all, if not given) of each column, and the bytes after them."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    if n is None:
        n = len(raw) // sum(np.dtype(k).itemsize for _, k in kinds)
    out, at = {}, 0
    for name, kind in kinds:
        width = np.dtype(kind).itemsize
        plane = raw[at : at + n * width].reshape(width, n)
        out[name] = np.ascontiguousarray(plane.T).view(kind).reshape(n)
        at += n * width
    return out, raw[at:]


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {
        name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, kind)
        for name, kind in _ENTRY
    }


def _folded(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entries sorted by (m, c, id), and which have an equal stretch in a smaller document.

    The mark ``d`` passes to all entries of a class of which one has it or has a later equal one.
    """
    order = np.lexsort((e["id"], e["c"], e["m"]))
    e = {k: v[order] for k, v in e.items()}
    if not len(order):
        return e, np.zeros(0, bool)
    new = np.concatenate([[True], (e["m"][1:] != e["m"][:-1]) | (e["c"][1:] != e["c"][:-1])])
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    again = e["id"] > e["id"][at][group]
    e["d"] = np.maximum.reduceat(np.maximum(e["d"], again), at)[group].astype(np.uint8)
    return e, again


def _scan(buckets: int, min_bytes: int, gram: int, held_most: int):
    """Rows (bucket, settled, blob) of a partition's documents.

    The stretches that a smaller document of the batch holds too leave at once as occurrences of their
    class; so a passage of a third of all documents costs its bucket one entry per batch.
    """

    def flush(parts: list, number: int) -> Iterator[tuple[int, bool, bytes]]:
        e, again = _folded(_joined(parts))
        if again.any():
            settled = {k: v[again] for k, v in e.items()}
            yield int(e["m"][0] % _U(buckets)), True, _packed(settled)
        e = {k: v[~again] for k, v in e.items()}
        home = (e["m"] >> _U(20)) % _U(buckets)
        order = np.argsort(home, kind="stable")
        home = home[order]
        e = {k: v[order] for k, v in e.items()}
        cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else []
        for a, b in zip(cuts, [*cuts[1:], len(home)]):
            yield int(home[a]), False, _packed({k: v[a:b] for k, v in e.items()})

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.bool_()),
                pa.array([r[2] for r in rows], pa.binary()),
            ],
            names=["bucket", "settled", "blob"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, number = [], 0, 0
        for batch in batches:
            columns = (batch.column(c) for c in ("__id", "__tag", "__text"))
            for id_, tag, text in zip(*(c for c in columns)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                m, c, s, r = stretches(data, min_bytes, gram)
                if not len(m):
                    continue
                parts.append(
                    {"m": m, "c": c, "id": np.full(len(m), id_.as_py()),
                     "tag": np.full(len(m), tag.as_py()), "s": s, "r": r, "d": np.zeros(len(m), np.uint8)}
                )
                held += len(m)
                if held >= held_most:
                    yield batch_of(list(flush(parts, number)))
                    parts, held, number = [], 0, number + 1
        if parts:
            yield batch_of(list(flush(parts, number)))

    return run


#: ``role``: 2 for the representative of a class with later occurrences, 1 for that of one without, else 0.
_FOUND = "m long, c long, id long, tag int, start long, size int, role int"


def _fold_bucket(table: pa.Table) -> pa.Table:
    """Occurrences of the classes of a bucket that another document could repeat, one of each class marked.

    A hash matters if its stretches stand in two documents; those that left early are known by their mark.
    """
    blobs = list(zip(table.column("settled").to_pylist(), table.column("blob").to_pylist()))
    done = _joined([_unpacked(b)[0] for settled, b in blobs if settled])
    e, _ = _folded(_joined([_unpacked(b)[0] for settled, b in blobs if not settled]))
    role = np.zeros(len(e["m"]), np.int32)
    if len(role):
        new_m = np.concatenate([[True], e["m"][1:] != e["m"][:-1]])
        new_c = new_m | np.concatenate([[True], e["c"][1:] != e["c"][:-1]])
        at, group = np.flatnonzero(new_m), np.cumsum(new_m) - 1
        spread = np.minimum.reduceat(e["id"], at) < np.maximum.reduceat(e["id"], at)
        matters = (spread | (np.maximum.reduceat(e["d"], at) > 0))[group]
        class_at, klass = np.flatnonzero(new_c), np.cumsum(new_c) - 1
        several = (np.diff(np.append(class_at, len(role))) > 1) | (e["d"][class_at] > 0)
        role = np.where(new_c, 1 + several[klass], 0)[matters].astype(np.int32)
        e = {k: v[matters] for k, v in e.items()}
    pick = lambda k: np.concatenate([done[k], e[k]])
    return pa.table(
        {
            "m": pa.array(pick("m").view(np.int64), pa.int64()),
            "c": pa.array(pick("c").view(np.int64), pa.int64()),
            "id": pa.array(pick("id"), pa.int64()),
            "tag": pa.array(pick("tag"), pa.int32()),
            "start": pa.array(pick("s"), pa.int64()),
            "size": pa.array(pick("r").astype(np.int32), pa.int32()),
            "role": pa.array(np.concatenate([np.zeros(len(done["m"]), np.int32), role]), pa.int32()),
        }
    )


# Step 2: suffix arrays of the stretches that share a hash.

def suffix_order(
    group: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray, length: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Enhanced suffix array of the first ``size`` suffixes of each string, by group.

    ``data`` holds the strings one after another, ``first`` and ``length`` say where.  Returns the
    string and the offset of each suffix in order, the length of its common prefix with the one
    before (0 at the first of a group), and the byte to its left (-1 at the start of a string).
    Strings are UTF-8, so they lack the byte 255 and leave 0 for what is beyond their end.
    """
    item = np.repeat(np.arange(len(first)), size)
    offset = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
    if not len(item):
        return item, offset, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rest, at = length[item] - offset, first[item] + offset
    longest = int(rest.max())
    padded = np.concatenate([data + np.uint8(1), np.zeros(longest, np.uint8)])
    rows = np.empty((len(item), 8 + longest), np.uint8)
    rows[:, :8] = np.unique(group, return_inverse=True)[1][item].astype(">u8")[:, None].view(np.uint8)
    rows[:, 8:] = np.lib.stride_tricks.sliding_window_view(padded, longest)[at]
    rows[:, 8:][np.arange(longest) >= rest[:, None]] = 0
    order = np.argsort(rows.view(f"S{8 + longest}").ravel(), kind="stable")
    rows, item, offset, rest = rows[order], item[order], offset[order], rest[order]
    differ = rows[1:] != rows[:-1]
    place = differ.argmax(axis=1)
    equal = np.where(differ[np.arange(len(place)), place], place - 8, longest)
    common = np.zeros(len(item), np.int64)
    common[1:] = np.clip(np.minimum(equal, np.minimum(rest[1:], rest[:-1])), 0, None)
    left = np.where(offset > 0, data[np.maximum(first[item] + offset - 1, 0)].astype(np.int64), -1)
    return item, offset, common, left


def maximal_intervals(common: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(begin, end, length) of the maximal repeats: intervals of the suffix array, end exclusive.

    A stack holds the open intervals of the common-prefix tree.  An interval is right-maximal by
    construction; it is left-maximal if its suffixes have different bytes to their left, or one
    has none.  Each open interval keeps the one left byte of all its suffixes so far, or -1.
    """
    out: list[tuple[int, int, int]] = []
    cuts = np.flatnonzero(common < least)
    starts = cuts[np.diff(np.append(cuts, len(common))) > 1]
    for start in starts.tolist():
        stack: list[list[int]] = []  # [length, begin, left byte]
        before = int(left[start])
        i = start + 1
        n = len(common)
        while i <= n:
            length = int(common[i]) if i < n and common[i] >= least else 0
            begin, byte = i - 1, before
            while stack and stack[-1][0] > length:
                top = stack.pop()
                if top[2] != byte:
                    top[2] = -1
                if top[2] == -1:
                    out.append((top[1], i, top[0]))
                begin, byte = top[1], top[2]
                if stack and stack[-1][0] >= length and stack[-1][2] != byte:
                    stack[-1][2] = -1
            if not length:
                break
            if not stack or stack[-1][0] < length:
                stack.append([length, begin, byte])
            before = int(left[i])
            if stack[-1][2] != before:
                stack[-1][2] = -1
            i += 1
    return out


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as sorted maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]])) if len(starts) else np.zeros(0, np.int64)
    return starts[new], ends[np.append(new[1:], len(starts)) - 1] if len(new) else ends


#: A representative on its way to its suffix array, before its bytes; ``k`` holds content hash, size and role.
_CHOSEN = [("m", "<u8"), ("k", "<u8"), ("id", "<i8")]
_SIZE_AT, _ROLE_AT = 48, 56
_HASH = (1 << _SIZE_AT) - 1


def _alone(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ``length`` bytes from ``first`` on, one after another, and where each starts."""
    begin = np.cumsum(length) - length
    return data[np.repeat(first - begin, length) + np.arange(length.sum())], begin


def _repeats_of(table: pa.Table, min_bytes: int, merge: bool, most: int) -> pa.Table:
    """``_repeats_among`` the representatives of a unit, hashes of some ``most`` classes at a time."""
    parts = [
        _unpacked(blob, _CHOSEN, n)
        for n, blob in zip(table.column("n").to_pylist(), table.column("blob").to_pylist())
    ]
    m, k, ids = (np.concatenate([e[name] for e, _ in parts]) for name, _ in _CHOSEN)
    data = np.concatenate([rest for _, rest in parts])
    sizes = ((k >> _U(_SIZE_AT)) & _U(255)).astype(np.int64)
    length = sizes + min_bytes - 1
    first = np.cumsum(length) - length
    order = np.argsort(m, kind="stable")
    m, k, ids, sizes, length, first = (x[order] for x in (m, k, ids, sizes, length, first))
    starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    after = np.searchsorted(starts, np.arange(0, len(m), most))
    cuts = np.unique(starts[after[after < len(starts)]])
    found = []
    for begin, end in zip(cuts, [*cuts[1:], len(m)]):
        one = slice(begin, end)
        found.append(_repeats_among(m[one], k[one], ids[one], data, first[one], sizes[one], length[one], min_bytes, merge))
    return pa.concat_tables(found)


def _repeats_among(
    m: np.ndarray, k: np.ndarray, ids: np.ndarray, data: np.ndarray, first: np.ndarray, sizes: np.ndarray,
    length: np.ndarray, min_bytes: int, merge: bool,
) -> pa.Table:
    """Maximal repeats among the representatives of one suffix array, one row per class and place in it.

    With ``merge`` only what they cover: of each class the runs that a document before its first one has
    too, and, where a class has later occurrences, its whole string.
    """
    c, several = k & _U(_HASH), k >> _U(_ROLE_AT) == 2
    data, first = _alone(data, first, length)
    item, offset, common, left = suffix_order(m, data, first, sizes, length)
    found = maximal_intervals(common, left, min_bytes)
    # The whole string of a class of several occurrences, unless a longer class begins with it: then an
    # interval of this length is there already.
    after = np.append(common[1:], 0)
    alone = (offset == 0) & several[item] & (np.maximum(common, after) < length[item])
    found += [(i, i + 1, int(length[item[i]])) for i in np.flatnonzero(alone).tolist()]
    spans = np.array(found, np.int64).reshape(-1, 3)
    counts = spans[:, 1] - spans[:, 0]
    starts = np.cumsum(counts) - counts
    rows = np.repeat(spans[:, 0], counts) + (np.arange(counts.sum()) - np.repeat(starts, counts))
    group, who, at = np.repeat(np.arange(len(spans)), counts), item[rows], offset[rows]
    size, least = spans[:, 2][group], np.minimum.reduceat(ids[who], starts)[group] if len(spans) else np.zeros(0, np.int64)
    if merge:
        # Strings are shorter than the room between two classes, so runs stay within theirs.
        room = 1 << LENGTH_BITS
        before = least < ids[who]
        begin, end = _merged(who[before] * room + at[before], who[before] * room + at[before] + size[before])
        again = np.flatnonzero(several)
        who = np.concatenate([begin // room, again])
        at = np.concatenate([begin % room, np.zeros(len(again), np.int64)])
        size = np.concatenate([end - begin, length[again]])
        least = np.concatenate([ids[begin // room] - 1, ids[again]])
        names = np.zeros(len(who), np.int64)
    else:
        at_byte = [(first[item[a]] + offset[a], n) for a, _, n in found]
        digests = [xxhash.xxh64_intdigest(data[i : i + n].tobytes()) for i, n in at_byte]
        names = np.array(digests, np.uint64).view(np.int64)[group]
    return pa.table(
        {
            "repeat": pa.array(names, pa.int64()),
            "m": pa.array(m[who].view(np.int64), pa.int64()),
            "c": pa.array(c[who].view(np.int64), pa.int64()),
            "offset": pa.array(at.astype(np.int32), pa.int32()),
            "length": pa.array(size.astype(np.int32), pa.int32()),
            "first_id": pa.array(least, pa.int64()),
        }
    )


def _squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with each text compressed: a shuffle's own codec leaves half as much again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                texts = pa.array([compressor.compress(t.as_py()) for t in batch.column("__text")], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id"), batch.column("__tag"), texts], names=["__id", "__tag", "__text"]
                )

    plain = rows.select("__id", "__tag", F.col("__text").cast("binary").alias("__text"))
    return plain.mapInArrow(run, "__id long not null, __tag int not null, __text binary not null")


def _fetched(min_bytes: int, units: int, squeezed: bool, most: int):
    """The bytes of the representatives asked for of each document, packed by unit, or in rows if there are no units."""

    def sent(parts: list, texts: list[bytes]) -> pa.RecordBatch:
        m, k, ids = (np.concatenate(x) for x in zip(*parts))
        if not units:
            columns = [pa.array(x, pa.int64()) for x in (m, k, ids)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=["m", "k", "id", "bytes"])
        home = (m.view(np.uint64) >> _U(20)) % _U(units)
        order = np.argsort(home, kind="stable")
        home, m, k, ids = home[order], m[order], k[order], ids[order]
        texts = [texts[i] for i in order.tolist()]
        cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])).tolist()
        ends = [*cuts[1:], len(home)]
        blobs = [
            _packed({"m": m[a:b], "k": k[a:b], "id": ids[a:b]}, _CHOSEN, b"".join(texts[a:b]))
            for a, b in zip(cuts, ends)
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(home[cuts].astype(np.int32), pa.int32()),
                pa.array([b - a for a, b in zip(cuts, ends)], pa.int32()),
                pa.array(blobs, pa.binary()),
            ],
            names=["unit", "n", "blob"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress if squeezed else bytes
        parts, texts = [], []
        for batch in batches:
            lists = batch.column("wanted")
            offsets = lists.offsets.to_numpy()
            m, k, start = (lists.values.field(x).to_numpy(zero_copy_only=False) for x in ("m", "k", "start"))
            end = start + ((k >> _SIZE_AT) & 255) + min_bytes - 1
            for i, (id_, text) in enumerate(zip(batch.column("__id"), batch.column("__text"))):
                data = opened(text.as_py())
                # Texts of one id and tag share a list, and the shorter one lacks places of the longer.
                own = offsets[i] + np.flatnonzero(end[offsets[i] : offsets[i + 1]] <= len(data))
                if not len(own):
                    continue
                texts += [data[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())]
                parts.append((m[own], k[own], np.full(len(own), id_.as_py())))
                if len(texts) >= most:
                    yield sent(parts, texts)
                    parts, texts = [], []
        if parts:
            yield sent(parts, texts)

    return run


_BYTES = "m long, k long, id long, bytes binary"
_UNITS = "unit int, n int, blob binary"
_INTERVALS = "repeat long, m long, c long, offset int, length int, first_id long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id`` (null: after all others), ``__tag`` (24 bits of the text's hash) and ``__text``."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"),
        F.xxhash64(F.col(text_col)).bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("__tag"),
        F.col(text_col).alias("__text"),
    ).filter(F.col("__text").isNotNull())


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    gram: int = GRAM,
    crowd: int = CROWD,
) -> DataFrame:
    """``repeat, id, tag, start, length, first_id``: occurrences of repeated strings of ``min_bytes`` bytes or more.

    ``repeat`` names the string, ``first_id`` is the smallest document it stands in, and every occurrence
    is a row, those in the smallest document too.  Strings are maximal within their stretch; a longer repeat is a chain of overlapping
    ones, and their union over a document is exactly the bytes of windows that a smaller document
    has too.  A hash with more than ``crowd`` classes gives its windows instead of maximal strings.
    """
    rows = _keyed(docs, id_col, text_col)
    return _occurrences(rows, _squeezed(rows), min_bytes, gram, crowd, merge=False)


def _occurrences(
    rows: DataFrame, squeezed: DataFrame, min_bytes: int, gram: int, crowd: int, merge: bool
) -> DataFrame:
    """What ``repeats`` returns; with ``merge`` the covered runs of each occurrence (``id`` above ``first_id``)."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    packed = rows.mapInArrow(
        _scan(buckets, min_bytes, gram, FLUSH), "bucket int, settled boolean, blob binary"
    )
    found = stage(packed.groupBy("bucket").applyInArrow(_fold_bucket, _FOUND), "stretches", "zstd", release=True)
    chosen = found.filter(F.col("role") > 0)
    by_hash = chosen.groupBy("m").agg(F.count("*").alias("n"))
    crowded = stage(by_hash.filter(F.col("n") > crowd).select("m"), "crowded-hashes", release=True)
    units, most = max(1, -(-chosen.count() // UNIT)), ARRAY_STRETCHES
    wanted = _with_lists(squeezed, _lists(chosen.join(crowded, "m", "left_anti")))
    intervals = (
        wanted.mapInArrow(_fetched(min_bytes, units, True, FETCHED), _UNITS)
        .groupBy("unit")
        .applyInArrow(lambda t: _repeats_of(t, min_bytes, merge, most), _INTERVALS)
    )
    if not crowded.isEmpty():
        lists = stage(_lists(chosen.join(crowded, "m", "left_semi")), "wanted-stretches", release=True)
        few = lists.agg(F.coalesce(F.sum(F.size("wanted") * 64 + 64), F.lit(0))).first()[0] <= RESULT_BYTES
        # Texts stay in place if the lists are few.
        plain = rows.withColumn("__text", F.col("__text").cast("binary"))
        wanted = _with_lists(plain, F.broadcast(lists)) if few else _with_lists(squeezed, lists)
        fetched = wanted.mapInArrow(_fetched(min_bytes, 0, not few, 8 * ROWS_OUT), _BYTES)
        intervals = intervals.unionByName(_by_window(stage(fetched, "crowded-bytes", release=True), min_bytes))
    # What brought the representatives together is gone before occurrences are shuffled.
    intervals = stage(intervals, "intervals", "zstd", release=True)
    # A class stands in several intervals and has many occurrences; adaptive execution splits a hot one.
    return found.select("m", "c", "id", "tag", "start").join(intervals, ["m", "c"]).select(
        "repeat", "id", "tag", (F.col("start") + F.col("offset")).alias("start"), "length", "first_id"
    )


def _lists(chosen: DataFrame) -> DataFrame:
    """The stretches of ``chosen`` in a list per document."""
    k = F.col("c").bitwiseOR(F.shiftleft(F.col("size").cast("long"), _SIZE_AT))
    k = k.bitwiseOR(F.shiftleft(F.col("role").cast("long"), _ROLE_AT)).alias("k")
    return chosen.groupBy("id", "tag").agg(F.collect_list(F.struct("m", k, "start")).alias("wanted"))


def _with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    joined = rows.join(lists, (rows["__id"] == lists["id"]) & (rows["__tag"] == lists["tag"]))
    return joined.select("__id", "__text", "wanted")


def _by_window(chosen: DataFrame, min_bytes: int) -> DataFrame:
    """Windows of crowded classes that two of them, or two occurrences of one, have."""
    size = F.shiftright("k", _SIZE_AT).bitwiseAND(F.lit(255)).cast("int")
    windows = chosen.select(
        "m", F.col("k").bitwiseAND(F.lit(_HASH)).alias("c"), "id", F.shiftright("k", _ROLE_AT).alias("role"), "bytes",
        F.explode(F.sequence(F.lit(0), size - 1)).alias("offset"),
    ).withColumn("w", F.substring(F.col("bytes"), F.col("offset") + 1, F.lit(min_bytes)))
    windows = windows.select(
        "m", "c", "id", "role", "offset", F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(1), "w").alias("w2")
    )
    met = windows.groupBy("w1", "w2").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("role").alias("most")
    )
    shared = met.filter((F.col("first_id") < F.col("last_id")) | (F.col("most") == 2)).select("w1", "w2", "first_id")
    return windows.join(shared, ["w1", "w2"]).select(
        F.col("w1").alias("repeat"), "m", "c", "offset", F.lit(min_bytes).alias("length"), "first_id"
    )


def removed_runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of the spans as sorted maximal runs."""
    first, last = _merged(starts, ends)
    return list(zip(first.tolist(), last.tolist()))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    gram: int = GRAM,
    crowd: int = CROWD,
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) of each row of ``docs``.

    Removed is every byte of a string of ``min_bytes`` bytes that also starts in a document with a
    smaller id.  Kept bytes may not be whole characters, so they are binary.  A null text is empty.
    A row of null id comes after all others; rows of one id never remove from each other.  Ids that
    are no whole numbers are numbered in their order first.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        names = docs.select(F.lit("").alias("grp"), F.col(id_col).alias("name")).filter(F.col("name").isNotNull())
        places = stage(ranked(names.distinct(), "grp", ["name"]).select("name", "pos"), "id-places")
        numbered = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(places, "name", "left")
        found = remove_repeats(numbered, "pos", "text", min_bytes, gram, crowd)
        named = found.join(places, "pos", "left")
        return named.select(F.col("name").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
    rows = _keyed(docs, id_col, text_col)
    squeezed = _squeezed(rows)
    # One number a span: a document's list of structs would take five times the room.
    packed = F.shiftleft("start", LENGTH_BITS).bitwiseOR(F.col("length").cast("long"))
    spans = (
        _occurrences(rows, squeezed, min_bytes, gram, crowd, merge=True)
        .filter(F.col("id") > F.col("first_id"))
        .groupBy("id", "tag")
        .agg(F.collect_list(packed).alias("spans"))
    )
    joined = squeezed.join(
        spans, (squeezed["__id"] == spans["id"]) & (squeezed["__tag"] == spans["tag"]), "left"
    ).select("__id", "__text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def made(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            lists = batch.column("spans")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (id_, text) in enumerate(zip(batch.column("__id"), batch.column("__text"))):
                id_, data = id_.as_py(), opened(text.as_py())
                own = flat[offsets[i] : offsets[i + 1]]
                begins = own >> LENGTH_BITS
                runs = removed_runs(begins, begins + (own & ((1 << LENGTH_BITS) - 1)))
                kept, at = [], 0
                for begin, end in runs:
                    kept.append(data[at:begin])
                    at = end
                kept.append(data[at:])
                rest = b"".join(kept)
                for column, value in zip(out, (id_, len(data), len(data) - len(rest), len(runs), rest)):
                    column.append(value)
                if len(out[0]) >= ROWS_OUT:
                    yield made(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield made(out)

    real = joined.mapInArrow(cut, schema)
    empty = docs.filter(F.col(text_col).isNull()).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")],
        F.lit(b"").alias("kept"),
    )
    return real.unionByName(empty).select(
        F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias(id_col),
        "n_bytes",
        "n_removed",
        "n_spans",
        "kept",
    )

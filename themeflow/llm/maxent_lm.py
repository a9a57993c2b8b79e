"""Language model: hashed maximum entropy over n-gram and skip features, class-factored softmax.

A token's probability is that of its class given hashed features of the three tokens before it,
times that of the token in its class.  Classes are bins of equal root frequency; the words that
the bound on the shared table leaves out form one class of their own, smoothed by their counts.
The class weights are trained by rounds of distributed gradient updates: every task runs
mini-batches over its documents from the weights of the round before, and the results are averaged
in two levels, each feature by the tokens that had it.  The rounds together read every training document once.

Counts of all training tokens stay a table.  Only words with at least one token in ``2 ** WORD_BITS``
(so at most that many words) are shared with all tasks; other words meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.operators.staging import stage

FOLDS, HELD_OUT = 7, 2
WORD_BITS = 18
CLASSES = 32
BUCKET_BITS = 14
ROUNDS = 2
#: The end of a text, as a word; no word is empty.
END = b""
_END_CLASS, _RARE_CLASS = 0, 1
_RARE, _START, _FIRST = 0, 1, 2  # ids of rare words, of what stands before a text, of frequent words
_TOKENS = 8192
_BLOCK = 512
_FLUSH = 400_000
_ROW = np.uint16 if BUCKET_BITS <= 16 else np.int64


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 7; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))), F.lit(FOLDS)).cast("int")


def tokens(text: str | None) -> list[bytes]:
    """Words (A to Z in lower case) without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (binary) and ``c``, its number in all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "c"],
            )

        for batch in batches:
            for text in batch.column("__text"):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) > _FLUSH:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    return (
        docs.select(F.col(text_col).alias("__text"))
        .mapInArrow(run, "word binary, c long")
        .groupBy("word")
        .agg(F.sum("c").alias("c"))
    )


@dataclass
class Vocabulary:
    """Frequent words with ids, classes and counts, and totals of all words."""

    ids: dict[bytes, int]
    classes: np.ndarray  # by id
    counts: np.ndarray  # by id, 0 for the first two
    tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int

    def class_tokens(self) -> np.ndarray:
        out = np.bincount(self.classes[_FIRST:], weights=self.counts[_FIRST:], minlength=CLASSES)
        out[_RARE_CLASS] = self.rare_tokens
        return out


def vocabulary(words: DataFrame, word_bits: int = WORD_BITS) -> Vocabulary:
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, distinct = int(total[0]), int(total[1])
    rows = (
        words.filter((F.col("word") != F.lit(END)) & (F.col("c") * (1 << word_bits) >= n))
        .orderBy(F.desc("c"), "word")
        .collect()  # 2 ** word_bits rows at most: their shares of all tokens add up to 1
    )
    ends = sum(r["c"] for r in words.filter(F.col("word") == F.lit(END)).collect())
    counts = np.array([0, 0, ends, *(r["c"] for r in rows)], np.int64)
    classes = np.full(len(counts), _RARE_CLASS, np.int64)
    classes[_FIRST] = _END_CLASS
    if rows:
        roots = np.cumsum(np.sqrt(counts[_FIRST + 1 :]))
        bins = np.minimum((roots - roots[0]) / roots[-1] * (CLASSES - 2), CLASSES - 3).astype(np.int64)
        classes[_FIRST + 1 :] = 2 + bins
    ids = {bytes(r["word"]): _FIRST + 1 + i for i, r in enumerate(rows)}
    known = int(counts.sum())
    return Vocabulary(
        ids, classes, counts, n, distinct, n - known, distinct - len(rows) - (1 if ends else 0)
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def feature_rows(ids: np.ndarray, at: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """Rows of the weights for each token at ``at``: n-grams and skips over the three before it."""
    one, two, three = (ids[at - k].astype(np.uint64) for k in (1, 2, 3))
    prime = np.uint64(0x9E3779B97F4A7C15)
    kinds = (
        one,
        two,
        three,
        one * prime + two,
        one * prime + three,
    )
    with np.errstate(over="ignore"):
        return np.stack(
            [
                (_mixed(k * prime + np.uint64(i + 1) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - bits)).astype(np.int64)
                for i, k in enumerate(kinds)
            ]
        )


def _log_chances(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    # ``take`` with clipped places copies whole rows, three times as fast as an index.
    logits = weights.take(rows[0], axis=0, mode="clip") + bias
    for row in rows[1:]:
        logits += weights.take(row, axis=0, mode="clip")
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _encoded(texts: Iterator[str | None], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list]:
    """Ids with three starts before each text, places of the tokens, and words by text."""
    out: list[int] = []
    sizes, words = [], []
    for text in texts:
        w = tokens(text)
        out += (_START, _START, _START)
        out.extend(map(ids.get, w, repeat(_RARE)))
        out.append(_FIRST)
        sizes.append(len(w) + 1)
        words.append(w)
    size = np.array(sizes, np.int64)
    first = np.cumsum(size + 3) - size
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.array(out, np.int64), at, words


def _row_sums(values: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows ``places`` of ``values`` between the marks ``first``; most sums have one or two rows."""
    size = np.diff(np.append(first, len(places)))
    out = np.empty((len(first), values.shape[1]), values.dtype)
    one, two, more = first[size == 1], first[size == 2], size > 2
    take = lambda at: values.take(places[at], axis=0, mode="clip")
    out[size == 1] = take(one)
    out[size == 2] = take(two) + take(two + 1)
    if more.any():
        out[more] = np.add.reduceat(take(np.repeat(more, size)), np.cumsum(size[more]) - size[more], axis=0)
    return out


def _train_task(weights: np.ndarray, bias: np.ndarray, vocab: Vocabulary, rate: float):
    """Weights after one pass over a partition's documents, in blocks, with the tokens seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = weights.copy(), bias.copy()
        squares = np.full(len(w), 1.0, np.float32)
        touches = np.zeros(len(w), np.float32)
        seen = 0
        salt = None

        def learn(texts: list) -> None:
            nonlocal b, seen
            ids, at, _ = _encoded(iter(texts), vocab.ids)
            classes = vocab.classes[ids]
            for begin in range(0, len(at), _TOKENS):
                here = at[begin : begin + _TOKENS]
                rows = feature_rows(ids, here)
                error = np.exp(_log_chances(w, b, rows))
                error[np.arange(len(here)), classes[here]] -= 1.0
                flat = rows.ravel().astype(_ROW)
                order = np.argsort(flat, kind="stable")  # a radix sort of numbers this short
                flat = flat[order]
                first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                step = _row_sums(error, order % len(here), first)
                touched = flat[first]
                touches[touched] += np.diff(np.append(first, len(flat)))
                squares[touched] += np.einsum("ij,ij->i", step, step)
                w[touched] -= rate * step / np.sqrt(squares[touched])[:, None]
                b = b - rate * error.mean(axis=0) * 0.1
                seen += len(here)

        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column("__salt"), batch.column("__text")):
                salt = key.as_py() if salt is None else salt
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size > 1 << 20:
                    learn(held)
                    held, size = [], 0
        if held:
            learn(held)
        if seen:
            blocks = range(0, len(w), _BLOCK)
            parts = [w[i : i + _BLOCK].astype(np.float32).tobytes() for i in blocks]
            parts.append(b.astype(np.float32).tobytes())
            counts = [touches[i : i + _BLOCK].tobytes() for i in blocks] + [np.array([seen], np.float32).tobytes()]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(n), pa.int32()),
                    pa.array([salt] * n, pa.int32()),
                    pa.array(counts, pa.binary()),
                    pa.array(parts, pa.binary()),
                ],
                names=["block", "salt", "touches", "part"],
            )

    return run


_PARTS = "block int, salt int, touches binary, part binary"


def _averaged(table: pa.Table) -> pa.Table:
    """Mean of the parts' weights of a block, each row weighted by the tokens that touched it.

    A feature that few parts have seen is not pulled back by those that have not.  Rows that none has
    seen are the same everywhere.
    """
    total = touched = plain = 0.0
    for counts, part in zip(table.column("touches"), table.column("part")):
        n = np.frombuffer(counts.as_py(), np.float32).astype(np.float64)
        w = np.frombuffer(part.as_py(), np.float32).astype(np.float64).reshape(len(n), -1)
        total, touched, plain = total + n[:, None] * w, touched + n, plain + w
    mean = np.where(touched[:, None] > 0, total / np.maximum(touched, 1)[:, None], plain / table.num_rows)
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "salt": pa.array([0], pa.int32()),
            "touches": pa.array([touched.astype(np.float32).tobytes()], pa.binary()),
            "part": pa.array([mean.astype(np.float32).tobytes()], pa.binary()),
        }
    )


def train(
    docs: DataFrame, text_col: str, id_col: str, vocab: Vocabulary, rounds: int = ROUNDS, rate: float = 0.5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights by hashed feature and class, and the bias of each class."""
    share = vocab.class_tokens()
    bias = np.log((share + 1) / (share.sum() + CLASSES)).astype(np.float32)
    weights = np.zeros((1 << BUCKET_BITS, CLASSES), np.float32)
    tasks = max(1, docs.rdd.getNumPartitions())
    salts = max(1, round(tasks**0.5))
    for r in range(rounds):
        key = F.xxhash64(F.col(id_col), F.lit("round"))
        part = docs.filter(F.pmod(key, F.lit(rounds)) == r).select(
            F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int").alias("__salt"),
            F.col(text_col).alias("__text"),
        )
        learned = part.mapInArrow(_train_task(weights, bias, vocab, rate), _PARTS)
        rows = (
            learned.groupBy("block", "salt")
            .applyInArrow(_averaged, _PARTS)
            .groupBy("block")
            .applyInArrow(_averaged, _PARTS)
            .collect()  # the weights: as many blocks for any input
        )
        if not rows:
            break
        by_block = {x["block"]: np.frombuffer(x["part"], np.float32) for x in rows}
        bias = by_block.pop(max(by_block)).copy()
        weights = np.concatenate([by_block[i] for i in sorted(by_block)]).reshape(weights.shape)
    return weights, bias


_SCORED = (
    "key long, word binary, n long, n_tokens long, n_rare long, n_known long, "
    "base double, class_score double"
)


def _score_task(weights: np.ndarray, bias: np.ndarray, vocab: Vocabulary):
    """One row per document with the sums over its frequent words, and its rare words counted."""
    inside = vocab.class_tokens()
    with np.errstate(divide="ignore"):
        word_log = np.log10(np.maximum(vocab.counts, 1) / np.maximum(inside[vocab.classes], 1))
    word_log[[_RARE, _START]] = 0.0
    base_log = np.log10(vocab.counts + 1.0)
    base_log[[_RARE, _START]] = 0.0

    def scored(keys: list[int], texts: list) -> pa.RecordBatch:
        ids, at, words = _encoded(iter(texts), vocab.ids)
        classes = vocab.classes[ids]
        chances = np.empty(len(at))
        for begin in range(0, len(at), _TOKENS):
            here = at[begin : begin + _TOKENS]
            logs = _log_chances(weights, bias, feature_rows(ids, here))
            chances[begin : begin + _TOKENS] = logs[np.arange(len(here)), classes[here]]
        own = ids[at]
        size = np.array([len(w) + 1 for w in words], np.int64)
        first = np.cumsum(size) - size
        add = lambda x: np.add.reduceat(x, first)
        rare = own == _RARE
        columns: list[list] = [
            list(keys), [None] * len(keys), [None] * len(keys), size.tolist(), add(rare.astype(np.int64)).tolist(),
            add((vocab.counts[own] > 0).astype(np.int64)).tolist(), add(base_log[own]).tolist(),
            add(chances / np.log(10) + word_log[own]).tolist(),
        ]
        for key, w, n, begin in zip(keys, words, columns[4][:], first):
            if n:
                found = Counter(map(w.__getitem__, np.flatnonzero(rare[begin : begin + len(w)]).tolist()))
                columns[0] += [key] * len(found)
                columns[1] += found.keys()
                columns[2] += found.values()
        more = len(columns[0]) - len(keys)
        for column in columns[3:]:
            column += [None] * more
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["key", "word", "n", "n_tokens", "n_rare", "n_known", "base", "class_score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("__key"), batch.column("__text")):
                keys.append(key.as_py())
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held > 1 << 20 or len(keys) >= 5000:
                    yield scored(keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield scored(keys, texts)

    return run


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    word_bits: int = WORD_BITS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``id_col`` and the scores of each row of ``docs``; a null text is empty, its end is scored.

    ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (smoothed unigrams) and ``score`` (the model), both sums of log10 probabilities.
    Everything is learned from the rows that aren't held out.  Without any, every token is unknown.
    """
    own = fold(F.col(id_col)) == HELD_OUT
    training = docs.filter(~own).select(id_col, text_col)
    words = stage(count_words(training, text_col), "word-counts")
    vocab = vocabulary(words, word_bits)
    weights, bias = train(training, text_col, id_col, vocab, rounds)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    found = stage(
        docs.select(key.alias("__key"), F.col(text_col).alias("__text")).mapInArrow(
            _score_task(weights, bias, vocab), _SCORED
        ),
        "token-sums",
    )
    rare = words.filter(F.col("c") * (1 << word_bits) < vocab.tokens)
    sums = (
        found.filter(F.col("word").isNotNull())
        .select("key", "word", "n")
        .join(rare, "word")
        .groupBy("key")
        .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"), F.sum("n").alias("rare_known"))
    )
    # Rows with the same id and text have one key; each has put its rare words in once.
    whole = (
        found.filter(F.col("word").isNull())
        .groupBy("key")
        .agg(
            F.count("*").alias("copies"),
            *[F.min(c).alias(c) for c in ("n_tokens", "n_rare", "n_known", "base", "class_score")],
        )
        .join(sums, "key", "left")
        .withColumn("rare_log", F.coalesce(F.col("rare_log") / F.col("copies"), F.lit(0.0)))
        .withColumn("rare_known", F.coalesce(F.col("rare_known") / F.col("copies"), F.lit(0)).cast("long"))
    )
    room = float(np.log10(vocab.tokens + vocab.distinct + 1))
    rare_room = float(np.log10(vocab.rare_tokens + vocab.rare_distinct + 1))
    keyed = docs.select(id_col, own.alias("held_out"), key.alias("key"))
    return keyed.join(whole, "key").select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_log") - F.col("n_tokens") * room).alias("base_score"),
        (F.col("class_score") + F.col("rare_log") - F.col("n_rare") * rare_room).alias("score"),
    )

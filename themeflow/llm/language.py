"""Language identification: known words first, then ever shorter character n-grams.

For each language the logarithm of each word's relative frequency is learned, and of each character
n-gram inside words.  A text is scored by its words: one that was learned in any language adds its
log frequencies; one that never was falls back to its longest n-grams that were, so five
characters are tried before four, down to single ones.  Training counts are made by Spark from a
bounded sample of whole texts per language; scoring is one pass over all texts in NumPy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of training texts, all languages together; more are sampled by the hash of their id, whole texts only.
SAMPLE_CHARS = 24_000_000
#: Longest n-gram tried for an unknown word.
MAX_N = 5
#: Added to each count of a key that a language never had.
SMOOTHING = 0.1
#: Words scored at a time.
_WORDS = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
_HASH_BITS = 20
UNDETERMINED = "und"

#: Hash of n-grams: a polynomial in this odd number, modulo 2^64.
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> Iterator[str]:
    """Runs of letters in lower case; a run with other signs that count as letters in patterns keeps its letters."""
    for found in _LETTERS.finditer(text):
        word = found.group()
        if not word.isalpha():
            word = "".join(filter(str.isalpha, word))
        if word:
            yield word.lower()


def grams_of(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-grams of all words, each between two marks, and the word each belongs to."""
    marked = "".join(f"\x01{w}\x02" for w in words)
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    count = len(code) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashed = np.full(count, np.uint64(n))
    for k in range(n):
        hashed = hashed * _MULTIPLIER + code[k : k + count] + np.uint64(1)
    hashed ^= hashed >> np.uint64(29)
    inside = owner[:count] == owner[n - 1 :]
    if n == 1:
        inside = code > 2
    return hashed[inside], owner[:count][inside]


@dataclass(frozen=True)
class Table:
    """Log frequencies by key and language; ``floor`` is that of a key a language never had.

    ``gain`` is what each (key, language) that was counted has above the floor; the entries of the key
    in row ``r`` are those from ``begin[r]`` to ``begin[r + 1]``.
    """

    begin: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    def add(self, rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        """Log frequencies of the keys in ``rows``, summed into ``n`` groups by ``to``: groups x languages."""
        counts = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(counts)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[rows] - ends + counts, counts)
        cell = np.repeat(to, counts) * len(self.floor) + self.language[entry]
        summed = np.bincount(cell, self.gain[entry], minlength=n * len(self.floor)).reshape(n, -1)
        return summed + np.bincount(to, minlength=n)[:, None] * self.floor


def _table(key: np.ndarray, language: np.ndarray, count: np.ndarray, n_keys: int, n_languages: int) -> Table:
    order = np.lexsort((language, key))
    key, language, count = key[order], language[order], count[order]
    totals = np.bincount(language, count, minlength=n_languages) + SMOOTHING * max(1, n_keys)
    floor = np.log(SMOOTHING / totals)
    gain = np.log((count + SMOOTHING) / totals[language]) - floor[language]
    return Table(np.searchsorted(key, np.arange(n_keys + 1)), language, gain, floor)


@dataclass(frozen=True)
class Model:
    """``words`` to their row; by length the sorted hashes of n-grams, which are their rows."""

    languages: list[str]
    words: dict[str, int]
    by_word: Table
    grams: list[np.ndarray]
    by_gram: list[Table]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log frequency of each word in each language (words x languages)."""
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        scores = np.zeros((len(words), len(self.languages)))
        there = np.flatnonzero(known >= 0)
        scores[there] = self.by_word.add(known[there], np.arange(len(there)), len(there))
        open_words = np.flatnonzero(known < 0)
        for n in range(len(self.grams), 0, -1):
            if not len(open_words) or not len(self.grams[n - 1]):
                continue
            hashed, owner = grams_of([words[k] for k in open_words], n)
            keys = self.grams[n - 1]
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            hit = keys[at] == hashed
            found = np.bincount(owner[hit], minlength=len(open_words))
            summed = self.by_gram[n - 1].add(at[hit], owner[hit], len(open_words))
            done = found > 0
            scores[open_words[done]] = summed[done] / found[done][:, None]
            open_words = open_words[~done]
        return scores


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of the words of each batch, summed within it."""
    for batch in batches:
        counts: dict[str, Counter[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
        rows = [(lang, w, n) for lang, found in counts.items() for w, n in found.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64())],
            names=["lang", "word", "n"],
        )


def remainder(id_column: Column, by: int) -> Column:
    """Unsigned CRC-32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(id_column.cast("string")) % by


def train(
    rows: DataFrame, id_col: str, text_col: str, lang_col: str, sample_chars: int = SAMPLE_CHARS, max_n: int = MAX_N
) -> Model:
    """The model of ``rows``, all of which may be learned from; rows without text or language are not.

    Each language has an equal share of ``sample_chars``.  One with more is sampled by the hash of the
    id, so the sample depends neither on the layout nor on the order of rows; its row of the smallest
    hash is always in.  The model grows with the sample, that is, up to the bound.
    """
    spot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << _HASH_BITS))
    known = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), spot.alias("spot")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = known.groupBy("lang").agg(
        F.sum(F.char_length("text")).alias("chars"), F.min("spot").alias("least")
    ).collect()
    languages = sorted(r["lang"] for r in sizes)
    share = sample_chars / max(1, len(languages))
    limits = [(r["lang"], max(r["least"], int((1 << _HASH_BITS) * min(1.0, share / max(1, r["chars"]))))) for r in sizes]
    spark = rows.sparkSession
    chosen = known.join(F.broadcast(spark.createDataFrame(limits, "lang string, last long")), "lang").filter("spot <= last")
    counts = (
        chosen.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    )
    counts = counts.sort_by([("word", "ascending"), ("lang", "ascending")])
    number = {lang: k for k, lang in enumerate(languages)}
    word, lang = counts["word"].to_pylist(), np.array([number[x] for x in counts["lang"].to_pylist()], np.int64)
    n = counts["n"].to_numpy().astype(np.float64)
    codes, distinct = pd.factorize(np.array(word, object)) if word else (np.empty(0, np.int64), [])
    by_word = _table(codes, lang, n, len(distinct), len(languages))
    grams, tables = [], []
    for k in range(1, max_n + 1):
        hashed, owner = grams_of(word, k) if word else (np.empty(0, np.uint64), np.empty(0, np.int64))
        keys, key = np.unique(hashed, return_inverse=True)
        pair, at = np.unique(key * max(1, len(languages)) + lang[owner], return_inverse=True)
        summed = np.bincount(at, n[owner], minlength=len(pair))
        of = max(1, len(languages))
        grams.append(keys)
        tables.append(_table(pair // of, pair % of, summed, len(keys), len(languages)))
    return Model(languages, {w: k for k, w in enumerate(distinct)}, by_word, grams, tables)


def text_scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Summed log frequencies (texts x languages) and the number of words of each text.

    Words are taken so many at a time, so a text of any length is scored whole.
    """
    totals = np.zeros((len(texts), len(model.languages)))
    n_words = np.zeros(len(texts), np.int64)
    stream = ((k, w) for k, text in enumerate(texts) if text for w in words_of(text))
    while some := list(islice(stream, _WORDS)):
        owner = np.fromiter((k for k, _ in some), np.int64, len(some))
        codes, distinct = pd.factorize(np.array([w for _, w in some], object))
        scores = model.word_scores(list(distinct))
        first, last = owner[0], owner[-1] + 1
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        totals[owner[edges]] += np.add.reduceat(scores[codes], edges, axis=0)
        n_words[first:last] += np.bincount(owner - first, minlength=last - first)
    return totals, n_words


def predict(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3,
    held_fold: int = 1, sample_chars: int = SAMPLE_CHARS, max_n: int = MAX_N,
) -> tuple[DataFrame, Model]:
    """``id_col``, ``held_out``, ``lang_pred`` and ``score`` of each row of ``docs``, and the model.

    Rows of the held-out fold are never learned from; a null id is in no fold and may be.  ``score`` is
    the predicted language's share of the likelihood.  A text that is null or has no letter, and any
    text where nothing was learned, is ``und`` with score 0; a text of unknown signs only and other
    ties go to the first language by code points.  Repeated rows have equal results.
    """
    fold = F.coalesce(remainder(F.col(id_col), folds), F.lit(-1))
    model = train(docs.filter(fold != held_fold), id_col, text_col, lang_col, sample_chars, max_n)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), (fold == held_fold).alias("held_out"), F.col(text_col).alias("text"))
    schema = rows.select("id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if known.languages and batch.num_rows:
                totals, n_words = text_scores(known, batch.column("text").to_pylist())
                best = totals.argmax(axis=1)
                share = 1 / np.exp(totals - totals.max(axis=1)[:, None]).sum(axis=1)
                names = [known.languages[k] if n else UNDETERMINED for k, n in zip(best, n_words)]
                scores = np.where(n_words > 0, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col), model

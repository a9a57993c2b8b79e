"""Secret scan: patterns of credentials, and random strings by their token efficiency.

A vocabulary learned from ordinary text spends few tokens on words and many on random strings.
Long runs of key characters whose characters per token are low are reported, unless they are
digests, UUIDs, numbers or identifiers made of words.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.llm.spans import KindSpan, spans_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
#: Runs of fewer characters aren't tested; below this many characters per token a run is random.
MIN_RUN = 20
RATIO = 2.1
#: Pieces of letters with at least so many characters per token are words.
WORD_RATIO = 2.5

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PIECES = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"


def base_spans(text: str) -> list[KindSpan]:
    """assign, access and hex spans, in this order of kinds."""
    out: list[KindSpan] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return out


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


def known_form(run: str, vocabulary: str = VOCABULARY) -> bool:
    """A digest, a UUID, a number, or words of the vocabulary joined by case or punctuation.

    Words are told by the method itself: long pieces of letters with many characters per token.
    """
    if _UUID.fullmatch(run) or (_DIGEST.fullmatch(run) and len(run) in _DIGEST_SIZES):
        return True
    if not any(c.isalpha() for c in run):
        return True
    words = [p for p in _PART.findall(run) if p.isalpha() and len(p) >= 3]
    size = sum(map(len, words))
    if size < 0.6 * sum(c.isalnum() for c in run):
        return False
    encode = encoding(vocabulary).encode_ordinary
    return size >= WORD_RATIO * sum(len(encode(p)) for p in words)


def random_runs(text: str, vocabulary: str, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Runs of key characters with fewer than ``ratio`` characters per token."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        core = run.strip("=-_/+")
        if len(core) < MIN_RUN or known_form(core, vocabulary):
            continue
        if len(core) < ratio * len(encoding(vocabulary).encode_ordinary(core)):
            begin = m.start() + run.index(core)
            out.append((begin, begin + len(core)))
    return out


def all_spans(text: str, vocabulary: str, ratio: float = RATIO) -> tuple[list[KindSpan], list[KindSpan]]:
    """Base spans, and base spans with the random runs that overlap none of them."""
    base = base_spans(text)
    added = [
        (3, a, b)
        for a, b in random_runs(text, vocabulary, ratio)
        if not any(a < e and s < b for _, s, e in base)
    ]
    return base, base + added


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    ratio: float = RATIO,
) -> DataFrame:
    """``id_col``, counts of each kind, ``base`` and ``spans`` of every row of ``docs``.

    ``base`` and ``spans`` are kind:start:end, by start and kind, comma-joined, in code points.
    ``vocabulary`` is a tiktoken file that every executor can read.  A null text is empty.
    """
    counts = [f"n_{kind}" for kind in KINDS]
    schema = docs.select(
        id_col, *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("base"), F.lit("").alias("spans")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: list[list[int]] = [[] for _ in KINDS]
            texts: list[list[str]] = [[], []]
            for value in batch.column("__text"):
                base, spans = all_spans(value.as_py() or "", vocabulary, ratio)
                for k, column in enumerate(numbers):
                    column.append(sum(kind == k for kind, _, _ in spans))
                texts[0].append(spans_text(base, KINDS))
                texts[1].append(spans_text(spans, KINDS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"),
                    *(pa.array(c, pa.int64()) for c in numbers),
                    *(pa.array(c, pa.string()) for c in texts),
                ],
                names=[id_col, *counts, "base", "spans"],
            )

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)

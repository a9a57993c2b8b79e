"""Personal data: patterns, and a semi-Markov conditional random field for forms they miss.

The field scores whole candidate segments of tokens by features of the span (digits, groups,
separators, its ends and neighbours), and a dynamic program over segments of bounded length chooses
boundaries and types jointly.  It is trained on what the patterns find in a bounded sample of the
corpus, rewritten in other common forms (other separators, spelled-out signs, no country code), so
it learns the entities rather than the patterns.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.llm.spans import KindSpan, spans_text

KINDS = ("email", "ip", "card", "phone")
#: Rows of the training sample, those with the smallest hashes among rows with a pattern's match.
SAMPLE_ROWS = 600
#: Longest entity in tokens, longest region in tokens.
MAX_SEGMENT = 24
MAX_REGION = 64
#: A decoded segment is added if its posterior odds against no entity are at least this (log).
MARGIN = 2.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[KindSpan]:
    """Matches of the patterns, leftmost and not overlapping within a kind."""
    out: list[KindSpan] = []
    if "@" in text:
        out += [(0, *m.span()) for m in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def _emails(text: str) -> Iterator[re.Match]:
    """As ``finditer``, but tried only where a local part ends in @."""
    at = 0
    while (sign := text.find("@", at)) >= 0:
        begin = sign
        while begin > at and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _EMAIL.match(text, begin) if begin < sign else None
        if m:
            yield m
            at = m.end()
        else:
            at = sign + 1


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Regions: stretches of tokens around digits, signs and their spelled-out forms.

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
_DOT = r"(?:\s?(?:\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z0-9-]{1,63})"
_TRIGGER = re.compile(
    r"[0-9](?:[0-9 ().\[\]\-/]{5,})[0-9]"
    r"|(?<!\S)[^\s@]{1,64}\s?@\s?[^\s@]{1,253}"
    rf"|(?<!\S)\S{{1,64}}\s\bat\b\s[A-Za-z0-9-]{{1,63}}{_DOT}+"
    rf"|(?<!\S)\S{{1,64}}\s?(?:\(at\)|\[at\])\s?[A-Za-z0-9-]{{1,63}}(?:{_DOT}|\.[A-Za-z0-9-]{{1,63}})+"
)


@dataclass(frozen=True)
class Region:
    """Tokens of a part of a text, with their places."""

    tokens: tuple[str, ...]
    starts: tuple[int, ...]
    before: str
    after: str


def regions(text: str) -> list[Region]:
    """Parts of ``text`` that may hold an entity: each trigger with the run of signs around it."""
    spelled = "dot" in text or "at)" in text or "at]" in text
    if "@" not in text and not spelled and not _DIGIT.search(text):
        return []
    out, last = [], 0
    for m in _TRIGGER.finditer(text):
        begin, end = m.span()
        while begin > last and text[begin - 1] in "+(":
            begin -= 1
        for at in range(begin, end, 512):
            part = text[at : min(end, at + 512)]
            found = [(t.group(), at + t.start()) for t in _TOKEN.finditer(part)]
            for i in range(0, len(found), MAX_REGION):
                piece = found[i : i + MAX_REGION]
                stop = piece[-1][1] + len(piece[-1][0])
                first = piece[0][1]
                out.append(
                    Region(
                        tuple(t for t, _ in piece),
                        tuple(s for _, s in piece),
                        text[max(0, first - 12) : first].lower(),
                        text[stop : stop + 1],
                    )
                )
        last = end
    return out


def segment_features(region: Region, i: int, j: int) -> list[str]:
    """Features of tokens ``i`` to ``j - 1`` as one entity."""
    tokens = region.tokens[i:j]
    text = "".join(tokens)
    groups = [t for t in tokens if t[0].isdigit() and t.isascii()]
    digits = sum(map(len, groups))
    letters = sum(len(t) for t in tokens if t.isalpha())
    signs = sorted({t for t in tokens if not t.isalnum() and not t.isspace()})
    left = region.tokens[i - 1] if i else (region.before[-1:] or "^")
    right = region.tokens[j] if j < len(region.tokens) else (region.after or "$")
    address = "@" in text or "at" in tokens
    numbers = [
        f"digits={min(digits, 20)}",
        f"groups={min(len(groups), 7)}",
        "shape=" + "-".join(str(min(len(g), 6)) for g in groups[:6]),
        f"letters={min(letters, 3)}",
    ]
    out = [
        *([] if address else numbers),
        "signs=" + "".join(signs)[:6],
        "gap" if any(t.isspace() for t in tokens) else "solid",
        f"first={_class(tokens[0])}",
        f"last={_class(tokens[-1])}",
        f"left={_class(left)}",
        f"right={_class(right)}",
    ]
    if address:
        out.append("at" if "at" in tokens else "@")
        tail = tokens[-1]
        short = tail.isalpha() and 2 <= len(tail) <= 4
        out.append(f"tail={'sign' if tail in ('dot', 'at') else 'short' if short else _class(tail)}")
        out.append(f"dots={min(text.count('.') + tokens.count('dot'), 3)}")
    if digits and not letters:
        if len(groups) == 4:
            out.append(f"octets={all(int(g[-4:]) <= 255 and len(g) <= 3 for g in groups)}")
        if 13 <= digits <= 19:
            out.append(f"luhn={luhn(_digits(text))}")
        out.append(f"plus={text.startswith('+')}")
    for word in ("tel", "phone", "call", "fax", "mail", "card", "visa", "ip", "host", "server"):
        if word in region.before:
            out.append(f"near={word}")
    return out


def _class(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return "0"
    if c.isalpha():
        return "a"
    return "_" if c.isspace() else c


def _admissible(region: Region, i: int, j: int) -> bool:
    """Ends that aren't blanks, and enough digits or a sign of an address."""
    tokens = region.tokens
    if tokens[i].isspace() or tokens[j - 1].isspace():
        return False
    inside = tokens[i:j]
    digits = sum(len(t) for t in inside if t.isdigit())
    address = "@" in inside or ("at" in inside and ("." in inside or "dot" in inside))
    return address or (digits >= 4 and not any(t.isalpha() for t in inside))


def candidates(region: Region, longest: int = MAX_SEGMENT) -> list[tuple[int, int]]:
    n = len(region.tokens)
    return [
        (i, j)
        for i in range(n)
        for j in range(i + 1, min(n, i + longest) + 1)
        if _admissible(region, i, j)
    ]


@dataclass
class SemiCrf:
    """Weights by feature, one for each kind; what is no entity scores 0."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, region: Region) -> dict[tuple[int, int], np.ndarray]:
        zero = np.zeros(len(KINDS))
        return {
            span: sum((self.weights.get(f, zero) for f in segment_features(region, *span)), zero)
            for span in candidates(region)
        }

    def decode(self, region: Region) -> list[tuple[int, int, int, float]]:
        """Best segmentation: (kind, start, end, log odds) of each entity in code points.

        ``best[j]`` is the best score of the first ``j`` tokens: token ``j - 1`` is outside, or a
        segment of any kind and bounded length ends there.
        """
        scores = self.scores(region)
        n = len(region.tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        ends: dict[int, list] = {}
        for (i, j), values in scores.items():
            ends.setdefault(j, []).append((i, int(values.argmax()), float(values.max())))
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], None
            for i, kind, value in ends.get(j, ()):
                if best[i] + value > best[j]:
                    best[j], back[j] = best[i] + value, (i, kind, value)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind, value = back[j]
                stop = region.starts[j - 1] + len(region.tokens[j - 1])
                out.append((kind, region.starts[i], stop, value))
                j = i
        return out[::-1]

    def gradient(self, region: Region, gold: list[tuple[int, int, int]]) -> tuple[dict, float]:
        """Gradient of the log likelihood by forward and backward sums over segmentations."""
        scores = self.scores(region)
        n = len(region.tokens)
        forward = np.full(n + 1, -np.inf)
        backward = np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for (i, j), values in scores.items():
            total = _log_sum(values)
            by_end.setdefault(j, []).append((i, total))
            by_start.setdefault(i, []).append((j, total))
        for j in range(1, n + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[i] + v for i, v in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[j] + v for j, v in by_start.get(i, ()))])
        whole = forward[n]
        out: dict[str, np.ndarray] = {}
        for (i, j), values in scores.items():
            expected = np.exp(forward[i] + values + backward[j] - whole)
            true = np.zeros(len(KINDS))
            for kind, a, b in gold:
                if (a, b) == (i, j):
                    true[kind] = 1.0
            difference = true - expected
            if abs(difference).max() > 1e-4:
                for f in segment_features(region, i, j):
                    out[f] = out.get(f, 0) + difference
        likelihood = sum(float(scores[a, b][k]) for k, a, b in gold if (a, b) in scores) - whole
        return out, float(likelihood)


def _log_sum(values) -> float:
    values = np.asarray(values, float)
    top = values.max()
    return float(top + np.log(np.exp(values - top).sum())) if np.isfinite(top) else -np.inf


def fit(examples: list[tuple[Region, list[tuple[int, int, int]]]], rounds: int = 6) -> SemiCrf:
    """Stochastic gradient with per-feature step sizes; examples in a fixed shuffled order."""
    model, squares = SemiCrf(), {}
    order = list(range(len(examples)))
    for r in range(rounds):
        random.Random(r).shuffle(order)
        for k in order:
            step, _ = model.gradient(*examples[k])
            for f, g in step.items():
                squares[f] = squares.get(f, 1e-2) + g * g
                weight = model.weights.get(f, np.zeros(len(KINDS)))
                model.weights[f] = weight + 0.3 * (g / np.sqrt(squares[f]) - 0.002 * weight)
    return model


def _variants(kind: int, text: str, dice: random.Random) -> list[str]:
    """``text`` and other common forms of the same entity."""
    digits = _digits(text)
    if kind == 0:
        if dice.random() < 0.5:  # addresses of a corpus may all have digits; others don't
            text = re.sub("[0-9]+", "", text).replace(".@", "@")
        local, _, host = text.partition("@")
        return [
            text,
            f"{local} at {host.replace('.', ' dot ')}",
            f"{local} [at] {host.replace('.', ' [dot] ')}",
            f"{local} (at) {host}",
            f"{local} @ {host}",
        ]
    if kind == 1:
        return [text, text.replace(".", " . "), text.replace(".", "[.]")]
    if kind == 2:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [text, ".".join(fours), "/".join(fours), "  ".join(fours)]
    national = digits[-10:]
    a, b, c = national[:3], national[3:6], national[6:]
    return [text, f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10] or 1} {a} {b} {c}"]


_PLAIN = ("{d}", "{y}-{m}-{k}", "{m}/{k}/{y}", "{d}.{d}", "{h}:{m}:{k}", "{n} {n} {n}", "v{k}.{m}.{k}", "no. {n}", "{n}-{n}", "{d}{d}{d}", "{w}@", "@{w}", "{w} at {w} dot {w}")


def _negatives(dice: random.Random) -> str:
    return dice.choice(_PLAIN).format(
        d=dice.randrange(10_000, 10_000_000),
        n=dice.randrange(1, 10_000),
        y=dice.randrange(1900, 2040),
        m=f"{dice.randrange(1, 13):02d}",
        k=f"{dice.randrange(1, 29):02d}",
        h=dice.randrange(0, 24),
        w=dice.choice(("home", "part", "line", "stone")),
    )


def examples_from(texts: list[str], seed: int = 7) -> list[tuple[Region, list[tuple[int, int, int]]]]:
    """Training regions: entities of ``texts`` in several forms, in their own contexts, and plain
    numbers of other kinds in the same contexts."""
    dice = random.Random(seed)
    out = []
    for text in texts:
        for kind, a, b in base_spans(text)[:8]:
            left, right = text[max(0, a - 20) : a], text[b : b + 20]
            forms = _variants(kind, text[a:b], dice)
            for form in [forms[0], *dice.sample(forms[1:], min(2, len(forms) - 1))]:
                out += _labelled(left, form, right, kind)
            other = _negatives(dice)
            out += _labelled(left, other, right, None)
            if kind == 2:  # other digits of the same form: no card number
                wrong = "".join(dice.choice("0123456789") if c.isdigit() else c for c in text[a:b])
                if not luhn(_digits(wrong)):
                    out += _labelled(left, wrong, right, None)
    return out


def _labelled(left: str, form: str, right: str, kind: int | None):
    text, begin = left + form + right, len(left)
    found = []
    for region in regions(text):
        gold = []
        if kind is not None:
            stops = [s + len(t) for s, t in zip(region.starts, region.tokens)]
            if begin in region.starts and begin + len(form) in stops:
                i, j = region.starts.index(begin), stops.index(begin + len(form)) + 1
                if j > i and j - i <= MAX_SEGMENT and _admissible(region, i, j):
                    gold = [(kind, i, j)]
            if not gold and region.starts[0] < begin + len(form) and stops[-1] > begin:
                continue  # the form is cut; it teaches nothing
        found.append((region, gold))
    return found


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> SemiCrf:
    """Model from at most ``sample_rows`` rows with an entity; empty without such rows.

    The sample is the rows of the smallest text hashes among those with an @ or a long number, so
    it doesn't depend on partitions.  Only the surroundings of their entities reach the driver.
    """
    picked = (
        docs.select(F.col(text_col).alias("t"))
        .filter(F.col("t").isNotNull() & F.rlike("t", F.lit(r"@[A-Za-z0-9-]+\.|\d[\d .()-]{8,}\d|\d\.\d+\.\d+\.\d")))
        .select(
            F.xxhash64("t").alias("h"),
            F.array_join(
                F.slice(
                    F.regexp_extract_all(
                        "t", F.lit(r"(?s).{0,24}(?:@[A-Za-z0-9-]+\.|\d[\d .()-]{8,}\d|\d\.\d+\.\d+\.\d).{0,48}"), F.lit(0)
                    ),
                    1,
                    8,
                ),
                "\n",
            ).alias("t"),
        )
        .orderBy("h", "t")
        .limit(sample_rows)
        .collect()
    )
    return fit(examples_from([r["t"] for r in picked]))


def all_spans(text: str, model: SemiCrf) -> tuple[list[KindSpan], list[KindSpan]]:
    """Base spans, and base spans with the field's entities that overlap none of them."""
    base = base_spans(text)
    added = []
    for region in regions(text) if model.weights else []:
        first, stop = region.starts[0], region.starts[-1] + len(region.tokens[-1])
        if any(s <= first and stop <= e for _, s, e in base):
            continue
        for kind, a, b, odds in model.decode(region):
            if odds >= MARGIN and not any(a < e and s < b for _, s, e in base):
                added.append((kind, a, b))
    return base, base + added


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiCrf | None = None
) -> DataFrame:
    """``id_col``, counts of base spans by kind, ``base`` and ``spans`` of every row of ``docs``.

    ``base`` and ``spans`` are kind:start:end, by start and kind, comma-joined, in code points.
    Without ``model`` one is trained on ``docs``.  A null text is empty.
    """
    model = train(docs, text_col) if model is None else model
    counts = [f"n_{kind}" for kind in KINDS]
    schema = docs.select(
        id_col, *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("base"), F.lit("").alias("spans")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: list[list[int]] = [[] for _ in KINDS]
            texts: list[list[str]] = [[], []]
            for value in batch.column("__text"):
                base, spans = all_spans(value.as_py() or "", model)
                for k, column in enumerate(numbers):
                    column.append(sum(kind == k for kind, _, _ in base))
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

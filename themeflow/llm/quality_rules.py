"""Learned decision lists: sequential covering over labelled document statistics.

DataFrame functions only.  A rule is a conjunction of thresholds that rejects a document.  Rules
are grown on two thirds of the labelled documents, one condition at a time by information gain,
pruned on the other third, and kept while they stay precise there.  Each step is one aggregation
over the binned statistics of all labelled documents: only counts by statistic and bin (some
hundred rows) reach the driver.  The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.llm.stats import COUNTS, RATIOS, ratios, with_counts
from themeflow.operators.staging import stage


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` (``above``) or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float
    bin: int = -1

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, a document without one is accepted."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    #: (true, false) rejections of each rule among the documents it was pruned on.
    support: list[tuple[int, int]] = field(default_factory=list)

    def accepted(self) -> Column:
        """True or false, as an ordered conditional expression over ``RATIOS`` and ``COUNTS``."""
        verdict: Column | None = None
        for rule in self.rules:
            holds = _all([c.column() for c in rule])
            verdict = F.when(holds, F.lit(False)) if verdict is None else verdict.when(holds, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def sql(self) -> str:
        """The same expression as text."""
        cases = "".join(
            f" WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in self.rules
        )
        return f"CASE{cases} ELSE true END" if cases else "true"


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``COUNTS`` and ``RATIOS`` of every row; a null text counts as empty."""
    counted = with_counts(docs, text_col, id_col)
    return counted.select(id_col, *COUNTS, *[v.alias(k) for k, v in ratios().items()])


def thresholds(train: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantiles of each statistic over all labelled documents."""
    cuts = [i / bins for i in range(1, bins)]
    row = train.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def learn(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    features: list[str] | None = None,
    bins: int = 64,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_support: int = 5,
) -> DecisionList:
    """Rules that reject documents with label 0, learned from every labelled document.

    ``stats`` has ``id_col`` and ``features`` (default ``RATIOS``).  Null labels and labels of
    unknown documents are left out; of several labels of one document the smallest counts.
    Without documents of both labels the list is empty and accepts everything.
    """
    features = features or RATIOS
    one = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .filter(F.col("__label").isin(0, 1))
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"))
    )
    joined = stage(
        stats.join(one, stats[id_col] == one["__id"]).select("__id", "__label", *features),
        "labelled-statistics",
    )
    cuts = thresholds(joined, features, bins)
    train = stage(
        joined.select(
            (F.col("__label") == 0).cast("int").alias("bad"),
            (F.pmod(F.xxhash64(F.col("__id")), F.lit(3)) == 0).alias("prune"),
            *[
                _bin(F.col(f), cuts[f]).alias(f)
                for f in features
            ],
            F.struct(*features).alias("raw"),
        ),
        "binned-statistics",
    )
    learned = DecisionList()
    left = F.lit(True)
    for _ in range(max_rules):
        rule = _grow(train.filter(left & ~F.col("prune")), features, cuts, max_conditions)
        if not rule:
            break
        rule, good, bad = _pruned(train.filter(left & F.col("prune")), rule)
        if good < min_support or good < min_precision * (good + bad):
            break
        learned.rules.append(_with_margin(train.filter(left), rule))
        learned.support.append((good, bad))
        left = left & ~_all([_binned(c) for c in rule])
    return learned


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of ``cuts`` lie below ``value``: a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > cuts[middle], tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(cuts))


def _binned(c: Condition) -> Column:
    """The condition over bins: values above the cut of number ``bin`` have larger bins."""
    return F.col(c.feature) > c.bin if c.above else F.col(c.feature) <= c.bin


def _grow(
    rows: DataFrame, features: list[str], cuts: dict[str, list[float]], most: int
) -> tuple[Condition, ...]:
    """Conditions in the order in which they were added, each with the largest gain."""
    rule: list[Condition] = []
    while len(rule) < most:
        covered = rows.filter(_all([_binned(c) for c in rule])) if rule else rows
        counted = (
            covered.select(
                "bad",
                F.explode(
                    F.array(
                        *[
                            F.struct(F.lit(i).alias("f"), F.col(f).alias("b"))
                            for i, f in enumerate(features)
                        ]
                    )
                ).alias("x"),
            )
            .groupBy("x.f", "x.b")
            .agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
            .collect()  # statistics times bins at most
        )
        by = {(r["f"], r["b"]): (r["bad"], r["n"] - r["bad"]) for r in counted}
        total_bad = sum(v[0] for (f, _), v in by.items() if f == 0)
        total_good = sum(v[1] for (f, _), v in by.items() if f == 0)
        if not total_bad or not total_good:
            break
        base = math.log2(total_bad / (total_bad + total_good))
        best, gain = None, 1e-9
        for i, f in enumerate(features):
            bad = good = 0
            for b, cut in enumerate(cuts[f]):
                bad += by.get((i, b), (0, 0))[0]
                good += by.get((i, b), (0, 0))[1]
                for above, p, n in ((False, bad, good), (True, total_bad - bad, total_good - good)):
                    if p and (g := p * (math.log2(p / (p + n)) - base)) > gain:
                        best, gain = Condition(f, above, float(cut), b), g
        if best is None:
            break
        rule.append(best)
    return tuple(rule)


def _pruned(
    rows: DataFrame, rule: tuple[Condition, ...]
) -> tuple[tuple[Condition, ...], int, int]:
    """The shortest beginning of ``rule`` that is worth most on ``rows``, and its counts there."""
    sums = []
    for k in range(1, len(rule) + 1):
        holds = _all([_binned(c) for c in rule[:k]])
        sums += [
            F.sum(F.when(holds, F.col("bad")).otherwise(0)).alias(f"bad{k}"),
            F.sum(F.when(holds, 1 - F.col("bad")).otherwise(0)).alias(f"good{k}"),
        ]
    found = rows.agg(*sums).first()
    best, worth = (rule, 0, 0), -2.0
    for k in range(1, len(rule) + 1):
        p, n = found[f"bad{k}"] or 0, found[f"good{k}"] or 0
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth = (rule[:k], p, n), value
    return best


def _with_margin(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """Thresholds halfway between their cut and the nearest bad document that the rule rejects.

    What lies in the gap below the bad documents is accepted: a rule doesn't reach further than
    the labels do.
    """
    holds = _all([_binned(c) for c in rule]) & (F.col("bad") == 1)
    nearest = rows.filter(holds).agg(
        *[
            (F.min if c.above else F.max)(F.col("raw")[c.feature]).alias(f"c{i}")
            for i, c in enumerate(rule)
        ]
    ).first()
    return tuple(
        Condition(c.feature, c.above, (c.threshold + nearest[f"c{i}"]) / 2, c.bin)
        for i, c in enumerate(rule)
    )


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    n = F.col("n_words")
    return (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    **settings,
) -> tuple[DataFrame, DecisionList]:
    """Statistics with ``base_failed`` and ``kept``, one row per row of ``docs``, and the rules.

    The texts are read once: statistics are staged, then learned from and judged.
    """
    stats = stage(statistics(docs, id_col, text_col), "statistics")
    rules = learn(stats, labels, id_col, label_col, **settings)
    return (
        stats.withColumn("base_failed", base_failed()).withColumn(
            "kept", ~F.col("base_failed") & rules.accepted()
        ),
        rules,
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    **settings,
) -> DataFrame:
    """Rows of ``docs`` that neither the base rule nor a learned rule rejects; same columns.

    The rules are learned from narrow statistics; the verdict is then an expression over each
    row's own text.  Texts are read twice and never shuffled, and repeated or null ids don't matter.
    """
    stats = statistics(docs, id_col, text_col)
    rules = learn(stats, labels, id_col, label_col, **settings)
    inner = with_counts(
        docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__text")),
        "__text",
        "__row",
    )
    for name, value in ratios().items():
        inner = inner.withColumn(name, value)
    return inner.filter(~base_failed() & rules.accepted()).select("__row.*")

"""Benchmark decontamination: word windows of test items looked up in a broadcast hash set.

DataFrame functions only.  Test items are cut into windows of ``n`` words (an item of fewer words
is one window of its own length).  Every window of a document is hashed and looked up in the set
of window hashes; hits then carry the words of their window and are verified against the words
of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.llm.text import Shield, let, lower_ascii, row_key, with_results
from themeflow.operators.staging import stage

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` by what it holds: Java takes ten times as long to leave characters out.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The same words before A to Z are lower-cased.
CASED_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
WINDOW = 10
#: The set is broadcast up to this many bytes of windows and items; above, it is shuffled.
BROADCAST_BYTES = 32 << 20


def cased_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CASED_WORD), F.lit(0))


def norm_words(text: Column) -> Column:
    return F.regexp_extract_all(
        lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)
    )


def windows(words: Column, length: Column | int) -> Column:
    """Each run of ``length`` consecutive words; none where there are fewer."""
    length = F.lit(length) if isinstance(length, int) else length
    last = F.size(words) - length
    return F.when(
        (length > 0) & (last >= 0),
        F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i + 1, length)),
    ).otherwise(F.array().cast("array<array<string>>"))


def window_hashes(words: Column, length: int) -> Column:
    """Position and hash of each run of ``length`` words."""
    positions = F.when(
        F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(
        positions,
        lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.slice(words, i + 1, length)).alias("h")
        ),
    )


def benchmark_windows(
    bench: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = WINDOW
) -> DataFrame:
    """``h`` (hash), ``window`` (its words), ``items`` (distinct ids, as strings, of the items)."""
    words = bench.select(
        F.col(item_col).cast("string").alias("item"), norm_words(F.col(text_col)).alias("w")
    )
    single = words.select(
        "item", F.explode(windows(F.col("w"), F.least(F.lit(n), F.size("w")))).alias("window")
    )
    return single.groupBy("window").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64("window").alias("h"), "window", "items"
    )


def find_hits(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    n: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Possible hits by row: ``__id``, ``__hash``, ``__hits`` (array of pos, window, items).

    Only rows with a window whose hash is that of a test window.  A row's hits are at most its
    windows, so a window that a third of the documents hold spreads with those documents.
    """
    found = stage(benchmark_windows(bench, item_col, bench_text_col, n), "test-windows")
    known = found.agg(
        F.coalesce(
            F.sum(
                F.octet_length(F.array_join("window", " "))
                + F.octet_length(F.array_join("items", " "))
                + 64
            ),
            F.lit(0),
        ).alias("bytes"),
        F.collect_set(F.size("window")).alias("lengths"),  # n numbers at most
    ).first()
    lengths = sorted(known["lengths"])
    small = known["bytes"] <= broadcast_bytes

    def hashes(words: Column) -> Column:
        """Hashes of all windows of the lengths in use, each length's windows from position 0."""
        return F.concat(*[window_hashes(words, length) for length in lengths])

    rows = row_key(docs, id_col, text_col).filter(F.col("__text").isNotNull())
    if not lengths:
        empty = F.array().cast("array<struct<pos:int,h:bigint>>")
        scanned = rows.filter(F.lit(False)).select("__id", "__hash", F.explode(empty).alias("x"))
    else:
        scanned = rows.select(
            "__id", "__hash", F.explode(let(norm_words(F.col("__text")), hashes)).alias("x")
        )
    scanned = scanned.select("__id", "__hash", "x.pos", "x.h")
    matches = scanned.join(F.broadcast(found) if small else found, "h")
    return matches.groupBy("__id", "__hash").agg(
        F.collect_set(F.struct("pos", "window", "items")).alias("__hits")
    )


def verified(words: Column, hits: Column) -> Column:
    """Hits whose window's words stand in ``words`` at their position."""
    return F.filter(
        hits, lambda x: F.slice(words, x["pos"] + 1, F.size(x["window"])) == x["window"]
    )


def covered(hits: Column) -> Column:
    """Runs of covered words, as sorted non-overlapping (start, end), end exclusive."""
    spans = F.array_sort(
        F.transform(
            hits,
            lambda x: F.struct(
                x["pos"].alias("start"), (x["pos"] + F.size(x["window"])).alias("end")
            ),
        )
    )
    start = F.struct(
        F.array().cast("array<struct<start:int,end:int>>").alias("done"),
        F.lit(-1).alias("start"),
        F.lit(-1).alias("end"),
    )

    def close(acc: Column) -> Column:
        return F.when(acc["end"] < 0, acc["done"]).otherwise(
            F.concat(
                acc["done"],
                F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))),
            )
        )

    def step(acc: Column, x: Column) -> Column:
        joins = x["start"] <= acc["end"]
        return F.when(
            joins,
            F.struct(
                acc["done"].alias("done"),
                acc["start"].alias("start"),
                F.greatest(acc["end"], x["end"]).alias("end"),
            ),
        ).otherwise(
            F.struct(
                close(acc).alias("done"), x["start"].alias("start"), x["end"].alias("end")
            )
        )

    return F.aggregate(spans, start, step, close)


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and without what stands between two of them."""

    def build(parts: Column) -> Column:
        words, gaps, runs = parts["words"], parts["gaps"], parts["runs"]
        n = F.size(runs)

        def piece(i: Column) -> Column:
            # What stands between run i-1 and run i: from word ``first`` to before ``last``.
            first = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["end"])
            last = F.when(i == n, F.size(words)).otherwise(F.get(runs, i)["start"])
            inner = F.zip_with(
                F.slice(words, first + 1, last - first),
                F.slice(gaps, first + 2, last - first),
                lambda word, gap: F.concat(word, gap),
            )
            # The gap before the first word belongs to the piece that begins the text or
            # follows a run.
            return F.concat(F.get(gaps, first), F.array_join(inner, ""))

        return F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")

    safe = F.coalesce(text, F.lit(""))
    return let(
        F.struct(
            cased_words(safe).alias("words"),
            F.split(safe, CASED_WORD, -1).alias("gaps"),
            spans.alias("runs"),
        ),
        build,
    )


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    n: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each document with what it shares with the test items.

    Adds ``n_words``, ``n_hit`` (words inside a window of a test item), ``hit_spans`` (runs of such
    words), ``items`` (ids, as sorted strings, of items with a window here).  One row for each row
    of ``docs``.  A null or empty text has no words; a null item id names no item, but its windows
    still hit.  Other columns stay; columns called as the added ones are replaced.
    """
    shield = Shield(docs)
    found = _found(
        shield.docs, bench, shield.name(id_col), shield.name(text_col), item_col, bench_text_col, n, broadcast_bytes
    )
    return shield.back(found.withColumns({name: F.col("__found")[name] for name in ADDED}).drop("__found"))


ADDED = ("n_words", "n_hit", "hit_spans", "items")


def _found(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    n: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` and a struct ``__found`` of the added columns."""
    hits = find_hits(docs, bench, id_col, text_col, item_col, bench_text_col, n, broadcast_bytes)
    text = F.col(text_col)
    none = F.array().cast("array<struct<pos:int,window:array<string>,items:array<string>>>")
    real = F.when(F.col("__hits").isNull(), none).otherwise(
        let(norm_words(text), lambda w: verified(w, F.col("__hits")))
    )
    covering = lambda spans: F.aggregate(
        spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]
    )
    return (
        with_results(docs, hits, id_col, text_col, F.octet_length(F.to_json(F.struct("__hits"))) + 64, broadcast_bytes)
        .withColumn("__real", real)
        .withColumn("__spans", covered(F.col("__real")))
        .withColumn(
            "__found",
            F.struct(
                F.coalesce(F.regexp_count(text, F.lit(CASED_WORD)), F.lit(0))
                .cast("long")
                .alias("n_words"),
                covering(F.col("__spans")).alias("n_hit"),
                F.col("__spans").alias("hit_spans"),
                F.array_sort(
                    F.array_distinct(F.flatten(F.transform("__real", lambda x: x["items"])))
                ).alias("items"),
            ),
        )
        .drop("__hits", "__real", "__spans")
    )


def remove_contamination(
    docs: DataFrame, bench: DataFrame, mode: str = "spans", text_col: str = "text", id_col: str = "doc_id", **settings
) -> DataFrame:
    """``docs`` without what it shares with the test items; same columns.

    ``spans`` cuts the shared words out of the texts and drops documents of which no word is
    left; ``documents`` drops every document with a shared word.
    """
    if mode not in ("spans", "documents"):
        raise ValueError(f"unknown mode {mode!r}")
    shield = Shield(docs)
    docs, text_col = shield.docs, shield.name(text_col)
    found = _found(docs, bench, text_col=text_col, id_col=shield.name(id_col), **settings)
    n_words, n_hit = F.col("__found")["n_words"], F.col("__found")["n_hit"]
    if mode == "documents":
        return shield.back(found.filter(n_hit == 0).select(*docs.columns))
    return shield.back(
        found.filter((n_hit == 0) | (n_hit < n_words))
        .withColumn(
            text_col,
            F.when(n_hit == 0, F.col(text_col)).otherwise(
                without_spans(F.col(text_col), F.col("__found")["hit_spans"])
            ),
        )
        .select(*docs.columns)
    )

"""Operators that compare documents, and the pipeline, against brute force."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import ODD, documents, prose
from themeflow.llm import decontaminate, line_dedup, packing, repeats, simhash
from themeflow.llm.components import components
from themeflow.llm.oracles import ORACLES
from themeflow.llm.queries import QUERIES
from themeflow.operators.staging import SHUFFLE_CLEANUP

SF_DIR = "/root/testdata/sf0.001"


# --- packing


def least_padding(histogram, buckets):
    """All choices of boundaries."""
    from itertools import combinations

    lengths = sorted(histogram)
    best = None
    for k in range(1, min(buckets, len(lengths)) + 1):
        for chosen in combinations(lengths[:-1], k - 1):
            bounds = [*chosen, lengths[-1]]
            cost = sum((next(b for b in bounds if b >= n) - n) * c for n, c in histogram.items())
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    dice = random.Random(seed)
    histogram = {n: dice.randrange(1, 50) for n in dice.sample(range(1, 90), 9)}
    for buckets in (1, 2, 3, 5, 20):
        assert packing.plan(histogram, buckets).padding == least_padding(histogram, buckets)
    assert packing.boundaries({}, 3) == []


def test_batches(spark):
    docs = documents(spark, ODD + prose(1, 120, 5, 90), piece="clash", batch=1)
    docs = docs.unionByName(docs.filter("doc_id = 20")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None)))
    found, plan = packing.pack(docs, max_tokens=50, buckets=4, budget=300)
    rows = found.collect()
    expected = []
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1
        expected += [(r.doc_id, k, 50 * k, min(50, n - 50 * k)) for k in range(-(-n // 50))]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.seq_tokens) for r in rows), key=key) == sorted(expected, key=key)
    for r in rows:
        assert r.padded_to == min(b for b in plan.lengths if b >= r.seq_tokens) == plan.lengths[r.bucket]
    for bucket in {r.bucket for r in rows}:
        mine = [r for r in rows if r.bucket == bucket]
        room = 300 // mine[0].padded_to
        places = sorted(r.batch * room + r.slot for r in mine)
        assert places == list(range(len(mine))) and all(r.slot < room for r in mine)
    assert packing.pack(docs.limit(0))[0].count() == 0


# --- line dedup


def test_lines(spark):
    dice = random.Random(2)
    lines = [f"line {i}" for i in range(40)] + ["", "  ", "share this", "  share this\t"]
    texts = ["\n".join(dice.choices(lines, k=12)) for _ in range(60)] + [None, "", "share this"]
    rows = [(i, t, f"s{i % 17}" if i % 5 else None, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, line string")
    for keep_first in (True, False):
        seen = {}
        for i, t, s, _ in rows:
            for x in (t or "").split("\n"):
                if x.strip():
                    seen.setdefault(x.strip(), set()).update({s} - {None})
        spread = {x for x, sites in seen.items() if len(sites) >= 6}
        met, want = set(), {}
        for i, t, _, _ in rows:
            kept = []
            for x in (t or "").split("\n"):
                if x.strip() in spread and not (keep_first and x.strip() not in met):
                    continue
                met.add(x.strip())
                kept.append(x)
            want[i] = None if t is None else "\n".join(kept)
        for limit in (0, line_dedup.BROADCAST_BYTES):
            found = line_dedup.dedup_lines(docs, min_sites=6, keep_first=keep_first, broadcast_bytes=limit)
            assert found.columns == docs.columns
            assert {r.doc_id: r.text for r in found.collect()} == want
    assert spread and len(spread) < len(seen)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_exact_counts_near_the_threshold(spark):
    """Coarse sketches with a wide margin: the exact count decides."""
    rows = [(i, f"x{n}", f"s{i}") for n in range(20, 60) for i in range(n)]
    seen = spark.createDataFrame(rows, "__id long, l string, s string").select(
        "__id", F.xxhash64("l").alias("line"), "l", F.xxhash64("s").alias("site")
    )
    spread = line_dedup.spread_lines(seen.drop("l"), 40, sketch_bits=4, errors=6.0)
    names = seen.select("line", "l").distinct()
    assert {r.l for r in spread.join(names, "line").collect()} == {f"x{n}" for n in range(40, 60)}


# --- near copies


def plain_print(text, shingle):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ODD[:-2] + prose(3, 10):
        assert simhash.fingerprint_of(text) == plain_print(text, 3)
        assert simhash.fingerprint_of(text, 5) == plain_print(text, 5)


def joined(values, distance):
    """Smallest connected position by plain pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("distance, blocks, crowd", [(2, 5, 64), (2, 5, 1), (4, 8, 64), (4, 7, 1)])
def test_links_connect_all_close_pairs(spark, distance, blocks, crowd):
    dice = random.Random(distance)
    values = []
    for _ in range(25):
        v = dice.getrandbits(64)
        for _ in range(4):
            values.append(v)
            for bit in dice.sample(range(64), dice.randrange(1, 4)):
                v ^= 1 << bit
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    prints = spark.createDataFrame(signed, "fingerprint long")
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(prints, distance=distance, blocks=blocks, crowd=crowd).collect()]
    assert all(a != b and (a ^ b).bit_count() <= distance for a, b in pairs)
    found = {(r.node & (2**64 - 1)): r.root for r in components(spark.createDataFrame(
        [(int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))) for a, b in pairs], "a long, b long")).collect()}
    want = joined(values, distance)
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            assert (want[i] == want[j]) == (a == b or (a in found and found.get(a) == found.get(b)))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 60), (60, 61)]
    rows = components(spark.createDataFrame(chain, "a long, b long")).collect()
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 60, 60: 60, 61: 60}
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies(spark):
    long = prose(5, 6, 400, 500)
    texts = ODD[:-2] + long + [long[0] + " end", long[1], long[1], ""]
    docs = documents(spark, texts, fingerprint="clash", component=1)
    docs = docs.unionByName(docs.filter("doc_id = 7")).unionByName(
        docs.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))
    )
    prints = [plain_print(t, 3) for t in texts]
    want = joined(prints, 2)
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == len(texts) + 2
    assert all(r.component == want[r["__id"]] for r in rows if r["__id"] is not None)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    five = joined([plain_print(t, 5) for t in texts], 4)
    wider = simhash.drop_near_copies(docs, shingle=5, distance=4, blocks=8)
    assert sorted(r.doc_id for r in wider.collect()) == sorted(set(five))
    # Texts without an id that are no copies of one another all stay.
    nameless = docs.filter(F.col("doc_id").isin(7, 8, 9)).withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.drop_near_copies(docs.unionByName(nameless)).count() == len(set(want))
    assert simhash.drop_near_copies(nameless).count() == len({want[i] for i in (7, 8, 9)})
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


# --- decontamination

NORM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, items, n):
    w = NORM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, named = set(), set()
    for item, t in items:
        v = NORM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        size = min(n, len(v))
        for k in range(len(v) - size + 1 if v else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == v[k : k + size]:
                    hit |= set(range(p, p + size))
                    named |= {str(item)} - {"None"}
    return len(w), hit, sorted(named)


def test_words_are_matched_by_what_they_hold(spark):
    # Java takes ten times as long for the same class written as what it leaves out.
    assert not any(p.startswith("[^") for p in (decontaminate.WORD, decontaminate.CASED_WORD))
    signs = [chr(c) for c in (*range(1, 0x250), 0x2028, 0x212A, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF)]
    texts = [f"a{x}B" for x in signs] + ["".join(signs), " ".join(signs), "", "\x00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = docs.select("i", decontaminate.norm_words(F.col("text")).alias("low"), decontaminate.cased_words(F.col("text")).alias("cased"))
    for row in found.collect():
        lowered = re.sub("[A-Z]", lambda x: x[0].lower(), texts[row.i])
        assert row.low == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        assert row.cased == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", texts[row.i])


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_hits(spark, limit):
    dice = random.Random(7)
    vocabulary = ["Ab", "c3", "É", "x-y", "don't", "ß", "日本"]
    items = [(i, " ".join(dice.choices(vocabulary, k=dice.randrange(0, 9)))) for i in range(12)]
    items += [(None, "Ab É ß ß"), (99, None), (3, "c3 c3 c3 c3")]
    texts = ODD[:-2] + [" , ".join(dice.choices(vocabulary, k=dice.randrange(0, 60))) for _ in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts, n_hit="clash", items=2)
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, n=4, broadcast_bytes=limit).collect()}
    for i, t in enumerate(texts):
        n, hit, named = plain_hits(t, items, 4)
        assert (rows[i].n_words, rows[i].n_hit, list(rows[i]["items"])) == (n, len(hit), named)
    cut = decontaminate.remove_contamination(docs, bench, n=4, broadcast_bytes=limit)
    assert cut.columns == docs.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    for i, t in enumerate(texts):
        n, hit, _ = plain_hits(t, items, 4)
        if not hit:
            assert left[i] == t
        elif len(hit) == n:
            assert i not in left
        else:
            words = NORM.findall(left[i].lower())
            assert words == [w for k, w in enumerate(NORM.findall(t.lower())) if k not in hit]
    whole = decontaminate.remove_contamination(docs, bench, "documents", n=4, broadcast_bytes=limit)
    assert {r.doc_id for r in whole.collect()} == {i for i, t in enumerate(texts) if not plain_hits(t, items, 4)[1]}


def test_without_test_items(spark):
    docs = documents(spark, ODD[:-2])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contamination(docs, none).count() == len(ODD) - 2
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


# --- repeated strings


def plain_removed(rows, least):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            first[w] = min(first.get(w, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < ((1 << 63) - 1 if i is None else i):
                gone[p : p + least] = b"\1" * least
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i is None, i or 0, len(b), sum(gone), runs, hashlib.sha1(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd, pieces", [(5000, 1 << 18), (1, 64)])
def test_removed_bytes(spark, monkeypatch, crowd, pieces):
    monkeypatch.setattr(repeats, "PIECE", pieces)
    dice = random.Random(11)
    parts = ["".join(dice.choices("abé ", k=dice.randrange(5, 60))) for _ in range(12)]
    texts = ["".join(dice.choices(parts, k=dice.randrange(0, 9))) for _ in range(40)] + ["ab" * 300, "ab" * 40, None, ""]
    rows = [(i if i % 9 else i // 2 * 2, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, texts[5]), (4, texts[4])]
    rows = [(dice.randrange(-5, 40) if i is not None else None, t) for i, t in rows]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, m string")
    for least, gram in ((50, 20), (30, 12)):
        found = repeats.remove_repeats(docs, min_bytes=least, gram=gram, crowd=crowd).collect()
        got = sorted(
            (r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha1(r.kept).hexdigest()) for r in found
        )
        assert got == plain_removed(rows, least)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}


def test_repeats_leave_no_shuffles_of_their_steps(spark):
    """Stretches and intervals are staged; the shuffles behind them don't lie beside those of the last step."""
    passages = prose(5, 30, 150, 200)
    docs = documents(spark, passages + passages)
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    found = repeats.remove_repeats(docs)
    left = sum(n for name, n in shuffle_files(spark).items() if name not in before)
    assert left < 5_000  # counts
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.n_removed == r.n_bytes for r in found.collect()) == [False] * 30 + [True] * 30


def test_representatives_of_many_units_and_arrays(spark, monkeypatch):
    for name, size in (("UNIT", 7), ("FETCHED", 5), ("ARRAY_STRETCHES", 3)):
        monkeypatch.setattr(repeats, name, size)
    dice = random.Random(3)
    parts = ["".join(dice.choices("abé ", k=dice.randrange(5, 60))) for _ in range(12)]
    rows = [(dice.randrange(20), "".join(dice.choices(parts, k=dice.randrange(0, 9)))) for _ in range(25)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(False, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha1(r.kept).hexdigest()) for r in found]
    assert sorted(got) == plain_removed(rows, 50)


def test_texts_of_one_id_and_tag(spark):
    """Their lists are one; pieces beyond a shorter text don't shift those packed after them."""
    long, short = prose(8, 1, 60, 61)[0], "brief"
    schema = "__id long, __text binary, wanted array<struct<m: long, k: long, start: long>>"
    wanted = [(5, 7 | 1 << 48 | 1 << 56, at) for at in (0, 100)]
    rows = spark.createDataFrame([(1, short.encode(), wanted), (1, long.encode(), wanted)], schema).coalesce(1)
    found = rows.mapInArrow(repeats._fetched(50, 1, False, 100), repeats._UNITS).collect()
    parts = [repeats._unpacked(r.blob, repeats._CHOSEN, r.n) for r in found]
    assert [(r.unit, r.n) for r in found] == [(0, 2)]
    assert parts[0][1].tobytes().decode() == long[:50] + long[100:150]


def test_texts_are_shuffled_compressed(spark):
    texts = prose(6, 20, 300, 400)
    squeezed = repeats._squeezed(repeats._keyed(documents(spark, texts + ["", None]), "doc_id", "text")).collect()
    assert sorted(zstandard.ZstdDecompressor().decompress(r["__text"]).decode() for r in squeezed) == sorted([*texts, ""])
    assert sum(len(r["__text"]) for r in squeezed) < 0.7 * sum(map(len, texts))


@pytest.mark.parametrize("flush", [repeats.FLUSH, 40])
def test_groups_have_all_their_occurrences(spark, monkeypatch, flush):
    """Every repeated window has a named group with exactly the window's places, in exact copies too."""
    monkeypatch.setattr(repeats, "FLUSH", flush)
    dice = random.Random(11)
    parts = [bytes(dice.choices(b"abcdefgh ", k=dice.randrange(40, 140))).decode() for _ in range(8)]
    alone = lambda: bytes(dice.choices(b"abcdefgh ", k=90)).decode()
    texts = ["".join(dice.choices(parts, k=dice.randrange(1, 4))) + alone() for _ in range(14)]
    texts += [texts[0], texts[0], texts[3], alone(), alone(), parts[0] + parts[0]]
    docs = documents(spark, texts).repartition(3)
    rows = repeats.repeats(docs).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.repeat, r.length), set()).add((r.id, r.start))
    places, by_string = {}, {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 49):
            places.setdefault(t[at : at + 50], set()).add((i, at))
    for (name, n), found in groups.items():
        strings = {texts[i][at : at + n] for i, at in found}
        assert len(strings) == 1 and n >= 50
        string = strings.pop()
        everywhere = {(i, at) for i, t in enumerate(texts) for at in range(len(t) - n + 1) if t.startswith(string, at)}
        assert found == everywhere
        by_string[string] = found
    assert len(rows) == sum(map(len, groups.values()))
    assert all(r.first_id == min(i for i, _ in groups[r.repeat, r.length]) for r in rows)
    for window, found in places.items():
        if len({i for i, _ in found}) > 1:
            shifted = [{(i, at + s.index(window)) for i, at in where} for s, where in by_string.items() if window in s]
            assert found in shifted


def test_text_ids_are_ordered_as_texts(spark):
    passage = prose(21, 1, 60, 61)[0]
    docs = spark.createDataFrame(
        [("b", passage + " x"), ("a10", passage), ("a9", "short"), (None, passage), ("a10", None)], "doc_id string, text string"
    )
    found = sorted(((r.doc_id or "~", r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs).collect()))
    n = len(passage)
    assert found == [("a10", 0, 0), ("a10", n, 0), ("a9", 5, 0), ("b", n + 2, n), ("~", n, n)]


@pytest.mark.parametrize("seed", range(8))
def test_maximal_repeats(seed):
    """Interval tree against all substrings of small strings."""
    dice = random.Random(seed)
    strings = [bytes(dice.choices(b"ab", k=dice.randrange(4, 12))) for _ in range(6)]
    length = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    item, offset, common, left = repeats.suffix_order(
        np.zeros(6, np.int64), data, np.cumsum(length) - length, length, length
    )
    suffixes = [strings[i][o:] for i, o in zip(item, offset)]
    assert suffixes == sorted(suffixes)
    found = {}
    for a, b, n in repeats.maximal_intervals(common, left, 2):
        found[suffixes[a][:n]] = {(int(item[k]), int(offset[k])) for k in range(a, b)}
    everywhere = {}
    for i, s in enumerate(strings):
        for o in range(len(s)):
            for n in range(2, len(s) - o + 1):
                everywhere.setdefault(s[o : o + n], set()).add((i, o))
    want = {}
    for w, places in everywhere.items():
        before = {strings[i][o - 1] if o else (i, "start") for i, o in places}
        after = {strings[i][o + len(w)] if o + len(w) < len(strings[i]) else (i, "end") for i, o in places}
        alone = any(isinstance(x, tuple) for x in before)
        if len(places) > 1 and (len(before) > 1 or alone) and (len(after) > 1 or any(isinstance(x, tuple) for x in after)):
            want[w] = places
    assert found == want


def test_columns_called_as_internal_ones_stay(spark):
    """Reserved names, also of the id and the text, don't disturb an operator."""
    names = ("__drop", "__hash", "__text_hash", "__found", "__spans", "__hits", "__keep", "__h", "__result_id", "col", "__DROP2")
    lines = "\n".join(f"line {i} of many words" for i in range(12))
    docs = documents(spark, [lines, "one two three\n" + lines, None, *prose(4, 6)], **{n: n for n in names})
    docs = docs.withColumnsRenamed({"doc_id": "__id", "text": "__text"})
    bench = spark.createDataFrame([("i", " ".join(prose(4, 1)[0].split()[:12]))], "item_id string, text string")
    lined = line_dedup.dedup_lines(docs, "__id", "__text", min_sites=2)
    cleaned = decontaminate.remove_contamination(docs, bench, text_col="__text", id_col="__id")
    marked = decontaminate.decontaminate(docs, bench, "__id", "__text")
    kept = simhash.drop_near_copies(docs, "__id", "__text")
    for found in (lined, cleaned, kept, marked.select(*docs.columns)):
        assert found.columns == docs.columns
        rows = found.collect()
        assert len(rows) >= 8 and all(r[n] == n for r in rows for n in names)
    assert sum(r.n_hit > 0 for r in marked.collect()) == 1
    assert {r["__id"]: r["__text"] for r in lined.collect()}[1] == "one two three"


@pytest.mark.parametrize("limit", [-1, 32 << 20])
def test_few_results_are_broadcast_to_their_texts(spark, limit, tmp_path):
    docs = documents(spark, prose(6, 30))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    bench = spark.createDataFrame([("i", " ".join(prose(6, 1)[0].split()[3:15]))], "item_id string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (
            decontaminate.decontaminate(docs, bench, broadcast_bytes=limit),
            line_dedup.dedup_lines(docs, min_sites=2, broadcast_bytes=limit),
        ):
            text = found._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange hashpartitioning" in text) == (limit < 0)
            assert found.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- queries and pipeline

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    picks = [names.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in picks) for r in result.fetchall()), key=repr)


@needs_tables
def test_the_pipeline(spark):
    """Each stage against a plain version on what the stage before has left."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    quality, lines, copies, benchmark, batches = (f for _, f in corpus_pipeline.STAGES)
    first = quality(spark, docs, SF_DIR).collect()
    ids = {r.doc_id for r in first}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    from tests.llm.test_text_operators import plain_counts

    for i in texts:
        n, _, _, _, repeated = plain_counts(texts[i])
        if n < 50 or 2 * repeated > n:
            assert i not in ids
        elif labels.get(i) == 1:
            assert i in ids
    kept = spark.createDataFrame(first, docs.schema)
    second = lines(spark, kept, SF_DIR)
    assert second.columns == columns and second.count() == len(first)
    third = copies(spark, second, SF_DIR)
    after = {r.doc_id: r.text for r in second.collect()}
    order = sorted(after)
    want = joined([plain_print(after[i], 3) for i in order], 2)
    survivors = third.collect()
    assert sorted(r.doc_id for r in survivors) == sorted(order[k] for k in set(want))
    fourth = benchmark(spark, third, SF_DIR)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {r.doc_id: r.text for r in fourth.collect()}
    for r in survivors[:60]:
        n, hit, _ = plain_hits(r.text, items, 10)
        assert (clean.get(r.doc_id) == r.text) == (not hit)
    fifth = batches(spark, fourth, SF_DIR)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for t in clean.values())
    assert fifth.agg(F.sum("seq_tokens")).first()[0] == total
    whole = corpus_pipeline.run(spark, SF_DIR)
    key = lambda r: (r.doc_id, r.piece)
    assert sorted(whole.collect(), key=key) == sorted(fifth.collect(), key=key)

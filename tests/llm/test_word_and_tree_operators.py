"""Spelling variants, language identification and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import ODD, documents, prose
from themeflow.llm import language, manifest, spelling


# --- spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (counts[w], len(near[w]), forms[w], counts.get(forms[w]), root)
    return out


def close_words(seed, letters, n, least=1, most=9):
    dice = random.Random(seed)
    return {
        "".join(dice.choices(letters, k=dice.randrange(least, most))): dice.choice([2, 2, 3, 20, 25, 250, 3000])
        for _ in range(n)
    }


@pytest.mark.parametrize("letters, crowd, bin_rows", [("ab", 4, 40), ("abc", 1024, 16_384), ("aàÀÿ中", 8, 100), ("abcdef", 2, 10)])
def test_variants(spark, letters, crowd, bin_rows):
    counts = close_words(len(letters), letters, 160)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {
        r.word: (r.n, r.n_near, r.form, r.form_n, r.root)
        for r in spelling.variants(df, crowd=crowd, bin_rows=bin_rows).collect()
    }
    assert got == plain_variants(counts)
    assert any(v[4] not in (w, v[2]) for w, v in got.items())  # chains are followed to the end


def test_more_letters_than_columns_and_very_long_words(spark):
    dice = random.Random(5)
    points = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    counts = {}
    for _ in range(60):
        word = "".join(dice.choices(points, k=8))
        at = dice.randrange(8)
        counts |= {word: 40, word[:at] + dice.choice(points) + word[at + 1 :]: 2, word[:at] + word[at + 1 :]: 3}
    long = "xy" * 3000
    counts |= {long: 50, long[:-1]: 2, long[:10] + long[11:]: 4, "z" + long[1:]: 2}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, crowd=16).collect()}
    assert got == plain_variants(counts)


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_words_of_odd_documents(spark):
    texts = [t for t in ODD if t is None or len(t) < 60_000] + ["Straße CAFÉTIÈRES cafétières naïvement×÷ naïvement×÷ "] * 3
    texts += prose(11, 30) + ["abcdefghij" * 9000 + " tail words wordsword wordsword"] * 2
    docs = documents(spark, texts, word="clash", n=1, seed="clash", key=3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = docs.unionByName(docs.filter("doc_id % 5 = 0")).unionByName(docs.limit(12).withColumn("doc_id", F.lit(None)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = plain_words(rows)
    got = {r.word: r.n for r in spelling.group_spellings(docs).collect()}
    assert got == counts and any(len(w) == 90_000 for w in got)
    assert spelling.group_spellings(docs.limit(0)).count() == 0
    plain = {r.word: r.n for r in spelling.counted_words(docs, damage_every=None).collect()}
    assert plain["cafétières"] == 6


def test_the_ratio_must_make_forms_more_frequent(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("word", 2)], "word string, n long"), ratio=1)


# --- language


def plain_grams(word, n):
    if n == 1:
        return list(word)
    marked = f"\x01{word}\x02"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class PlainModel:
    def __init__(self, rows, max_n=5):
        self.languages = sorted({lang for lang, _ in rows})
        counts = Counter()
        for lang, text in rows:
            counts.update((lang, w) for w in language.words_of(text))
        tables = [counts] + [Counter() for _ in range(max_n)]
        for (lang, w), c in counts.items():
            for n in range(1, max_n + 1):
                for g in plain_grams(w, n):
                    tables[n][lang, g] += c
        self.tables = [(t, {k for _, k in t}) for t in tables]
        self.totals = [Counter() for _ in tables]
        for sums, table in zip(self.totals, tables):
            for (lang, _), c in table.items():
                sums[lang] += c

    def log(self, n, key, lang):
        table, keys = self.tables[n]
        total = self.totals[n][lang] + language.SMOOTHING * len(keys)
        return math.log((table[lang, key] + language.SMOOTHING) / total)

    def score(self, text):
        totals = dict.fromkeys(self.languages, 0.0)
        for word in language.words_of(text):
            for lang in self.languages:
                if word in self.tables[0][1]:
                    totals[lang] += self.log(0, word, lang)
                    continue
                for n in range(len(self.tables) - 1, 0, -1):
                    known = [g for g in plain_grams(word, n) if g in self.tables[n][1]]
                    if known:
                        totals[lang] += sum(self.log(n, g, lang) for g in known) / len(known)
                        break
        return totals


def tongues(seed, n):
    dice = random.Random(seed)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    words = {k: ["".join(dice.choices(v, k=dice.randrange(2, 8))) for _ in range(40)] for k, v in letters.items()}
    return [(lang, " ".join(dice.choices(words[lang], k=12)).capitalize()) for lang in dice.choices(list(letters), k=n)]


def test_language_against_plain_model(spark, monkeypatch):
    monkeypatch.setattr(language, "_WORDS", 50)
    rows = tongues(1, 90) + [("aa", "")] + [(None, "abcdef ijkl")] * 6 + [("cc", None)] * 3
    rows += [("bb", "zzz unknown words ß ²"), ("bb", "12 34 ²³"), ("aa", "中文"), ("aa", "abcd" * 30_000)]
    docs = spark.createDataFrame([(i, t, lang, i, "x", 1.0) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, id long, held_out string, spot double")
    docs = docs.unionByName(docs.limit(8).withColumn("doc_id", F.lit(None).cast("long")))
    everything = docs.select("doc_id", "text", "lang").collect()
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 3
    model = PlainModel([(r.lang, r.text) for r in everything if fold(r.doc_id) != 1 and r.lang and r.text is not None])
    want = []
    for r in everything:
        if r.text is None or not any(c.isalpha() for c in r.text):
            want.append((r.doc_id, fold(r.doc_id) == 1, "und", 0.0))
            continue
        totals = model.score(r.text)
        best = max(model.languages, key=lambda x: totals[x])
        share = 1 / sum(math.exp(min(t - totals[best], 700)) for t in totals.values())
        want.append((r.doc_id, fold(r.doc_id) == 1, best, round(share, 6)))
    found, _ = language.predict(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in found.collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_language_of_held_out_texts(spark):
    rows = tongues(2, 300)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    for sample in (language.SAMPLE_CHARS, 3_000):
        found, model = language.predict(docs, sample_chars=sample)
        held = [r for r in found.collect() if r.held_out]
        assert model.languages == ["aa", "bb", "cc"] and len(held) > 60
        assert np.mean([r.lang_pred == rows[r.doc_id][0] for r in held]) > 0.97


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    found, model = language.predict(docs)
    assert [(r.lang_pred, r.score) for r in found.collect()] == [("und", 0.0)] * 2 and model.languages == []
    assert language.predict(docs.limit(0))[0].count() == 0


def test_the_sample_does_not_depend_on_the_layout(spark):
    rows = tongues(3, 200)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    results = [sorted(language.predict(docs.repartition(n), sample_chars=4_000)[0].collect()) for n in (1, 7)]
    for one, other in zip(*results):
        assert one[:3] == other[:3] and abs(one[3] - other[3]) < 1e-9


# --- manifest


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def plain_leaf(values):
    framed = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return h(*framed)


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def plain_fold(levels, at, digest, fanout):
    siblings = []
    for level in levels[:-1]:
        first = at - at % fanout
        run = level[first : first + fanout]
        siblings += run[: at - first] + run[at - first + 1 :]
        run[at - first] = digest
        digest, at = h(*run), at // fanout
    return digest, siblings


def plain_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in order:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = plain_tree([x[2] for x in groups[name]], fanout)
    top = plain_tree([trees[name][-1][0] for name in order], fanout)
    out = []
    for k, name in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(groups[name]):
            changed = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                changed = plain_leaf([*r[:3], r[3] + 1, r[4]])
            digest, siblings = plain_fold(trees[name], at, changed, fanout)
            folded, more = plain_fold(top, k, digest, fanout)
            proof = siblings + more
            out.append((r[0], leaf, trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def manifest_rows(seed, n, languages):
    dice = random.Random(seed)
    rows = [
        (dice.choice([i, i, i, None]), dice.choice(["s", "", None, "ü:1"]), dice.choice(languages), dice.choice([None, 5, 2**63 - 1]),
         dice.choice([None, "", "text", "ß中", "x" * 9000]))
        for i in range(n)
    ]
    return rows + rows[:5]


@pytest.mark.parametrize(
    "n, languages, height, fanout",
    [(70, ["en", "é", "z", None], 2, 2), (40, ["en"], 1, 3), (90, ["a", "b"], 11, 2), (3, ["a", "b", "c", "d", "e"], 1, 2), (1, [None], 4, 2), (65, [str(i) for i in range(40)], 1, 4)],
)
def test_manifest(spark, n, languages, height, fanout):
    rows = manifest_rows(n, n, languages)
    if n == 1:
        rows = rows[:1]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({"pos": F.lit(1), "grp": F.lit("x"), "digest": F.lit("y"), "page": F.lit(2), "id": F.lit(3)})
    found = manifest.verified(df, height=height, fanout=fanout).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, list(r.proof), r.folded_root, r.verified) for r in found]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(plain_manifest(rows, fanout), key=key)


def test_manifest_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest.verified(df)
    assert found.count() == 0 and "folded_root" in found.columns


def test_retained_states_are_those_of_the_standard_library():
    dice = np.random.default_rng(1)
    for children in (1, 2, 3, 5):
        raw = dice.integers(0, 256, (children, 32), np.uint8)
        words = np.ascontiguousarray(raw).view(">u4").astype(np.uint32).T
        levels, top = manifest.grow(words, False, 1, 5)
        assert manifest._as_bytes(top).tobytes() == hashlib.sha256("".join(r.tobytes().hex() for r in raw).encode()).digest()
        state = manifest._START[:, None]
        for slot in range(children):
            assert (levels[0].states[slot] == state).all()
            state = manifest._taken(state, words[:, slot : slot + 1])


def test_folding_resumes_states_and_reads_right_siblings_only():
    """Left siblings may be anything once the states are there."""
    dice = np.random.default_rng(2)
    leaves = dice.integers(0, 2**32, (8, 9), np.uint32)
    levels, top = manifest.grow(leaves, True, 9, 3)
    at = np.array([5])
    blind = [manifest.Level(x.children.copy(), x.states) for x in levels]
    place = 5
    for level in blind:
        level.children[:, place - place % 3 : place + 1] = 0
        place //= 3
    digest = leaves[:, 5:6]
    for level in blind:
        digest = manifest._fold_level(level, at, digest, 3)
        at = at // 3
    assert (digest == top).all()

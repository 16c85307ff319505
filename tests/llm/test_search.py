"""Ranked search, spelling variants and language profiles against brute force and held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ontide.llm import language_profiles, lexical_search, spelling_variants
from ontide.llm.common import table
from ontide.llm.decontaminate import item_words
from ontide.llm.queries import QUERIES

LINE = "Somewhat plain words stand here in a row and end with a stop. "
ROWS = [
    (1, LINE * 12),
    (2, LINE * 12),
    (2, LINE * 12),
    (3, None),
    (4, ""),
    (None, LINE * 3),
    (None, None),
    (5, "one"),
    (6, "x" * 200_000),
    (7, "word " * 60_000),
    (8, " \t\n\x0b\x0c\r"),
    (9, "12345 67890 !?"),
    (10, "é日本 ﬁ Ω" * 50),
]
CLASH = ", lang string, rank int, score double, norm double, word string, n int, key int, block int"


def frame(spark, rows):
    full = [(*row, "xx", 1, 2.0, 3.0, "clash", 4, 5, 6) for row in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string" + CLASH)


# --- Ranked search


def brute_ranking(docs, items, k):
    """item id -> [(doc id, score)]; ids may be null or repeated."""
    bags = [(d, Counter(item_words(t.encode()))) for d, t in docs if t and item_words(t.encode())]
    df = Counter(w for _, bag in bags for w in bag)
    n, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(item_words((text or "").encode()))
    out = {}
    for item, terms in asked.items():
        found = []
        for doc, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n) // total
            score = 0
            for w in terms & bag.keys():
                heavy = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                score += heavy * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc, doc))
        out[item] = [(f[3], -f[0]) for f in sorted(found, key=lambda f: f[:3])[:k]]
    return {item: rows for item, rows in out.items() if rows}


def ranking(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda r: (str(r["item_id"]), r["rank"])):
        out[row["item_id"]].append((row["doc_id"], row["score"]))
        assert row["rank"] == len(out[row["item_id"]])
    return dict(out)


@pytest.mark.parametrize("bucket, block_terms", [(2048, 200_000), (16, 60), (3, 1)])
def test_ranking_matches_brute_force(spark, bucket, block_terms):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]

    def text(least, most):
        return " ".join(rng.choices(words, weights, k=rng.randint(least, most)))

    docs = [(i, text(0, 90)) for i in range(300)] + [(300 + i, "w3 W9 w77 w110") for i in range(40)]
    docs += [(7, "w5 w6"), (7, "w5 w6"), (None, "w5 w6"), (900, None), (901, "!?")]
    rng.shuffle(docs)
    items = [(i, text(1, 25)) for i in range(20)] + [(50, "w110 w77"), (51, "nowhere"), (52, None), (0, "w99 w5")]
    items += [(None, "w6 w5"), (53, " ".join(words))]
    params = lexical_search.SearchParams(bucket=bucket, block_terms=block_terms)
    docs_frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = lexical_search.ranked_documents(
        docs_frame, spark.createDataFrame(items, "item_id bigint, text string"), params
    )
    assert ranking(rows.collect()) == brute_ranking(docs, items, params.k)


def test_ranking_edges(spark):
    docs = frame(spark, ROWS)
    items = docs.withColumnRenamed("doc_id", "item_id")
    found = ranking(lexical_search.ranked_documents(docs, items).collect())
    # the text of rows 1 and 2 is in three rows, whose ids come in order; its terms are in the null row too
    assert found == brute_ranking(ROWS, ROWS, 10)
    assert lexical_search.ranked_documents(docs, items.limit(0)).collect() == []
    assert lexical_search.ranked_documents(docs.limit(0), items).collect() == []


def test_bounds_pass_over_buckets():
    """Bounds reach every true score, and both kinds leave rows out."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 12, 400)
    terms = np.concatenate([rng.choice(40, n, replace=False) for n in lengths])
    values = rng.integers(1, 1_000_000, len(terms))
    query = lexical_search.Query(1, [(t, int(w)) for t, w in enumerate(rng.integers(1, 9000, 40))][::3])
    bucket = lexical_search.Bucket(list(range(400)), terms, values, lengths, 40)
    every = np.arange(400)
    scores = bucket.scores(query, every, np.zeros(40, np.int64))
    owner = np.repeat(every, lengths)
    weights = np.zeros(40, np.int64)
    weights[query.terms] = query.weights
    assert (scores == np.bincount(owner, weights[terms] * values, 400).astype(np.int64)).all()
    assert scores.max() <= query.norm * bucket.longest
    floor = int(np.sort(scores)[-10])
    kept = bucket.survivors(query, floor, 0.3)
    assert set(np.flatnonzero(scores >= floor)) <= set(kept) and len(kept) < 200


# --- Spelling variants


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(counts, ratio=5):
    forms, out = {}, {}
    for word, n in counts.items():
        near = [v for v in counts if v != word and one_edit(word, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[word] = best if best and counts[best] >= ratio * n else None
        out[word] = (forms[word], n, len(near), counts.get(forms[word]))
    for word in counts:
        root = word
        while forms[root]:
            root = forms[root]
        out[word] = (*out[word], root)
    return out


@pytest.mark.parametrize("block_letters", [1 << 19, 400, 40])
def test_groups_match_brute_force(spark, block_letters):
    rng = random.Random(22)
    counts = {}
    while len(counts) < 500:
        word = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        counts[word] = rng.choice([5, 6, 30, 31, 200, 1000])
    # a hot beginning, a chain of forms, and long words
    for i in range(120):
        counts["prefix" + "".join(rng.choice("xyz") for _ in range(4))] = rng.randint(5, 400)
    counts |= {"wordswords": 5, "wordswordz": 25, "wordsworzz": 125, "wordswozzz": 625}
    counts |= {"l" * 300: 50, "l" * 301: 9, "l" * 299 + "m": 5, "m" + "l" * 299: 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    params = spelling_variants.SpellingParams(block_letters=block_letters)
    rows = spelling_variants.spelling_groups(words, params).collect()
    found = {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in rows}
    assert found == brute_groups(counts) and len(rows) == len(counts)
    assert found["wordswords"][-1] == "wordswozzz"


def test_word_counts_match_plain_counts(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    docs += [(None, "Édition édition ÉDITION " * 20), (7, "ABCDEF÷× " * 6), (7, "ABCDEF÷× ")]
    wanted = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc_id, text in docs:
        for run in spelling_variants.RUN.findall(text):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            wanted[run] += 1
    wanted = {w: n for w, n in wanted.items() if len(w) >= 6 and n >= 5}
    params = spelling_variants.SpellingParams(flush_words=50)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = spelling_variants.count_words(frame, params, slip_one_in=199).collect()
    assert {r["word"]: r["n"] for r in rows} == wanted


def test_spelling_edges(spark):
    def groups(docs):
        return spelling_variants.spelling_groups(spelling_variants.count_words(docs)).collect()

    rows = {r["word"]: r["n"] for r in groups(frame(spark, ROWS))}
    assert rows == {"somewhat": 39}
    assert groups(frame(spark, [])) == [] and groups(frame(spark, [(1, None), (None, None)])) == []
    long = "x" * 10_000
    rows = {r["word"]: r for r in groups(frame(spark, [(1, f"{long} {long}x " * 5)]))}
    assert {r["n_near"] for r in rows.values()} == {1} and len(rows) == 2


# --- Language profiles


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for word in words:
        padded = f" {word} "
        counts.update(word)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    # neighbours share their blank, so no n-gram spans it
    return counts


def brute_languages(rows, size):
    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2

    def top(counts):
        order = sorted(counts, key=lambda g: (-counts[g], code(g)))
        return {g: i for i, g in enumerate(order[:size])}

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | ord(c)
        return out

    learned = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and not held(doc_id):
            learned[lang] += brute_grams(text)
    profiles = {lang: top(counts) for lang, counts in learned.items() if counts}
    out = []
    for doc_id, text, _ in rows:
        own, best = top(brute_grams(text or "")), ("und", 0.0)
        if own and profiles:
            def far(lang):
                known = profiles[lang]
                return sum(abs(known[g] - i) if g in known else size for g, i in own.items())

            lang = min(sorted(profiles), key=far)
            best = (lang, 1 - far(lang) / (size * len(own)))
        out.append((str(doc_id), held(doc_id), *best))
    return sorted(out)


@pytest.mark.parametrize("block_languages, size", [(500, 300), (1, 40)])
def test_languages_match_brute_force(spark, small, block_languages, size):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, small, "documents").collect()]
    rows += [(None, "ÀÉ straße ﬁ 日本語 !", "xx"), (1000, None, "en"), (1001, "12 34", "en"), (1002, "", None)]
    rows += [(1003, "ab", None), (1004, "ŀ" * 30, "yy"), (1004, "ŀ" * 30, "yy"), (1005, "àb İx", "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    params = language_profiles.ProfileParams(size=size, block_languages=block_languages, flush=1000)
    found = language_profiles.identify_languages(docs, params).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], r["score"]) for r in found)
    assert got == brute_languages(rows, size)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    letters = language_profiles.letter_table()
    rng = random.Random(23)
    text = "".join(rng.choice("ab é1") for _ in range(5000))
    whole = language_profiles.gram_counts(text, letters)
    monkeypatch.setattr(language_profiles, "PIECE", 7)
    for a, b in zip(whole, language_profiles.gram_counts(text, letters)):
        assert (a == b).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in table(spark, folder, "documents").collect()}
    rows = [r for r in QUERIES["op13_language_profiles"](spark, folder).collect() if r["held_out"]]
    assert len(rows) > 200
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.99 * len(rows)


def test_language_edges(spark):
    rows = language_profiles.identify_languages(frame(spark, ROWS)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    found = {r["doc_id"]: r for r in rows}
    assert {i: found[i]["lang_pred"] for i in (3, 4, 8, 9, 1)} == {3: "und", 4: "und", 8: "und", 9: "und", 1: "xx"}
    assert found[3]["score"] == 0 and 0 <= found[1]["score"] <= 1
    assert language_profiles.identify_languages(frame(spark, [])).collect() == []
    bare = frame(spark, [(1, "text"), (3, "text")]).withColumn("lang", language_profiles.F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language_profiles.identify_languages(bare).collect()} == {("und", 0.0)}

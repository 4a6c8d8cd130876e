"""Benchmark passages against a plain search, on given documents and awkward tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave.llm import leaks

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        ids = sorted(str(k) for k in found if k is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    left = spark.createDataFrame(docs, DOC).withColumns({c: F.lit("clash") for c in ("id", "uid", "words", "at", "token", "win", "wid", "n")})
    right = spark.createDataFrame(items, ITEM).withColumns({c: F.lit("clash") for c in ("item", "words", "start", "n")})
    return sorted((tuple(r) for r in leaks.contamination(left, right, **options).collect()), key=str)


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "One-two, THREE"), (3, "x x x x x x x x x x x x"),
    (4, None), (5, "..."), (6, "Ünder É é"), (None, "no id of mine"), (7, "single"), (2, "one two three"),
]


@pytest.mark.parametrize("broadcast", [leaks.BROADCAST, 0])
def test_awkward_tables(spark, broadcast):
    docs = [
        (1, "say: ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda! mu"), (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (3, "x " * 25), (4, None), (5, ""), (6, "one two three one two three"),
        (7, "onetwo three"), (None, "a single word"), (None, "a single word"), (8, "no id of mine"), (9, "ünder é É"), (9, "ünder É é"), (10, "Ünder É é"), (11, "\x7f\x00single{two"), (12, "alpha beta gamma delta epsilon zeta eta theta iota"),
        (1, "say: ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda! mu"), (13, "İstanbul K single ſ"), (14, "y " * 3000 + "one two three " + "x " * 3000),
    ]
    assert run(spark, docs, ITEMS, broadcast=broadcast) == plain(docs, ITEMS)


@pytest.mark.parametrize("broadcast", [leaks.BROADCAST, 0])
def test_random_texts(spark, broadcast):
    """Few different words, so that shingles repeat, windows overlap and prefixes are shared."""
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 14])))) for k in range(12)]
    items += [(50, items[0][1])]
    docs = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))) for k in range(60)]
    docs += [(100 + k, " ".join(rng.choice("abcd") for _ in range(20)) + " " + items[k][1] + " d") for k in range(12)]
    assert run(spark, docs, items, broadcast=broadcast) == plain(docs, items)
    assert run(spark, docs, items, broadcast=broadcast, window=4, shingle=2) == plain(docs, items, 4)


def test_no_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, 0, empty, False), (2, 0, 0, 0, empty, False)]
    assert run(spark, [(1, "a b")], [(1, None), (2, "!")]) == [(1, 2, 0, 0, empty, False)]
    assert run(spark, [], ITEMS) == []


def test_prefix_is_the_rarest_shingle(spark):
    docs = spark.createDataFrame([(k, "the same old words again and again " * 3) for k in range(5)] + [(9, "the same old rare thing with words again and again")], DOC)
    items = spark.createDataFrame([(1, "the same old rare thing with words again and again")], ITEM)
    rows = docs.select("doc_id", leaks.words_of(F.col("text")).alias("words"))
    prefixes, widths, few = leaks._prefixes(rows, leaks.benchmark_windows(items), 3, 100)
    assert widths == [3] and few and [r["offset"] in range(1, 5) for r in prefixes.collect()] == [True]

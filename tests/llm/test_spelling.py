"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolewatch.llm import queries, spelling

ROWS = "doc_id long, text string"


def variants(word, letters):
    """All strings one edit away."""
    out = set()
    for n in range(len(word) + 1):
        out |= {word[:n] + c + word[n:] for c in letters}
        if n < len(word):
            out |= {word[:n] + word[n + 1 :]} | {word[:n] + c + word[n + 1 :] for c in letters}
    return out - {word}


def brute(rows, one_in=31, least=7):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    known = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    letters = {c for w in known for c in w}
    near = {w: [v for v in variants(w, letters) if v in known] for w in known}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= 10 * known[w] else None
    out = {}
    for w in known:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, known[w], len(near[w]), known[form[w]] if form[w] else None)
    return out


def rows_of(found):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(13)
    stems = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(7, 16))) for _ in range(40)] + ["aaaaaaaa", "a" * 300, "abababab", "straße" * 2]
    words = []
    for n, stem in enumerate(stems):
        words += [stem.capitalize() if n % 3 else stem] * rnd.choice([2, 5, 30, 400])
        for _ in range(12):
            v = rnd.choice(sorted(variants(stem, "abcé")))
            words += [v] * rnd.choice([1, 2, 3, 30])
    rnd.shuffle(words)
    out = [" ".join(words[n : n + 50]) for n in range(0, len(words), 50)]
    return out + [None, "", "12 !!", "×÷×÷×÷×÷ ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ", "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999]


@pytest.mark.parametrize("crowd", [spelling.CROWD, 1, 4])
def test_variants_equal_brute_force(spark, texts, crowd):
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0]), (0, texts[0])]
    table = spark.createDataFrame(rows, ROWS).withColumns({"word": F.lit("clash"), "n": F.lit(1), "_id": F.lit(2)})
    found = spelling.group_variants(table, one_in=31, crowd=crowd)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(found) == brute(rows)


def test_pairs_of_short_alphabets_with_crowded_chunks(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(7, 9))) for _ in range(500)})
    pairs = {(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), crowd=3).collect()}
    want = {tuple(sorted((w, v))) for w in words for v in variants(w, "ab") if v in set(words)}
    assert {tuple(sorted(p)) for p in pairs} == want and len(pairs) == len(want)


def test_undamaged_words_and_nothing(spark, texts):
    rows = list(enumerate(texts))
    assert rows_of(spelling.group_variants(spark.createDataFrame(rows, ROWS))) == brute(rows, one_in=None)
    assert spelling.group_variants(spark.createDataFrame([], ROWS)).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, "short words only"), (2, None)], ROWS)).count() == 0


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{n}", f"w{n + 1}" if n < 9 else None) for n in range(10)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(chain).collect()} == {f"w{n}": "w9" for n in range(9)}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(queries.op13_spelling(spark, "/root/testdata/sf0.001")) == brute(rows)

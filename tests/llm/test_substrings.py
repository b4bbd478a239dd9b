"""Removal of repeated passages against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rolewatch.llm import queries, substrings

ROWS = "doc_id long, text string"


def brute(docs, size):
    """``docs``: distinct (place, text); per place the number of words, of removed ones, and the words kept."""
    first, found = {}, {}
    for place, text in sorted(docs, key=lambda d: d[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for n in range(len(words) - size + 1):
            if first.setdefault(tuple(words[n : n + size]), (place, n)) != (place, n):
                gone[n : n + size] = [True] * size
        kept = b" ".join(w for w, x in zip(words, gone) if not x).decode()
        found[place] = (len(words), sum(gone), kept)
    return found


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["a", "be", "sea", "Sea", "tree", "é", "stone,"]) + rnd.choice("xyz")
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 60, 200)]
    out = []
    for n in range(150):
        words = [word() for _ in range(rnd.randint(0, 80))]
        if n % 3 == 0:
            words[5:5] = rnd.choice(passages)
        if n % 7 == 0:
            words += words
        out.append(rnd.choice([" ", "\n", "\t "]).join(words))
    return out + [None, "", " \n", "z " * 3000, "no break" * 2000, out[0], out[3].replace(" ", "\n"), "ab " * 19 + "ab"]


@pytest.mark.parametrize("load", [substrings.LOAD_BYTES, 2_000])
def test_removal_equals_brute_force(spark, texts, load):
    rows = spark.createDataFrame(list(enumerate(texts)), ROWS).withColumns({"kept": F.lit("old"), "_id": F.lit(5), "id": F.lit(6), "start": F.lit(7)})
    found = substrings.remove_repeats(rows.repartition(5), load_bytes=load)
    assert found.columns == ["doc_id", "text", "_id", "id", "start", "n_words", "n_removed", "kept"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found.collect()}
    assert got == brute(list(enumerate(texts)), 20)


def test_removal_with_repeated_rows_null_ids_and_one_id(spark):
    base = [f"w{n}" for n in range(60)]
    text, other = " ".join(base), " ".join(["new", *base[10:40], "end"])
    rows = [(None, text), (3, text), (3, text), (3, other), (1, other), (2, None), (None, None)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, ROWS)).collect()
    place = {(r.id, r.text): (r.id, r.mark) for r in spark.createDataFrame(rows, ROWS).select(F.coalesce("doc_id", F.lit(substrings.LAST_ID)).alias("id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).collect()}
    want = brute({(p, t) for (_, t), p in place.items()}, 20)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_removed, r.kept) == want[place[(substrings.LAST_ID if r.doc_id is None else r.doc_id, r.text)]]


def test_collisions_of_hashes_are_settled_by_words(spark, texts, monkeypatch):
    monkeypatch.setattr(substrings, "mixed", lambda values: values & substrings.np.uint64(3))
    parts = [(n, 0, (t or "").encode().split()) for n, t in enumerate(texts[:40])]
    contents = [substrings.pa.decompress(p, size, codec="zstd", asbytes=True) for _, size, p in substrings.packed_rows(parts, 1, substrings.np.zeros(1 << 18, int), 20)]
    load = substrings.Load(contents, 20)
    known = {}
    assert [known.setdefault(load.window(n), n) for n in range(len(load.hash))] == load.firsts().tolist()


def test_super_kmers_cover_all_windows_once():
    words = [b"%d" % (n * n % 17) for n in range(900)] + [b"same"] * 700
    least, first, count = substrings.super_kmers(words, 20)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(words) - 19
    assert count.max() <= substrings.MOST_WINDOWS and len(least) == len(first)
    assert [len(x) for x in substrings.super_kmers(words[:19], 20)] == [0, 0, 0]


def test_removal_of_nothing(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], ROWS)).count() == 0
    assert [tuple(r) for r in substrings.remove_repeats(spark.createDataFrame([(1, None)], ROWS)).collect()] == [(1, None, 0, 0, "")]


def test_query_digests_what_is_kept(spark):
    found = queries.op11_substrings(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in brute(docs, 20).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == want

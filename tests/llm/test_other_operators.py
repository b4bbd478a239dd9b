"""Mixing, vector searches, URL filters, and the pipeline against brute force."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolewatch.llm import ann, mixing, shards, topk, url_filters


def water_fill(sizes, weights, most=3):
    """Targets by repeated sharing, as the rule is worded."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[n] for n in capped)
        weight = sum(w for n, w in enumerate(weights) if n not in capped)
        for n, w in enumerate(weights):
            target[n] = most * sizes[n] if n in capped else left * w / weight
        over = {n for n in range(len(sizes)) if n not in capped and target[n] > most * sizes[n]}
        if not over:
            return target
        capped |= over


@pytest.fixture(scope="module")
def mixed_rows():
    rnd = random.Random(4)
    share = {"hot": 900, "b": 200, "c": 60, "d": 8, None: 40, "é": 30, "Z": 3}
    out, n = [], 0
    for source, count in share.items():
        for _ in range(count):
            out.append((n, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), source))
            n += 1
    return out + [(n, None, "b"), (n + 1, "", "c"), (5, out[5][1], "hot"), (5, out[5][1], "hot")]


def test_mixing_meets_targets(spark, mixed_rows):
    rows = spark.createDataFrame(mixed_rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "extra": F.lit(1)})
    found = mixing.mix(rows).collect()
    assert len(found) == len(mixed_rows) and found[0].extra == 1
    again = mixing.mix(rows.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    size, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in found:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and r.source_size >= r.size
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill([size[s] for s in order], [n % 3 + 1 for n in range(len(order))])
    assert np.allclose([target[s] for s in order], want)
    assert all(abs(taken[s] - target[s]) <= 900 for s in order)
    assert sum(size.values()) - max(longest.values()) <= sum(taken.values()) <= sum(size.values())


def test_mix_is_the_prefix_of_finish_times(spark, mixed_rows):
    rows = spark.createDataFrame(mixed_rows[:-2], "doc_id long, text string, source string")
    facts = mixing.mix(rows).select("doc_id", "size", "source_size", "target", "copies", "finish").collect()
    turns = sorted((r.finish + k * r.source_size / r.target, r.doc_id, k, r.size) for r in facts if r.size for k in range(3))
    budget, upto, copies = sum(r.size for r in facts), 0, defaultdict(int)
    for _, doc, _, size in turns:
        upto += size
        if upto > budget:
            break
        copies[doc] += 1
    assert {r.doc_id: r.copies for r in facts if r.size} == {r.doc_id: copies[r.doc_id] for r in facts if r.size}
    assert [r.finish for r in mixing.mixed(rows).collect()] == sorted(r.finish for r in mixing.mixed(rows).collect())
    assert mixing.repeated(rows).count() == sum(r.copies for r in facts)


def test_mixing_of_nothing(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).collect() == []
    found = mixing.mix(spark.createDataFrame([(1, None, "a"), (None, "", None)], kind)).collect()
    assert sorted((r.size, r.taken) for r in found) == [(0, 0), (0, 0)]


@pytest.fixture(scope="module")
def points():
    rnd = np.random.default_rng(6)
    out = [(n, rnd.normal(size=12).astype(np.float32).tolist()) for n in range(900)]
    out += [(n, out[20][1]) for n in range(900, 1300)]  # a third are copies of a query
    return out + [(1301, None), (1302, []), (1303, [0.0] * 12), (1304, [float("nan")] + [0.0] * 11), (1305, [float("inf")] * 12), (1306, [None] * 12), (20, out[20][1]), (1320, [1.0, 2.0]), (1340, [3.0, 1.0])]


def brute(points, step, k, measure):
    kept = {}
    for i, v in points:
        if v and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, v), v)
    out = []
    for q in sorted(kept):
        if q % step == 0:
            ranked = sorted((-measure(kept[q], v), i) for i, v in kept.items() if i != q and len(v) == len(kept[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return out


def integers(a, b):
    return sum(int(np.floor(256 * float(x))) * int(np.floor(256 * float(y))) for x, y in zip(a, b, strict=True))


def test_exact_top_equals_brute_force(spark, points):
    rows = spark.createDataFrame(points, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = topk.exact_top(rows, F.col("_id") % 20 == 0, 5, shard_rows=200)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(points, 20, 5, integers))


def test_exact_top_of_large_components(spark):
    given = [(n, [float(1 << 21) * (n + 1), -3.0]) for n in range(6)]
    rows = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    found = topk.exact_top(rows, F.col("_id") == 0, 2)
    assert sorted(tuple(r) for r in found.collect()) == [x for x in brute(given, 50, 2, integers) if x[0] == 0]


def test_nearest_reaches_recall_and_exact_scores(spark, points):
    rows = spark.createDataFrame(points, "vec_id long, embedding array<float>")
    dot = lambda a, b: float(np.dot(np.array(a, float), np.array(b, float)))
    usable = [p for p in points if p[1] and any(p[1])]
    want = brute(usable, 20, 20, dot)
    found = [tuple(r) for r in ann.nearest(rows, F.col("_id") % 20 == 0, 20, shard_rows=300).collect()]
    assert len(found) == len(want)
    hits = {(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)
    vectors = dict(usable)
    assert all(abs(s - dot(vectors[q], vectors[i])) < 1e-9 for q, _, i, s in found)
    assert [x[:3] for x in sorted(found) if x[0] == 20][:5] == [(20, n + 1, 900 + n) for n in range(5)]  # ties to the smaller id


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top(empty, F.col("_id") % 50 == 0, 5).collect() == []
    assert ann.nearest(empty, F.col("_id") % 20 == 0, 20).collect() == []


def test_stopping_rule_and_leaves():
    law = ann.chi_square(np.array([0.0, 15.507, 1e9]), 8)
    assert np.allclose(law, [0.0, 0.95, 1.0], atol=1e-3)
    same = np.zeros((1000, 3))
    order, starts = shards.kd_leaves(same, 64)
    assert sorted(order) == list(range(1000)) and np.diff(starts).max() <= 64


def brute_judge(captures, entries):
    days = {}
    for name, since, listed in entries:
        if name and since:
            days[name, since] = days.get((name, since), False) or listed
    out = []
    for i, host, on in captures:
        labels = host.split(".") if host and on else []
        names = [".".join(labels[n:]) for n in range(max(1, len(labels) - 1))] if labels else []
        best = (False, None, None)
        for name in names:
            past = [s for n, s in days if n == name and s <= on]
            if past:
                best = (days[name, max(past)], name, max(past))
                break
        out.append((i, *best))
    return sorted(out)


def test_url_filters_equal_brute_force(spark):
    rnd = random.Random(12)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.example.org", "localhost"]
    entries = [(rnd.choice(["a.example.com", "example.com", "y.example.org", "example.org", "com", "localhost"]), day(rnd.randrange(400)), rnd.random() < 0.5) for _ in range(60)]
    entries += [("example.com", day(10), True), ("example.com", day(10), False), (None, day(1), True), ("example.org", None, True)]
    facts = [(n, rnd.choice(hosts), day(rnd.randrange(420))) for n in range(300)]
    urls = [(n, f"HTTPS://user@{h.upper()}.:8080/p?q=1#f", on, "old") for n, h, on in facts]
    odd = [(1000, None, day(3), "old"), (1001, "", day(3), "old"), (1002, "no url", day(3), "old"), (1003, "http://a.example.com/", None, "old"), (0, *urls[0][1:])]
    rows = spark.createDataFrame([*urls, *odd], "id int, url string, fetched_on date, entry string")
    found = url_filters.judge(rows, spark.createDataFrame(entries, "name string, since date, listed boolean")).collect()
    want = brute_judge([*facts, *[(n, None, None) for n in range(1000, 1004)], facts[0]], entries)
    key = lambda x: (x[0], str(x))
    assert sorted(((r.id, r.blocked, r.entry, r.listed_since) for r in found), key=key) == sorted(want, key=key)
    nothing = spark.createDataFrame([], "name string, since date, listed boolean")
    assert url_filters.judge(rows, nothing).where("blocked or entry is not null").count() == 0
    assert url_filters.judge(rows.limit(0), nothing).count() == 0


def test_url_filters_keep_times_and_clashing_columns(spark):
    at = lambda h, d=5: dt.datetime(2024, 1, d, h)
    entries = spark.createDataFrame(
        [("a.com", at(10), True, 1), ("a.com", at(12), False, 2), ("b.com", at(9), True, 1), ("b.com", at(9), False, 2)], "name string, since timestamp, listed boolean, turn int"
    )
    rows = [(1, "http://a.com/", at(9)), (2, "http://a.com/", at(10)), (3, "http://a.com/x", at(11)), (4, "http://a.com/", at(15)), (5, "http://b.com/", at(15))]
    captures = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "id int, url string, fetched_on timestamp, _on int, _best int, _at int")
    found = {r.id: r for r in url_filters.judge(captures, entries, order="turn").collect()}
    assert [found[n].blocked for n in range(1, 6)] == [False, True, True, False, False]
    assert all((r._on, r._best, r._at) == (7, 8, 9) for r in found.values())
    assert url_filters.judge(captures.where("id = 5"), entries.drop("turn")).first().blocked


def test_mix_passes_clashing_columns(spark):
    clash = {c: F.lit(n) for n, c in enumerate(["_id", "_size", "_target", "_finish", "_copies", "_source", "_source_size"])}
    rows = spark.createDataFrame([(n, "a b c", "x" if n % 3 else None) for n in range(30)], "doc_id long, text string, source string")
    plain = sorted(tuple(r) for r in mixing.mix(rows).select("doc_id", "size", "target", "taken").collect())
    found = mixing.mix(rows.withColumns(clash))
    assert sorted(tuple(r) for r in found.select("doc_id", "size", "target", "taken").collect()) == plain
    assert all(found.where(F.col(f"`{c}`") != n).count() == 0 for n, c in enumerate(clash))


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gibberish = random.Random(5)
    planted = spark.createDataFrame(
        [
            (900_001, "You idiot, you are worthless scum, stupid pathetic loser and a disgusting moron. " * 3, "en", "src1", 1),
            (900_002, "1234 5678 !!", "en", "src1", 1),
            (900_003, None, "en", "src2", 1),
            (900_004, None, None, None, None),
            (900_005, "Москва является столицей России и крупнейшим городом страны " * 9, None, "src1", 1),
            (900_006, "東京は日本の首都であり、世界最大の都市の一つである。" * 9, None, "src1", 1),
            (900_007, " ".join("".join(gibberish.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200)), None, "src1", 1),
        ],
        documents.schema,
    )
    copies = documents.orderBy("doc_id").limit(5).withColumn("doc_id", F.col("doc_id") + 800_000)
    folder = str(tmp_path)
    documents.unionByName(planted).unionByName(copies).withColumn("extra", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert 900_001 not in seen["toxicity"] and {900_002, 900_003} <= seen["toxicity"]
    assert not set(range(900_002, 900_008)) & seen["language_id"]
    assert not {r.doc_id for r in copies.collect()} & seen["near_dedup"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = {i for i, t in labels.items() if t == 0}
    assert len(clean & seen["toxicity"]) >= 0.98 * len(clean)
    assert len(seen["language_id"]) >= 0.99 * (len(seen["toxicity"]) - 6)
    assert seen["bpe"] == seen["mixing"] and docs.where("n_tokens > 0").count() == docs.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0

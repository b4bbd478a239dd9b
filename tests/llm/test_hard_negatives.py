"""Hard negatives against brute force."""

import random
from math import floor, isfinite

from pyspark.sql import functions as F

from rolewatch.llm import hard_negatives

ROWS = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=10, scale=256):
    known = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and isfinite(x) for x in v):
            known[i] = min(known.get(i, (v, label)), (v, label))
    known = {i: ([floor(scale * x) for x in v], label) for i, (v, label) in known.items()}
    score = lambda a, b: sum(x * y for x, y in zip(known[a][0], known[b][0]))
    out = []
    for a in known:
        if not anchor(a):
            continue
        others = sorted((-score(a, b), b) for b in known if b != a and len(known[a][0]) == len(known[b][0]))
        for down, p in [x for x in others if known[x[1]][1] == known[a][1]][:positives]:
            near = [x for x in others if known[x[1]][1] != known[a][1] and -30 * down <= -100 * x[0] <= -90 * down][:negatives]
            out += [(a, p, n + 1, b, -down, -s) for n, (s, b) in enumerate(near)]
    return sorted(out)


def points(rnd, n, dim=8, labels=4):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    return [(i, [c + rnd.gauss(0, 0.7) for c in centres[rnd.randrange(3)]], 0 if rnd.random() < 0.4 else rnd.randrange(labels)) for i in range(n)]


def found(spark, rows, schema=ROWS, every=10, **settings):
    table = spark.createDataFrame(rows, schema).withColumns({"_id": F.lit(1), "score": F.lit(2), "_limits": F.lit(3)})
    return sorted(tuple(r) for r in hard_negatives.mine(table, F.col("_id") % every == 0, **settings).collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    rows = points(rnd, 400)
    ties = [(1000 + n, rows[n % 7][1], n % 3) for n in range(60)]  # equal vectors under several labels
    odd = [(2000, None, 1), (2010, [], 1), (2020, [1.0] * 7 + [None], 1), (2030, [float("nan")] * 8, 1), (2040, [1.0] * 8, None), (None, [1.0] * 8, 1), (2050, [float("inf")] * 8, 1)]
    short = [(3000 + n, [rnd.gauss(1, 1) for _ in range(3)], n % 2) for n in range(30)]
    rows += ties + odd + short + rows[:20] + [(30, [0.0] * 8, 2), (40, [0.0] * 8, 1)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert found(spark, rows) == want and len(want) > 500
    for name, value in (("BLOCK_BYTES", 640), ("ANCHOR_BYTES", 700), ("ROW_BYTES", 3000)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert found(spark, rows) == want


def test_negatives_of_few_rows_and_other_limits(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [-1.0, 0.0], 1), (4, [0.9, 0.3], 3)]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert found(spark, rows, positives=1, negatives=1) == brute(rows, lambda i: i % 10 == 0, 1, 1)
    negative = [(0, [1.0], 1), (1, [-2.0], 1), (2, [-1.0], 2), (3, [0.0], 1), (4, [0.0], 2)]
    assert found(spark, negative) == brute(negative, lambda i: i % 10 == 0) == [(0, 3, 1, 4, 0, 0)]


def test_products_beyond_doubles_are_exact(spark):
    rnd = random.Random(8)
    rows = [(i, [float(rnd.randrange(1 << 22)) + rnd.random() for _ in range(4)], i % 2) for i in range(60)]
    assert found(spark, rows, scale=256) == brute(rows, lambda i: i % 10 == 0)

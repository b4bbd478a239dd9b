"""SimHash, BPE, token counts, toxicity, language and licences against brute force, libraries and held-out labels."""

import random
import re
from math import log

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolewatch.llm import bpe, common, components, langid, licenses, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " \t\n", "!!", "é", "x" * 30_000, "word " * 5_000]


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, distance):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = [[rnd.choice("the of and to in is was river stone cloud tree bird light road house".split()) + rnd.choice("abcdef") for _ in range(rnd.randint(1, 120))] for _ in range(40)]
    out = [" ".join(w) for w in base]
    for words in base[:25]:
        for _ in range(4):
            copy = list(words)
            copy[rnd.randrange(len(copy))] = "changed"
            out.append(" ".join(copy).upper() if rnd.random() < 0.3 else "  ".join(copy))
    return out + ODD + [out[0], out[1], None]


def test_simhash_equals_brute_force(spark, texts):
    rows = spark.createDataFrame([(n, t, None, None) for n, t in enumerate(texts)], DOCS).withColumn("fingerprint", F.lit("clash"))
    found = {r.doc_id: r for r in simhash.near_duplicates(rows, cell_rows=16).collect()}
    prints = {n: brute_fingerprint(t) for n, t in enumerate(texts)}
    assert {n: int(r.fingerprint, 16) for n, r in found.items()} == prints
    assert {n: r.component_id for n, r in found.items()} == brute_classes(prints, 4)


def test_keep_one_keeps_the_smallest_id_of_each_group(spark, texts):
    given = [(n + 10, t, None, None) for n, t in enumerate(texts)]
    rows = spark.createDataFrame([*given, *given[:5], (None, "alone here", None, None), (None, "alone here", None, None)], DOCS)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    classes = brute_classes({n + 10: brute_fingerprint(t) for n, t in enumerate(texts)}, 4)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(classes.values()))
    assert ids.count(None) == 1


def test_anchor_links_connect_all_pairs_in_reach(spark):
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        q = p
        for _ in range(rnd.randint(1, 6)):
            q ^= 1 << rnd.randrange(64)
            prints.add(q)
    numbers = dict(enumerate(sorted(prints)))
    unique = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in numbers.values()], "fingerprint long")
    for widths, bits in (((22, 21, 21), 4), ((32, 32), 5)):
        links = simhash.links(unique, 4, widths, bits, cell_rows=8).distinct().collect()
        place = {p: n for n, p in numbers.items()}
        got = components_of(numbers, [(place[r.a % (1 << 64)], place[r.b % (1 << 64)]) for r in links])
        assert got == brute_classes(numbers, 4)


def components_of(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


def test_code_covers_and_patterns_reach_every_anchor():
    table = simhash.patterns(18, 2)
    for value in [random.Random(1).getrandbits(18) for _ in range(200)]:
        syndrome = lambda v: np.bitwise_xor.reduce([0, *[p + 1 for p in range(15) if v >> p & 1]])
        near = {value ^ p for p in table[syndrome(value)]}
        assert near == {value ^ e for e in [0, *[1 << i for i in range(18)], *[1 << i | 1 << j for i in range(18) for j in range(i)]] if syndrome(value ^ e) == 0}
        assert any(bin(value ^ a).count("1") <= 1 for a in near)


def test_connected_follows_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1200)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_joins_what_links_join():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 80, 60), rnd.integers(0, 80, 60)
    nodes = set(a.tolist()) | set(b.tolist())
    whole = components_of(nodes, list(zip(a.tolist(), b.tolist(), strict=True)))
    x, y = components.forest(a, b)
    assert components_of(nodes, list(zip(x.tolist(), y.tolist(), strict=True))) == whole
    assert len(x) <= len(nodes)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(spark, library):
    rnd = random.Random(7)
    parts = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", " ", "\x85", "a", "the", "'s", "aaaaaaaa", "é", "日本語", "😀", "<|endoftext|>", "1", "½", "_", "!!", "x" * 50, "zzzyx", "ing"]
    given = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    given += ["".join(rnd.choice("abcdeinorst ") for _ in range(rnd.randint(0, 300))) for _ in range(500)] + ["ab" * 20_000] + ODD
    rows = spark.createDataFrame([(n, t, "x", None) for n, t in enumerate(given)], DOCS).withColumn("ids", F.lit(1))
    found = bpe.encode_texts(rows, decoded="decoded").collect()
    assert rows.columns == ["doc_id", "text", "lang", "source", "ids"] and found[0].lang == "x"
    for r in found:
        ids = library.encode(given[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (given[r.doc_id] or "")


def test_bpe_decodes_any_ids(spark, library):
    rnd = random.Random(8)
    lists = [[rnd.randrange(50_257) for _ in range(20)] for _ in range(300)] + [[], None]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(lists)], "n int, ids array<int>")
    for r in bpe.decode_ids(rows).collect():
        assert r.decoded == (library.decode(lists[r.n], skip_special_tokens=False) if lists[r.n] else "")
    assert bpe.encode_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_compatible_pairs_are_those_that_merging_leaves():
    coder = bpe.Vocabulary(bpe.file_content(bpe.default_vocabulary()))
    rnd = random.Random(9)

    names = {i: t for t, i in __import__("json").loads(bpe.file_content(bpe.default_vocabulary()))["model"]["vocab"].items()}
    of = {t: i for i, t in names.items()}
    for _ in range(400):
        a, b = rnd.randrange(2000), rnd.randrange(2000)
        parts = [of[c] for c in names[a] + names[b]]
        while True:
            ranks = [(coder.rank.get(x << 32 | y, 1 << 60), n) for n, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
            if not ranks or min(ranks)[0] == 1 << 60:
                break
            n = min(ranks)[1]
            parts[n : n + 2] = [of[names[parts[n]] + names[parts[n + 1]]]]
        assert coder.compatible(a, b) == (parts == [a, b])


def brute_sections(library, text, edges, rule):
    counts = [0] * (len(edges) - 1)
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        shared = [max(0, min(b, hi) - max(a, lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
        touched = [n for n, s in enumerate(shared) if s]
        counts[{"most": shared.index(max(shared)), "first": touched[0], "last": touched[-1]}[rule]] += 1
    return counts


def test_token_counts_equal_offsets_of_the_library(spark, library):
    rnd = random.Random(11)
    given = ["".join(rnd.choice(["stone ", "river", "\n", " ", "\n\n", "é", "abc. ", "12"]) for _ in range(60)) for _ in range(60)]
    rows = spark.createDataFrame([(n, t, "keep", None) for n, t in enumerate(given)], DOCS)
    for rule in token_counts.RULES:
        found = {}
        for r in token_counts.token_counts(rows, rule=rule).collect():
            found.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
        for n, text in enumerate(given):
            lines = text.splitlines(keepends=True)
            edges = np.cumsum([0, *map(len, lines)]).tolist()
            got = sorted(found[n])
            assert [x[3] for x in got] == brute_sections(library, text, edges, rule)
            assert [x[1:3] for x in got] == list(zip(edges, edges[1:], strict=False))


def test_token_counts_of_given_sections(spark):
    spans = "array<struct<start:int,end:int>>"
    given = [(1, "hello world again", [(0, 5), (11, 17)]), (2, "", []), (3, None, None), (4, "abc", [(2, 1), (0, 9), None])]
    rows = spark.createDataFrame(given, f"doc_id int, text string, spans {spans}")
    found = sorted((r.doc_id, r.section, r.n_tokens) for r in token_counts.token_counts(rows, sections="spans").collect())
    assert found == [(1, -1, 1), (1, 0, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 0, 0), (4, 1, 1)]
    with pytest.raises(ValueError):
        token_counts.token_counts(rows, rule="any")


def test_language_is_right_on_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn_from_documents(documents)
    found = langid.identify(documents, model).where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (F.length("text") > 40))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = spark.createDataFrame([(n, t, "de", None) for n, t in enumerate([None, "", "123 !!", "ж" * 5000, "½ ² ①", "Ⅷ 12"])], DOCS)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [rows[n].lang_pred for n in (0, 1, 2, 4, 5)] == ["und"] * 5 and rows[0].score == 0.0
    assert rows[3].lang_pred in model.languages and 0 <= rows[3].score <= 1 and rows[3].lang == "de"


def test_language_sample_is_that_of_the_least_hashes(spark):
    rows = spark.createDataFrame([(n, f"text {n}", "a" if n % 5 else "b") for n in [*range(900), *range(50)]], "doc_id long, text string, lang string").withColumn("_hash", F.lit(1))
    known = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().collect()
    want = {r.doc_id for lang in "ab" for r in sorted((r for r in known if r.lang == lang), key=lambda r: (r.h, r.doc_id))[:40]}
    assert {int(r.text.split()[1]) for r in langid.sampled(rows, per_language=40).collect()} == want


def test_texts_in_no_language_fit_none(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = langid.sampled(documents).cache()
    model = langid.learn(sample)
    least = langid.least_fits(sample, model)
    texts = documents.select("text").unionByName(spark.createDataFrame([("Москва столица России " * 9,), ("東京は日本の首都" * 9,), ("12",), (None,)], "text string"))
    kept = langid.identify(texts, model, fit="fit").where(langid.of_a_language(F.col("lang_pred"), F.col("fit"), F.col("letters"), least))
    assert 0.995 * documents.count() <= kept.count() <= documents.count()
    assert kept.where("text like 'Моск%' or text like '東%'").count() == 0
    assert langid.least_fits(sample.limit(0), model) == {}


def test_store_and_slices_stay_within_their_bounds():
    made = []
    store = common.Recent(lambda k: made.append(k) or b"x" * 100, 10_000)
    assert [store[str(n % 50)] for n in range(500)] == [b"x" * 100] * 500 and len(store) + len(store.older) < 60
    assert len(store["y" * 1000]) == 100 and "y" * 1000 not in store
    texts = pa.array(["a" * 10, None, "b" * 50, "", "c" * 7])
    assert list(common.slices(texts, 20)) == [(0, 2), (2, 3), (3, 5)] and list(common.slices(texts.slice(0, 0))) == []
    nested = pa.array([{"t": "a" * 10, "n": [1, 2]}, None, {"t": None, "n": None}])
    assert list(common.byte_sizes(nested)) == [26, 0, 0] and list(common.byte_sizes(nested.slice(1))) == [0, 0]
    assert [len(x) for x in common.lists_of(pa.array([[1], None, [2, 3]]).slice(1))] == [0, 2]
    first = common.kept_by_worker("a", b"key", list)
    assert common.kept_by_worker("a", bytes(b"key"), list) is first and common.kept_by_worker("b", b"key", list) is not first


def test_language_with_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOCS)
    model = langid.learn_from_documents(empty)
    assert model.languages == []
    one = spark.createDataFrame([(1, "some words", None, None)], DOCS)
    assert langid.identify(one, model).select("lang_pred", "score").collect() == [("und", 0.0)]


def test_forward_sums_equal_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    lattice = langid.Lattice(pieces)
    chance = [0.1, 0.2, 0.05, 0.15, 0.1, 0.3, 0.1]

    def every(text):
        if not text:
            yield []
        for n, p in enumerate(pieces):
            if text.startswith(p):
                yield from ([n, *rest] for rest in every(text[len(p) :]))

    for word in ("a", "ab", "abba", "babab"):
        ways = list(every("▁" + word))
        weights = [np.prod([chance[n] for n in way]) for way in ways]
        assert np.isclose(np.exp(lattice.log_probability(word, [[*chance, 1e-9]])[0]), sum(weights))
        expected = lattice.expected(word, np.log(chance).tolist())
        for n in range(len(pieces)):
            share = sum(w * way.count(n) for w, way in zip(weights, ways, strict=True)) / sum(weights)
            assert np.isclose(expected.get(n, 0.0), share)
    long = lattice.log_probability("ab" * 20_000, [[*chance, 1e-9]])[0]
    assert np.isfinite(long) and long < -1000


@pytest.mark.parametrize("pieces", [["▁", "▁a", "a", "b", "ab", "▁ab", "ba"], ["▁a", "ab"], []])
def test_words_summed_together_equal_words_by_themselves(pieces):
    lattice = langid.Lattice(pieces)
    chances = np.random.default_rng(3).random((len(pieces) + 1, 2))
    words = ["a", "abba", "c", "acab", "b" * langid.SHORT_WORD, "", "ba"]
    found = lattice.log_probabilities(words, chances)
    alone = [lattice.log_probability(w, chances.T.tolist()) for w in words]
    assert np.allclose(found, alone)


def test_toxicity_ranks_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.learn(documents, labels)
    scored = toxicity.score_texts(documents, model)
    rows = scored.join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("toxic", "score").collect()
    wins = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    assert np.mean(wins) > 0.85
    odd = spark.createDataFrame([(n, t, None, None) for n, t in enumerate(ODD)], DOCS).withColumns({"prediction": F.lit("mine"), "features": F.lit(1)})
    found = toxicity.score_texts(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.prediction == "mine" for r in found)


def plain_features(text, odds):
    """The features of one text, counted word by word."""
    chunks, raw = (text or "").split(), (text or "").encode()
    if not text:
        return [0.0] * toxicity.FEATURES
    hits, fixed, found, persons, hidden, capitals = [], 0, [], [], 0, 0
    for n, chunk in enumerate(chunks):
        inner = chunk.strip(toxicity.EDGES)
        word = chunk.lower().strip(toxicity.EDGES)
        odd = toxicity.HIDDEN.search(inner) is not None
        plain = word
        if odd:
            plain = re.sub(r"(.)\1{2,}", r"\1", "".join(c for c in word if c not in ".-_").translate(toxicity.DISGUISE))
        best = max([odds.get(w, 0.0) for w in (word, plain)] + [odds.get(w[:k] + "-", 0.0) for w in (word, plain) for k in (4, 5, 6) if len(w) > k])
        is_fixed = word in toxicity.INSULTS or (odd and plain in toxicity.INSULTS)
        fixed += is_fixed
        if best > 0:
            found.append(best)
        if is_fixed or best > 0:
            hits.append(n)
        if word in toxicity.SECOND_PERSON:
            persons.append(n)
        hidden += odd
        capitals += len(inner) > 1 and inner.isupper()
    near = sum(any(abs(h - p) <= 5 for p in persons) for h in hits)
    letters = max(1, sum(97 <= (b | 32) < 123 for b in raw) + sum(b >= 0xC0 for b in raw))
    words, marks = max(1, len(chunks)), [c for c in range(33, 127) if not chr(c).isalnum()]
    return [
        fixed / words, log(1 + fixed), max(found, default=0.0), sum(found) / words, log(1 + len(found)), sum(found), near / words, log(1 + near),
        sum(65 <= b < 91 for b in raw) / letters, capitals / words, raw.count(b"!") / len(raw), sum(b in marks for b in raw) / len(raw), hidden / words,
    ]


def test_toxicity_scores_are_those_of_features_trees_and_steps(spark):
    """A hundred texts described, walked through the trees and calibrated one by one."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.learn(documents, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in documents.orderBy(F.xxhash64("doc_id")).limit(100).collect()] + [(-1, None), (-2, ""), (-3, "You id1ot!! YOU st-u-p-i-d scum")]
    found = {r.doc_id: r for r in toxicity.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    trees, weights = model.trees.trees, model.trees.treeWeights
    at, steps = list(model.calibration.boundaries), list(model.calibration.predictions)

    def leaf(node, values):
        while node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            node = node.leftChild() if values[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    for i, text in rows:
        values = plain_features(text, model.odds[0])
        assert np.allclose(values, toxicity.Describer(model.odds[0]).features(text))
        margin = sum(w * leaf(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"), values) for t, w in zip(trees, weights))
        raw = 1 / (1 + np.exp(-2 * margin))
        score = min(1.0, max(0.0, np.interp(raw, at, steps) * (1 - toxicity.OWN_SHARE) + raw * toxicity.OWN_SHARE))
        assert abs(found[i].score - score) < 1e-9 and found[i].predicted == (score >= 0.5)
    assert len({round(r.score, 9) for r in found.values()}) > 10


def test_bands_follow_the_number_of_fingerprints(spark):
    assert simhash.widths_for(1) == simhash.widths_for(10**7) == (22, 21, 21) and simhash.widths_for(10**10) == (32, 32)
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << p for p in rnd.sample(range(64), rnd.randrange(6))) for b in base for _ in range(5)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = [sorted(components.connected(simhash.links(rows, widths=w)).collect()) for w in simhash.CHOICES]
    assert roots[0] == roots[1] and len(roots[0]) > 50


def test_toxicity_without_labels_or_with_one_kind(spark):
    documents = spark.createDataFrame([(n, f"text {n}", None, None) for n in range(20)], DOCS)
    for labels, share in (([], 0.0), ([(n, 1) for n in range(20)], 1.0), ([(n, None) for n in range(20)], 0.0)):
        model = toxicity.learn(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score_texts(documents, model).collect()} == {share}


def test_features_see_disguise_persons_and_capitals():
    plain = toxicity.Describer({"nast-": 3.0})
    names = ["fixed", "log_fixed", "odds", "odds_rate", "log_odds", "odds_sum", "near", "log_near", "capitals", "shouted", "exclaimed", "marks", "hidden"]
    see = lambda text: dict(zip(names, plain.features(text), strict=True))
    assert see("You are an idiot")["near"] > 0 and see("You are a b c d e f g idiot")["near"] == 0
    assert see("an 1d!ot here")["hidden"] > 0 and see("an 1d!ot here")["fixed"] > 0
    assert see("nastily done")["odds"] == 3.0 and see("STOP it!!")["shouted"] > 0 and see("STOP it!!")["exclaimed"] > 0
    assert not any(plain.features(None)) and not any(plain.features(""))


def test_licences(spark):
    mit = licenses.TEMPLATES["mit"]
    given = {
        1: "intro\nReleased under the MIT License.\nend",
        2: f"head\n\n{mit[:300]}\n{mit[300:]}\n\ntail",
        3: "This is licensed under CC BY-NC 4.0",
        4: "nothing of the kind",
        5: "",
        6: "Released under the MIT License.\nReleased under the  MIT License\nReleased under the MIT License.",
    }
    rows = spark.createDataFrame([*[(i, t) for i, t in given.items()], (7, None), (1, given[1]), (8, "x " * 50_000)], "doc_id long, text string").withColumn("dice", F.lit("clash"))
    found = {(r.doc_id, r.template): (round(r.dice, 4), r.passages) for r in licenses.licenses(rows).collect()}
    assert found[1, "mit-notice"] == (1.0, 1) and found[2, "mit"] == (1.0, 3) and found[6, "mit-notice"] == (1.0, 2)
    assert {k for k in found if k[0] in (4, 5, 7, 8)} == set()
    assert found[3, "cc-by-nc-4.0-notice"][0] == brute_dice(given[3], licenses.TEMPLATES["cc-by-nc-4.0-notice"])


def brute_dice(a, b):
    from collections import Counter

    def grams(text):
        words = [w for w in __import__("re").split("[^a-z0-9]+", text.lower()) if w]
        return Counter(zip(words, words[1:], strict=False))

    x, y = grams(a), grams(b)
    return round(2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())), 4)


def test_licences_of_several_paragraphs_and_notices_within_lines(spark):
    other = "Some words of another kind stand here and go on for a while, with no end in sight."
    given, names = {}, ["mit", "apache-2.0-header", "bsd-2-clause", "gpl-3.0-header"]
    for n, name in enumerate(names):
        words = licenses.TEMPLATES[name].split()
        parts = [" ".join(words[len(words) * k // 4 : len(words) * (k + 1) // 4]) for k in range(4)]
        given[n] = f"{other}\n\n" * 9 + "\n\n".join(parts) + f"\n\n{other}" * 9
        given[n + 10] = f"{other}\n" * 9 + "\n".join(f" * {p}" for p in parts) + f"\n{other}" * 9
    given[20] = f"{other} {other} Released under the MIT License. {other}"
    given[21] = f"{other} Released under another License. {other}"
    rows = spark.createDataFrame([*given.items()], "doc_id long, text string")
    found = {(r.doc_id, r.template): (r.dice, r.passages) for r in licenses.licenses(rows).collect()}
    want = {(n + k, name): (1.0, 1) for n, name in enumerate(names) for k in (0, 10)} | {(20, "mit-notice"): (1.0, 1)}
    assert {k: v for k, v in found.items() if k in want} == want
    assert {k for k in found if k not in want} <= {(n, "apache-2.0-notice") for n in (1, 11)}


def test_best_run_equals_brute_force(spark):
    rnd = random.Random(5)
    templates = {"p": "a b a b c a b d", "q": "a a a a b", "r": "c d a"}
    given = {n: " ".join(rnd.choice("aabbcdx") for _ in range(rnd.randrange(2, 30))) for n in range(150)}
    rows = spark.createDataFrame([*given.items()], "doc_id long, text string")
    found = {(r.doc_id, r.template): round(r.dice, 4) for r in licenses.matches(rows, templates=templates, threshold=0.7).where("run").collect()}
    want = {}
    for n, text in given.items():
        w = text.split()
        for name, template in templates.items():
            best = max(brute_dice(" ".join(w[i:j]), template) for i in range(len(w)) for j in range(i + 2, len(w) + 1)) if len(w) > 1 else 0
            if best >= 0.7:
                want[n, name] = best
    assert found == want and len(want) > 30


def test_licences_scan_is_native(spark):
    plan = licenses.licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_schema_of_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []
    assert token_counts.token_counts(empty).collect() == []
    assert licenses.licenses(empty).collect() == []
    assert isinstance(bpe.encode_texts(empty).schema["ids"].dataType, T.ArrayType)


def test_language_is_learned_from_all_documents(spark):
    rows = spark.range(8000).selectExpr("id as doc_id", "concat('w', translate(id, '0123456789', 'abcdefghij'), ' ', 'end.') as text", "'a' as lang", "'s' as source", "1 as n_chars")
    known = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert known.count() > langid.PER_LANGUAGE
    assert np.allclose(langid.learn_from_documents(rows).table, langid.learn(known).table)
    assert not np.allclose(langid.learn_from_documents(rows, per_language=40).table, langid.learn(known).table)


def test_language_stage_of_pipeline_takes_no_sample(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(langid, "sampled", None)
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert corpus_pipeline.reject_unknown_language(spark, documents, "/root/testdata/sf0.001").count() > 0


def test_expected_pieces_of_many_words_are_those_of_each():
    pieces = [langid.START, "▁a", "a", "ab", "b", "abc", "▁ab"]
    lattice, log_prior = langid.Lattice(pieces), langid.log_prior_of(pieces)
    words, times = ["abba", "c", "abcab", "b" * langid.SHORT_WORD, "a"], np.array([1.0, 2, 3, 1, 5])
    want = np.zeros(len(pieces))
    for word, n in zip(words, times, strict=True):
        for piece, share in lattice.expected(word, log_prior).items():
            want[piece] += n * share
    assert np.allclose(lattice.expected_of_all(words, times, np.append(np.exp(log_prior), langid.FLOOR)), want)
    assert not lattice.expected_of_all([], np.empty(0), np.append(np.exp(log_prior), langid.FLOOR)).any()


def test_store_of_repeated_keys_holds_none_seen_once():
    made = []
    store = common.Recent(lambda k: made.append(k) or k.encode(), 10_000, repeated=True)
    assert [store["a"], store["a"], store["a"], store["b"]] == [b"a", b"a", b"a", b"b"]
    assert made == ["a", "a", "b"] and "a" in store and "b" not in store
    store.marked = common.MISSED_PLACES
    assert store["c"] == b"c" and store.marked == 1


def test_evidence_of_chunks_and_words_is_computed_once_and_bounded():
    model = langid.Model(["▁a", "a", "b"], ["x", "y"], np.array([[0.2, 0.1], [0.3, 0.2], [0.1, 0.4]])).ready()
    weighed, weigh = [], model.known_words.compute
    model.known_words.compute = lambda words: weighed.extend(words) or weigh(words)
    texts = ["ab, ab ½ab 12", None, "AB. ba-ab", "", "a" * 50, "..."]
    found = model.predict(texts)
    assert sorted(weighed) == ["a" * 50, "ab", "ba"]
    assert [p[3] for p in found] == [6.0, 0.0, 6.0, 0.0, 50.0, 0.0]
    assert model.predict(texts) == found and [p for t in texts for p in model.predict([t])] == found and len(weighed) == 3
    want = 3 * np.array(model.lattice.log_probability("ab", model.columns))
    assert found[0][0] == "xy"[want.argmax()] and np.isclose(found[0][2], want.max() / 6)
    made = []
    store = langid.Evidence(lambda keys: made.append(keys) or np.array([[float(k[1:])] for k in keys]), 1, 20 * (common.ENTRY_BYTES + 8))
    for n in range(0, 400, 5):
        assert store.values_of(["k7", "k7", *[f"k{m}" for m in range(n, n + 5)]], 7)[:, 0].tolist() == [7, 7, *range(n, n + 5)]
        assert len(store.places) == max(store.places.values()) + 1 <= 20 and len(store.rows) <= 40
    assert sum(k.count("k7") for k in made) == 1
    store.values_of(["k" + "0" * common.STORED_LENGTH + str(m) for m in range(21)], 21)
    assert max(map(len, store.places)) <= common.STORED_LENGTH


def test_words_of_many_chunks_are_those_of_each():
    chunks = ["Σας,ΣΑΣ", "½x²", "", "İb", "a_b1c", "--", "ΟΔΟΣ"]
    words, counts = langid.words_of_all(chunks)
    assert words == [w for c in chunks for w in langid.words_of(c)] and counts.tolist() == [len(langid.words_of(c)) for c in chunks]
    words, counts = langid.words_of_all(["one", "two-Three"])
    assert words == ["one", "two", "three"] and counts.tolist() == [1, 2]
    assert langid.words_of_all([])[0] == []

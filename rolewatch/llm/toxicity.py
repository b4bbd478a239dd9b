"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density of a fixed lexicon of insults and of a learned one, how often a hit stands near a word of the
second person, rates of capitals, of words in capitals, of punctuation, of exclamation, and of words written to
hide what they say.  The learned lexicon holds words and word beginnings that occur mostly in toxic documents.

Labels are learned from a sample of at most ``sample_rows`` labelled documents that are not held out, taken by hash.
Each training document is described with a lexicon learned without its own fold.  The calibration is fitted on what every
document gets from trees fitted on the other folds; the trees that score are fitted on all.  Isotonic steps are flat; within one, a small
share of the trees' own probability keeps the order.  All documents are then scored, whole.

Results: a null or empty text has features of zero and a score like any other; labels that are null or of unknown
documents are left out, repeated labels of a document count by their mean; with no label, or labels of one kind only,
every score is the share of toxic labels (0 with none).  Repeated rows stay repeated; other columns pass, but for
``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STORE_BYTES, Recent, cut, fold, free_name, kept_by_worker, list_array, with_computed

#: Words of abuse, as text.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass fool imbecile loser losers pathetic worthless trash garbage scum filth vermin "
    "disgusting clown pig swine bastard bitch whore slut asshole shit fuck fucking fucker motherfucker cunt dick prick retard retarded "
    "ugly freak parasite subhuman coward liar jerk creep degenerate hate kill die "
    "dumm dummkopf idioten abschaum arschloch scheisse hurensohn wichser trottel versager "
    "connard connasse salope merde ordure imbécile débile crétin abruti minable "
    "estúpido estúpida imbécil idiota basura escoria puta mierda cabrón gilipollas asqueroso inútil".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Words apart up to which a hit counts as near the second person.
NEAR = 5
#: Characters that stand for letters in hidden words.
DISGUISE = str.maketrans("013457@$!|*+", "oieastasiiat")
EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»„“”‘’…–—¡¿"
HIDDEN = re.compile(r"[^\W\d_][@$!|*0134578+.\-_]+[^\W\d_]|([^\W\d_])\1{3,}")
STEMS = (4, 5, 6)
SAMPLE_ROWS = 20_000
#: A learned term occurs in so many toxic documents at least, and its log odds are so high.
LEAST_DOCUMENTS = 4
LEAST_ODDS = 1.5
MOST_TERMS = 5_000
COUNTED_TERMS = 500_000
FOLDS = (1, 2, 3, 4)
#: Tasks that trees are fitted in.
FITTING_TASKS = 4
#: Share of the trees' own probability in a score.
OWN_SHARE = 0.01
FEATURES = 13
SEED = 17


def core(chunk: str) -> str:
    return chunk.lower().strip(EDGES)


def terms(word: str) -> list[str]:
    """A word and its beginnings, which are marked by a hyphen."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


class Describer:
    """Features of texts under one learned lexicon."""

    def __init__(self, odds: dict[str, float], store: int = STORE_BYTES):
        self.odds = odds
        self.facts = Recent(self.fact, store)

    def fact(self, chunk: str) -> tuple | None:
        """(fixed hit, learned odds, second person, hidden, in capitals), or None for a word with none of these."""
        word = core(chunk)
        inner = chunk.strip(EDGES)
        hidden = bool(HIDDEN.search(inner))
        plain = re.sub(r"[.\-_]", "", word).translate(DISGUISE) if hidden else word
        plain = re.sub(r"(.)\1{2,}", r"\1", plain) if hidden else plain
        fixed = word in INSULTS or (hidden and plain in INSULTS)
        odds = max((self.odds.get(t, 0.0) for w in {word, plain} for t in terms(w)), default=0.0)
        found = (fixed, odds, word in SECOND_PERSON, hidden, len(inner) > 1 and inner.isupper())
        return found if any(found) else None

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        if not text:
            return out
        chunks = text.split()
        facts = self.facts
        found = [(n, f) for n, c in enumerate(chunks) if (f := facts[c]) is not None]
        raw = np.frombuffer(text.encode(), np.uint8)
        letters = max(1, int(((raw | 32) - 97 < 26).sum() + (raw >= 0xC0).sum()))
        words = max(1, len(chunks))
        hits = [n for n, f in found if f[0] or f[1] > 0]
        persons = np.array([n for n, f in found if f[2]])
        near = 0
        if hits and len(persons):
            at = np.searchsorted(persons, hits)
            before = np.abs(persons[np.maximum(at - 1, 0)] - hits)
            after = np.abs(persons[np.minimum(at, len(persons) - 1)] - hits)
            near = int((np.minimum(before, after) <= NEAR).sum())
        fixed = sum(f[0] for _, f in found)
        odds = [f[1] for _, f in found if f[1] > 0]
        out[:] = (
            fixed / words,
            log(1 + fixed),
            max(odds, default=0.0),
            sum(odds) / words,
            log(1 + len(odds)),
            sum(odds),
            near / words,
            log(1 + near),
            int((raw - 65 < 26).sum()) / letters,
            sum(f[4] for _, f in found) / words,
            int((raw == 33).sum()) / len(raw),
            int(np.isin(raw, PUNCTUATION).sum()) / len(raw),
            sum(f[3] for _, f in found) / words,
        )
        return out


PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()], np.uint8)


def term_counts(sample: DataFrame) -> DataFrame:
    """Per term, in how many toxic (``t1..t4``) and other (``c1..c4``) documents of each fold it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}

        def out() -> pa.RecordBatch:
            keys, n = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int32()), pa.array(n, pa.int64())], names=["term", "slot", "n"])

        for batch in batches:
            for text, toxic, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                slot = part * 2 + toxic
                for term in {t for w in set(map(core, set((text or "").split()))) if w for t in terms(w)}:
                    counts[term, slot] = counts.get((term, slot), 0) + 1
                if len(counts) > COUNTED_TERMS:
                    yield out()
        yield out()

    found = sample.select("text", "toxic", "fold").mapInArrow(run, "term string, slot int, n long")
    slots = [(f"{'ct'[toxic]}{k}", k * 2 + toxic) for k in FOLDS for toxic in (0, 1)]
    sums = [F.coalesce(F.sum(F.when(F.col("slot") == slot, F.col("n"))), F.lit(0)).alias(name) for name, slot in slots]
    return found.groupBy("term").agg(*sums)


def lexicons(sample: DataFrame, totals: dict[str, int]) -> dict[int, dict[str, float]]:
    """A lexicon without each fold, and under 0 one of all; at most ``MOST_TERMS`` terms come to the driver."""
    parts = {0: FOLDS, **{k: tuple(x for x in FOLDS if x != k) for k in FOLDS}}
    counts = term_counts(sample)
    toxic = sum(F.col(f"t{k}") for k in FOLDS)
    other = sum(F.col(f"c{k}") for k in FOLDS)
    all_toxic, all_other = sum(totals[f"t{k}"] for k in FOLDS), sum(totals[f"c{k}"] for k in FOLDS)
    odds = F.log((toxic + 0.5) / (all_toxic + 1.0)) - F.log((other + 0.5) / (all_other + 1.0))
    best = counts.withColumn("_odds", odds).where((toxic >= LEAST_DOCUMENTS) & (F.col("_odds") >= LEAST_ODDS))
    rows = best.orderBy((F.col("_odds") * F.sqrt(toxic)).desc(), "term").limit(MOST_TERMS).collect()
    found: dict[int, dict[str, float]] = {}
    for name, folds in parts.items():
        n_toxic, n_other = sum(totals[f"t{k}"] for k in folds), sum(totals[f"c{k}"] for k in folds)
        found[name] = {}
        for r in rows:
            t, c = sum(r[f"t{k}"] for k in folds), sum(r[f"c{k}"] for k in folds)
            value = log((t + 0.5) / (n_toxic + 1.0)) - log((c + 0.5) / (n_other + 1.0))
            if t >= LEAST_DOCUMENTS - 1 and value >= LEAST_ODDS:
                found[name][r["term"]] = value
    return found


def describe(rows: DataFrame, odds: dict[int, dict[str, float]], text: str, name: str, by_fold: str | None = None) -> DataFrame:
    """Add the features of each text as an array; ``by_fold`` names the column that picks the lexicon."""
    sent = rows.sparkSession.sparkContext.broadcast(odds)  # at most MOST_TERMS terms each
    given = rows.withColumn(name, F.struct(F.col(f"`{text}`").cast("string").alias("text"), (F.col(by_fold) if by_fold else F.lit(0)).cast("int").alias("part")))

    def work():
        by = kept_by_worker("toxicity", sent.value, lambda: {k: Describer(v, 2 * STORE_BYTES // len(sent.value)) for k, v in sent.value.items()})

        def apply(column: pa.Array) -> list:
            texts, parts = column.field("text").to_pylist(), column.field("part").to_pylist()
            found = [by[p].features(t) for t, p in zip(texts, parts, strict=True)]
            return [list_array(found, np.float64)]

        return apply

    return with_computed(given, name, {name: T.ArrayType(T.DoubleType())}, work)


class Model:
    """What scores texts: the lexicon, the trees and the calibration, or a constant."""

    def __init__(self, odds=None, trees=None, calibration=None, constant: float = 0.0):
        self.odds, self.trees, self.calibration, self.constant = odds, trees, calibration, constant


def labelled(documents: DataFrame, labels: DataFrame, text: str, doc_id: str, sample_rows: int) -> DataFrame:
    """``text, toxic, fold`` of the sampled documents; the sample's ids are few by parameter, so they are broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    known = known.groupBy(F.col("doc_id").alias("_label_of")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("_label_of"), "_label_of").limit(sample_rows)
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = rows.join(F.broadcast(known), F.col("_id") == F.col("_label_of"))
    return found.select("text", "toxic", fold("_id").cast("int").alias("fold"))


def learn(
    documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, rounds: int = 20, depth: int = 3
) -> Model:
    """Learn from labelled documents that are not held out; ``labels`` has ``doc_id, toxic``."""
    sample = cut(labelled(documents, labels, text, doc_id, sample_rows))
    names = [(f"{'ct'[toxic]}{k}", k, toxic) for k in FOLDS for toxic in (0, 1)]
    totals = sample.agg(*[F.count(F.when((F.col("fold") == k) & (F.col("toxic") == toxic), 1)).alias(n) for n, k, toxic in names]).first().asDict()
    toxic, other = (sum(totals[f"{x}{k}"] for k in FOLDS) for x in "tc")
    odds = lexicons(sample, totals)
    described = describe(sample, odds, "text", "features", "fold")
    # A few numbers for each of at most ``sample_rows`` texts: trees are fitted by hundreds of small jobs, which a few tasks serve best.
    features = cut(described.select("fold", F.col("toxic").cast("double").alias("toxic"), array_to_vector("features").alias("features"))).coalesce(FITTING_TASKS)
    if not toxic or not other:
        return Model(constant=toxic / max(1, toxic + other))
    booster = GBTClassifier(
        labelCol="toxic", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=64, minInstancesPerNode=2, seed=SEED
    )
    margins = None
    for k in FOLDS:
        if all(sum(totals[f"{x}{n}"] for n in FOLDS if n != k) for x in "tc") and totals[f"t{k}"] + totals[f"c{k}"]:
            part = booster.fit(features.where(F.col("fold") != k)).transform(features.where(F.col("fold") == k))
            part = part.select("toxic", vector_item("probability").alias("raw"))
            margins = part if margins is None else margins.unionByName(part)
    calibration = None if margins is None else IsotonicRegression(labelCol="toxic", featuresCol="raw").fit(cut(margins))
    return Model({0: odds[0]}, booster.fit(features), calibration)


def vector_item(name: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(name)[1]


def score_texts(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score``, from 0 to 1, and ``predicted``, 1 where the score is 0.5 or more."""
    kept = [c for c in rows.columns if c.lower() not in ("score", "predicted")]
    names = [F.col(f"`{c}`") for c in kept]
    if model.trees is None:
        score = F.lit(float(model.constant))
        return rows.select(*names, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    own = {n: free_name(f"_tox_{n}", rows.columns) for n in ("features", "raw", "probability", "label", "value", "score")}
    found = describe(rows, model.odds, text, own["features"]).withColumn(own["features"], array_to_vector(own["features"]))
    trees = model.trees.copy()
    trees.setFeaturesCol(own["features"]).setRawPredictionCol(own["raw"]).setProbabilityCol(own["probability"]).setPredictionCol(own["label"])
    scored = trees.transform(found).withColumn(own["value"], vector_item(own["probability"]))
    result = F.col(own["value"])
    if model.calibration is not None:
        calibration = model.calibration.copy()
        calibration.setFeaturesCol(own["value"]).setPredictionCol(own["score"])
        scored = calibration.transform(scored)
        result = F.col(own["score"]) * (1 - OWN_SHARE) + F.col(own["value"]) * OWN_SHARE
    score = F.least(F.greatest(result, F.lit(0.0)), F.lit(1.0))
    return scored.select(*names, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

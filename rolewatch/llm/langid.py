"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability in a
language is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its
words.  Piece probabilities are learned in one expectation step: each training word gives every piece the share
that it has in all segmentations of the word under a prior that falls with the piece's place in the vocabulary.

All documents that are not held out and have a language are learned from; their words are counted with sums per
task before the shuffle, and what reaches the driver is one number per piece and language.  All documents are then scored, whole.

Results: a text that is null or has no letter is ``und`` with score 0; a word of letters the vocabulary lacks counts
by a floor probability per letter; with no training document every text is ``und``; ties go to the language first by
code point.  Repeated rows stay repeated; other columns pass, but for one with the name of a new column, which is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice
from math import exp, log

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ENTRY_BYTES, STORED_LENGTH, fold, kept_by_worker, with_computed

UNKNOWN = "und"
#: Runs of letters and of numerals other than decimal digits; only the letters count.
RUNS = re.compile(r"[^\W\d_]+")
RUNS_OR_ENDS = re.compile(r"[^\W\d_]+|\n")
LETTERS = regex.compile(r"\p{L}+")
START = "▁"
#: Chunks counted in a task, and characters of texts they come from, before their words are handed on; bounds a task's memory.
COUNTED_CHUNKS = 200_000
COUNTED_CHARACTERS = 64 << 20
#: Bytes of evidence of known chunks that a worker holds.
STORED_EVIDENCE = 40 << 20
#: Bytes of evidence of known words.
STORED_WORDS = 24 << 20
#: Words of up to so many letters are summed together: no sum of theirs falls out of range.
SHORT_WORD = 30
#: Texts whose new words are summed together.
TEXTS = 256
#: Documents of a sample per language, and over all languages.
PER_LANGUAGE = 5_000
SAMPLE_IDS = 500_000
#: Leading bits of an id's hash by which ids are counted in bins.
BIN_BITS = 12
#: Added to each piece's expected count.
SMOOTHING = 0.1
#: Probability of a letter that no piece covers.
FLOOR = 1e-9
LOG_FLOOR = log(FLOOR)
#: How far, in logarithms per letter, a text may fit worse than the median text of its language: a long one, and what a short one may in addition,
#: divided by the root of its letters, as its mean varies more.
MARGIN = 1.5
MARGIN_OF_SHORT = 6.0
#: A text's evidence is divided by this, as the words of a text are not independent.
TEMPER = 4.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def letter_pieces(path: str) -> list[str]:
    """The pieces of a vocabulary file that consist of lower-case letters, word start or not, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i)))
    return [p for p in dict.fromkeys(p.lower() for p in pieces) if p == START or p.removeprefix(START).isalpha()]


def words_of(chunk: str) -> list[str]:
    """The words of lower-case letters in a piece of text."""
    found = RUNS.findall(chunk.lower())
    return found if all(map(str.isalpha, found)) else [w for run in found for w in LETTERS.findall(run)]


def words_of_all(chunks: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of many chunks that hold no blank, one after another, and how many each chunk has.  They are found in one search over all chunks."""
    found = RUNS_OR_ENDS.findall("\n".join([*chunks, ""]).lower())
    ends = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
    words = [w for w in found if w != "\n"]
    if len(ends) == len(chunks) and (not words or "".join(words).isalpha()):
        return words, np.diff(ends, prepend=-1) - 1
    parts = [words_of(c) for c in chunks]
    return [w for part in parts for w in part], np.fromiter(map(len, parts), np.int64, len(parts))


def numbering(keys: Iterable[str] = ()) -> defaultdict[str, int]:
    """Numbers keys from 0 on, those not known yet as they are asked for."""
    numbers = dict(zip(keys, count()))
    return defaultdict(count(len(numbers)).__next__, numbers)


class Lattice:
    """All segmentations of words into pieces."""

    def __init__(self, pieces: list[str]):
        self.places = {p: n for n, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.automaton = ahocorasick.Automaton()
        for p, n in self.places.items():
            self.automaton.add_word(p, n)
        if pieces:
            self.automaton.make_automaton()

    def arcs_of_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[slice]]:
        """The arcs of many short words: the places of their starts and ends, piece, word; the place of each word's start mark; a slice of the arcs per letter they end at.

        One scan of the words, each with its start mark, finds the pieces in all of them, as no piece goes on beyond
        a mark.  A word has one place more than letters: before each letter and after the last.  An uncovered letter is the piece after the last.
        """
        text = "".join([START + w for w in words])
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        word_at = np.repeat(np.arange(len(words)), sizes)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)) if self.places else (), np.int64).reshape(-1, 2)
        last, piece = found[:, 0], found[:, 1]
        alone = np.zeros(len(text), bool)
        alone[last[self.lengths[piece] == 1]] = True
        bare = np.flatnonzero(~alone)
        last = np.concatenate([last, bare])
        begin = np.concatenate([found[:, 0] - self.lengths[piece] + 1, bare])
        piece = np.concatenate([piece, np.full(len(bare), len(self.lengths))])
        if len(bare):  # the scan finds the others in order of their ends
            order = np.argsort(last, kind="stable")
            last, begin, piece = last[order], begin[order], piece[order]
        word = word_at[last]
        step = (last + 1 - first[word]).astype(np.uint16)
        order = np.argsort(step, kind="stable")
        last, begin, piece, word, step = last[order], begin[order], piece[order], word[order], step[order]
        edges = np.searchsorted(step, np.arange(1, sizes.max(initial=0) + 2))
        steps = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return begin + word, last + 1 + word, piece, word, first + np.arange(len(words)), steps

    def sums_of_all(self, words: list[str], table: np.ndarray, arcs: tuple) -> np.ndarray:
        """Sums over the ways to each place; they advance by one letter for all words together."""
        begin, end, piece, word, _, steps = arcs
        sums = np.ones((sum(map(len, words)) + 2 * len(words), table.shape[1]))
        for s in steps:
            here = word[s]
            new = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            sums[end[s][new]] = np.add.reduceat(sums[begin[s]] * table[piece[s]], new, axis=0)
        return sums

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """``log_probability`` of many short words at once: a row per word, a column per language.

        ``table`` has a row per piece and, last, one for an uncovered letter.
        """
        arcs = self.arcs_of_all(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return np.log(self.sums_of_all(words, table, arcs)[arcs[4] + sizes])

    def expected_of_all(self, words: list[str], times: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """``expected`` of many short words at once, each counted ``times``, summed by piece.  ``prior`` has, last, the probability of an uncovered letter."""
        arcs = self.arcs_of_all(words)
        begin, end, piece, word, first, steps = arcs
        ahead = self.sums_of_all(words, prior[:, None], arcs)[:, 0]
        ends = first + np.fromiter(map(len, words), np.int64, len(words)) + 1
        behind = np.zeros(len(ahead))
        behind[ends] = 1.0
        weight = prior[piece]
        for s in reversed(steps):  # the arcs of a word that end at one letter start at different ones
            behind[begin[s]] += weight[s] * behind[end[s]]
        share = ahead[begin] * weight * behind[end] / ahead[ends][word]
        return np.bincount(piece, share * times[word], len(prior))[:-1]

    def arcs(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end, the (start, piece) that lead there; a letter that no piece covers gets an arc with piece -1."""
        text = START + word
        places, longest = self.places, self.longest
        out = [[] for _ in range(len(text) + 1)]
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                n = places.get(text[start:end])
                if n is not None:
                    out[end].append((start, n))
            if n is None:  # the last one looked up is the letter itself
                out[end].append((end - 1, -1))
        return out

    def expected(self, word: str, log_prior: list[float]) -> dict[int, float]:
        """How often each piece is expected in a segmentation of the word: forward sums, then shares from the end."""
        arcs = self.arcs(word)
        ahead = [0.0]
        for into in arcs[1:]:
            parts = [ahead[start] + (log_prior[n] if n >= 0 else LOG_FLOOR) for start, n in into]
            most = max(parts)
            ahead.append(most + log(sum(exp(p - most) for p in parts)))
        passing = [0.0] * len(arcs)
        passing[-1] = 1.0
        found: dict[int, float] = {}
        for end in range(len(arcs) - 1, 0, -1):
            for start, n in arcs[end]:
                share = passing[end] * exp(ahead[start] + (log_prior[n] if n >= 0 else LOG_FLOOR) - ahead[end])
                passing[start] += share
                if n >= 0:
                    found[n] = found.get(n, 0.0) + share
        return found

    def log_probability(self, word: str, columns: list[list[float]]) -> list[float]:
        """Per language, the logarithm of the word's probability summed over all segmentations.

        ``columns``: per language, the probability of each piece and, last, that of an uncovered letter.
        Sums are scaled by their size at the last place, so that words of any length stay within range.
        """
        arcs = self.arcs(word)
        found = []
        for column in columns:
            sums, taken = [1.0], 0.0
            for end, into in enumerate(arcs[1:], 1):
                value = 0.0
                for start, n in into:
                    value += sums[start] * column[n]
                sums.append(value)
                if value < 1e-200:
                    value = value or 1e-300
                    taken += log(value)
                    for n in range(max(0, end - self.longest), end + 1):
                        sums[n] /= value
            found.append(taken + log(sums[-1]))
        return found


def log_prior_of(pieces: list[str]) -> list[float]:
    """Logarithms of probabilities that fall as one over the place in the vocabulary."""
    weight = 1.0 / (np.arange(len(pieces)) + 10.0)
    return np.log(weight / weight.sum()).tolist()


def word_counts(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, word, n`` over all rows with a language and a text."""
    given = rows.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    given = given.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        characters = 0

        def out() -> Iterator[pa.RecordBatch]:
            for a, chunks in counts.items():
                words, each = words_of_all(list(chunks))
                places = numbering()
                at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                n = np.zeros(len(places), np.int64)
                np.add.at(n, at, np.repeat(np.fromiter(chunks.values(), np.int64, len(chunks)), each))
                columns = [pa.repeat(pa.scalar(a, pa.string()), len(places)), pa.array(list(places), pa.string()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for a, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                counts.setdefault(a, Counter()).update(text.split())
                characters += len(text)
                if characters > COUNTED_CHARACTERS or sum(map(len, counts.values())) > COUNTED_CHUNKS:
                    characters = 0
                    yield from out()
        yield from out()

    found = given.mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, pieces: list[str]) -> DataFrame:
    """``lang, piece, n``: expected counts of every piece, from word counts."""
    sent = counts.sparkSession.sparkContext.broadcast(pieces)  # a fixed vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, log_prior = Lattice(sent.value), log_prior_of(sent.value)
        prior = np.append(np.exp(log_prior), FLOOR)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            short: dict[str, tuple[list[str], list[int]]] = {}
            for a, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total = totals.setdefault(a, np.zeros(len(log_prior)))
                if len(word) <= SHORT_WORD:
                    words, times = short.setdefault(a, ([], []))
                    words.append(word)
                    times.append(n)
                    continue
                for piece, share in lattice.expected(word, log_prior).items():
                    total[piece] += n * share
            for a, (words, times) in short.items():
                totals[a] += lattice.expected_of_all(words, np.array(times, np.float64), prior)
        rows = [(a, int(p), float(t[p])) for a, t in totals.items() for p in np.flatnonzero(t)]
        a, p, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(p, pa.int32()), pa.array(n, pa.float64())], names=["lang", "piece", "n"])

    return counts.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Piece probabilities by language."""

    def __init__(self, pieces: list[str], languages: list[str], table: np.ndarray):
        self.pieces, self.languages, self.table = pieces, languages, table
        self.lattice: Lattice | None = None

    def ready(self) -> Model:
        if self.lattice is None:
            self.lattice = Lattice(self.pieces)
            self.columns = [[*column, FLOOR] for column in self.table.T.tolist()]
            self.rows = np.vstack([self.table, np.full(self.table.shape[1], FLOOR)])
            self.known = Evidence(self.weigh, self.table.shape[1] + 1, STORED_EVIDENCE)
            self.known_words = Evidence(self.weigh_words, self.table.shape[1] + 1, STORED_WORDS)
        return self

    def __getstate__(self):
        return {"pieces": self.pieces, "languages": self.languages, "table": self.table, "lattice": None}

    def weigh(self, chunks: list[str]) -> np.ndarray:
        """The evidence of chunks, what stands between blanks: a row per chunk of one number per language and the number of letters; zeros without a letter."""
        words, counts = words_of_all(chunks)
        found, used = np.zeros((len(chunks), self.table.shape[1] + 1)), np.flatnonzero(counts)
        if len(used):
            found[used] = np.add.reduceat(self.known_words.values_of(words, len(words)), (np.cumsum(counts) - counts)[used], axis=0)
        return found

    def weigh_words(self, words: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        logs = np.empty((len(words), self.table.shape[1] + 1))
        logs[:, -1] = sizes
        short = np.flatnonzero(sizes <= SHORT_WORD)
        if len(short):
            logs[short, :-1] = self.lattice.log_probabilities([words[n] for n in short.tolist()], self.rows)
        for n in np.flatnonzero(sizes > SHORT_WORD).tolist():
            logs[n, :-1] = self.lattice.log_probability(words[n], self.columns)
        return logs

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, float]]:
        """Language, its probability, the mean logarithm per letter under it, and the letters, for each text of a batch."""
        return [p for n in range(0, len(texts), TEXTS) for p in self.predict_some(texts[n : n + TEXTS])]

    def predict_some(self, texts: list[str | None]) -> list[tuple[str, float, float | None, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0, None, 0.0)] * len(texts)
        counts = [Counter((text or "").split()) for text in texts]
        # A row per text and distinct chunk of it, summed by text.
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        values = self.known.values_of(chain.from_iterable(counts), int(sizes.sum()))
        values *= np.fromiter(chain.from_iterable(c.values() for c in counts), np.float64, len(values))[:, None]
        sums, used = np.zeros((len(texts), len(self.languages) + 1)), np.flatnonzero(sizes)
        if len(used):
            sums[used] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[used], axis=0)
        letters, evidence = sums[:, -1], sums[:, :-1]
        best = evidence.argmax(axis=1)
        highest = evidence[np.arange(len(texts)), best]
        scores = 1.0 / np.exp((evidence - highest[:, None]) / TEMPER).sum(axis=1)
        fits = highest / np.maximum(letters, 1)
        rows = zip(letters.tolist(), best.tolist(), scores.tolist(), fits.tolist(), strict=True)
        return [(self.languages[n], score, fit, size) if size else (UNKNOWN, 0.0, None, 0.0) for size, n, score, fit in rows]


class Evidence:
    """Rows of numbers by chunk, computed when missed, many chunks at once.

    Once the rows take up ``limit`` bytes, the half of them that was used most is kept.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, limit: int):
        self.compute, self.most = compute, max(1, limit // (ENTRY_BYTES + 8 * width))
        self.places, self.rows, self.uses = numbering(), np.empty((0, width)), np.empty(0, np.int64)

    def values_of(self, chunks: Iterator[str], size: int) -> np.ndarray:
        """A row for each of ``size`` chunks."""
        held = len(self.places)
        at = np.fromiter(map(self.places.__getitem__, chunks), np.int64, size)
        new = list(islice(reversed(self.places), len(self.places) - held))[::-1]
        if new:
            self.room(held + len(new))
            self.rows[held : held + len(new)] = self.compute(new)
        values = self.rows[at]
        self.uses[: len(self.places)] += np.bincount(at, minlength=len(self.places))
        if len(self.places) > self.most:
            self.drop(new)
        return values

    def room(self, needed: int) -> None:
        if needed > len(self.rows):
            size = max(needed, min(2 * needed, self.most))
            self.rows = np.concatenate([self.rows, np.empty((size - len(self.rows), self.rows.shape[1]))])
            self.uses = np.concatenate([self.uses, np.zeros(size - len(self.uses), np.int64)])

    def drop(self, new: list[str]) -> None:
        chunks = list(self.places)
        uses = self.uses[: len(chunks)]
        uses[np.fromiter(map(len, chunks), np.int64, len(chunks)) > STORED_LENGTH] = 0
        keep = np.sort(np.argsort(-uses, kind="stable")[: self.most // 2])
        keep = keep[uses[keep] > 0]
        rows, uses = self.rows[keep], uses[keep] // 2
        self.places = numbering([chunks[n] for n in keep.tolist()])
        self.rows, self.uses = np.empty((0, rows.shape[1])), np.empty(0, np.int64)
        self.room(len(keep))
        self.rows[: len(keep)], self.uses[: len(keep)] = rows, uses


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None) -> Model:
    """Learn from all rows given.  One number per piece and language comes to the driver."""
    pieces = letter_pieces(vocabulary or default_vocabulary())
    found = piece_counts(word_counts(rows, text, lang), pieces).toArrow().to_pydict()
    languages = sorted(set(found["lang"]))
    table = np.full((len(pieces), len(languages)), SMOOTHING)
    place = {a: n for n, a in enumerate(languages)}
    for a, piece, n in zip(found["lang"], found["piece"], found["n"], strict=True):
        table[piece, place[a]] += n
    return Model(pieces, languages, table / np.maximum(table.sum(axis=0), 1e-300))


def identify(rows: DataFrame, model: Model, text: str = "text", fit: str | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the probability of that language among those learned.

    ``fit`` names a further column: the mean logarithm of the text's probability per letter under that language.  It does not
    depend on how many languages there are; a text in none of them has a low one.  With it comes ``letters``, their number.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work():
        ready = kept_by_worker("langid", sent.value, sent.value.ready)  # with the evidence of known chunks, from task to task

        def apply(texts: pa.Array) -> list[list]:
            parts = zip(*ready.predict(texts.to_pylist()), strict=True) if len(texts) else [()] * 4
            return [list(part) for part in parts][: len(made)]

        return apply

    made = {"lang_pred": T.StringType(), "score": T.DoubleType(), **({fit: T.DoubleType(), "letters": T.DoubleType()} if fit else {})}
    return with_computed(rows, text, made, work)


def least_fits(rows: DataFrame, model: Model, text: str = "text", lang: str = "lang", margin: float = MARGIN) -> dict[str, float]:
    """``least_fits_of`` texts that are not identified yet."""
    given = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    return least_fits_of(identify(given, model, "text", "fit"), margin=margin)


def least_fits_of(identified: DataFrame, lang: str = "lang", fit: str = "fit", margin: float = MARGIN) -> dict[str, float]:
    """Per language the fit below which a long text is of none: ``margin`` below the median of the texts found to be in their own language.

    A median is not moved by odd texts.  It is that of all texts, whose fits are taken to three places so that a task holds few different ones.
    One number per language comes to the driver.
    """
    own = identified.where(F.col("lang_pred") == F.col(f"`{lang}`").cast("string"))
    own = own.select("lang_pred", F.round(F.col(f"`{fit}`"), 3).alias("fit"))
    rows = own.groupBy("lang_pred").agg(F.expr("percentile_disc(0.5) within group (order by fit)").alias("middle")).collect()
    return {r["lang_pred"]: r["middle"] - margin for r in rows}


def of_a_language(lang_pred: Column, fit: Column, letters: Column, least: dict[str, float]) -> Column:
    """Whether a text has a language: one was found, and the text fits it as its texts do."""
    enough = F.lit(False)
    for lang, value in sorted(least.items()):
        enough = F.when(lang_pred == lang, fit >= value - MARGIN_OF_SHORT / F.sqrt(letters)).otherwise(enough)
    return F.coalesce((lang_pred != UNKNOWN) & enough, F.lit(False))


def sampled(
    documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE
) -> DataFrame:
    """At most ``per_language`` documents of each language that are not held out, those of the least hashes of their ids.

    Hashes are first counted in bins by their leading bits, which tells per language up to which bin the sample reaches;
    so only the sample and the rest of one bin are ranked, however large a language is.  The ids of the sample are
    at most ``SAMPLE_IDS``, so they are broadcast; texts do not move.
    """
    known = given_to_learn(documents, lang, doc_id)
    known = known.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{lang}`").alias("_lang")).distinct()
    known = known.withColumn("_hash", F.xxhash64("_id")).withColumn("_bin", F.shiftright("_hash", 64 - BIN_BITS))
    bins = known.groupBy("_lang", "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_lang").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reached = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < per_language)
    last = reached.groupBy(F.col("_lang").alias("_of")).agg(F.max("_bin").alias("_last"))
    # A row per language; the driver holds a column of the model for each.
    near = known.join(F.broadcast(last), (F.col("_lang") == F.col("_of")) & (F.col("_bin") <= F.col("_last")))
    turn = Window.partitionBy("_lang").orderBy("_hash", "_id")
    near = near.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= per_language)
    chosen = near.orderBy("_turn", "_lang").limit(SAMPLE_IDS).select("_id").distinct()
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias(text), F.col(f"`{lang}`").alias(lang))
    return rows.join(F.broadcast(chosen), "_id", "left_semi")


def given_to_learn(documents: DataFrame, lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """All rows that have a language and are not held out."""
    return documents.where((fold(f"`{doc_id}`") != 0) & F.col(f"`{lang}`").isNotNull())


def learn_from_documents(
    documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int | None = None
) -> Model:
    """Learn from all documents ``given_to_learn``, or from ``sampled`` ones with a number ``per_language``."""
    rows = given_to_learn(documents, lang, doc_id) if per_language is None else sampled(documents, text, lang, doc_id, per_language)
    return learn(rows, text, lang)

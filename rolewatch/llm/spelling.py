"""Spelling variants by asymmetric chunks and grams.

Two words are near if one edit, a code point inserted, deleted or replaced, leads from one to the other.  Of two words the longer one (either, if
equally long) contributes two disjoint chunks, its first and its last half; the other contributes its positional grams of the chunk's length that
start within one place of a chunk.  One edit leaves one of the chunks whole and moves it by one place at most, so near words meet at a
chunk with equal text whose places differ by one at most.  What has met is verified by edit distance.

A chunk that very many words share would bring too many together.  Its words are asked for a second chunk in what is left of them, and so
on: as one edit is all there is, what is left beside a whole chunk is again one edit apart, at the same end of the word.  Each step halves what is left, so
the number of steps is the logarithm of a word's length, and what still meets after the last one differs in one place: at most an alphabet of words.

Words are counted before they meet: a word has one row however often it occurs.  Each word's form is its near word of the largest count, if that is
large enough; the root follows forms to the last, by doubling, as counts grow from form to form.

Results: a null text has no words; a null id is written as an empty one; an empty table gives an empty one; ties of forms go to the first in
code-point order; repeated rows are counted as often as given.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
RUN = "[A-Za-zÀ-ÿ]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One of so many occurrences, by hash, loses a code point.
DAMAGED = 31
#: Words with one chunk, beyond which they are asked for a second one.
CROWD = 256


def damaged(doc_id: Column, word: Column, one_in: int = DAMAGED) -> Column:
    """The word, without one code point if the hash of the id and the word is divisible by ``one_in``."""
    key = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    place = F.pmod(key, F.length(word)).cast("int")
    return F.when(key % one_in == 0, F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))).otherwise(word)


def vocabulary(
    rows: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int | None = None
) -> DataFrame:
    """``word, n``: how often each long enough word occurs in all texts; with ``one_in``, some occurrences are damaged first."""
    # A run of fewer code points gives no word, so only longer ones are taken out; each match is a whole run.
    runs = F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"{RUN}{{{least_length},}}+"), F.lit(0))
    found = rows.select(F.col(f"`{doc_id}`").alias("_id"), F.explode(runs).alias("_run"))
    lower = F.translate("_run", CAPITALS, CAPITALS.lower())
    word = lower if one_in is None else damaged(F.col("_id"), lower, one_in)
    counted = found.select(word.alias("word")).where(F.length("word") >= least_length)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def part(word: Column, start: Column, length: Column) -> Column:
    """``length`` code points from place ``start``, counted from 0."""
    return F.substring(word, start + 1, length)


def chunks(words: DataFrame) -> DataFrame:
    """``long, chunk, place, word``: the two chunks of each word; ``long`` is the length of the word that is cut in chunks."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    rows = [F.struct(part(F.col("word"), p, half).alias("chunk"), p.alias("place")) for p in (F.lit(0), size - half)]
    return words.select("word", size.alias("long"), F.explode(F.array(*rows)).alias("_c")).select("long", "_c.*", "word")


def grams(words: DataFrame) -> DataFrame:
    """``long, chunk, place, word``: each word's positional grams that lie within one place of a chunk of a word as long, or longer by one."""
    size = F.length("word")
    given = words.select("word", F.explode(F.array(size, size + 1)).alias("long")).withColumn("half", F.floor(F.col("long") / 2).cast("int"))
    last = F.col("long") - F.col("half")
    places = F.array_distinct(F.array(F.lit(0), F.lit(1), last - 1, last, last + 1))
    fitting = F.filter(places, lambda p: p + F.col("half") <= F.length("word"))
    return given.select("long", "half", "word", F.explode(fitting).alias("place")).select(
        "long", part(F.col("word"), F.col("place"), F.col("half")).alias("chunk"), "place", "word"
    )


def near(a: str, b: str) -> Column:
    """Whether two different words are one edit apart."""
    return (F.col(a) != F.col(b)) & (F.levenshtein(a, b, 1) >= 0)


def met(longer: DataFrame, shorter: DataFrame, keys: list[str], placed: Column) -> DataFrame:
    """Verified pairs ``a, b`` of words that meet at equal ``keys``; of two words of one length the first in order is ``a``."""
    left = longer.select(*keys, F.col("place").alias("_place"), F.col("word").alias("a"))
    right = shorter.select(*keys, "place", F.col("word").alias("b"))
    pairs = left.join(right, keys).where(placed & ((F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))))
    return pairs.where(near("a", "b")).select("a", "b")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, b``: every pair of near words, once; from distinct ``word``."""
    longer, shorter = chunks(words), grams(words)
    keys = ["long", "chunk"]
    within_one = F.abs(F.col("place") - F.col("_place")) <= 1
    crowded = cut(longer.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*keys))
    found = [met(longer.join(crowded, keys, "left_anti"), shorter, keys, within_one)]
    # Words of crowded chunks: what is left of them beside the chunk, which a near word shares at the same end.
    at_start = F.col("place") == 0
    both = []
    for rows, size in ((longer, F.col("long")), (shorter, F.length("word"))):
        half = F.length("chunk")
        rest = F.when(at_start, F.substring(F.col("word"), half + 1, size)).otherwise(F.substring("word", F.lit(1), F.col("place")))
        ends = at_start | (F.col("place") + half == size)
        path = F.concat(F.when(at_start, F.lit("<")).otherwise(F.lit(">")), F.col("chunk"))
        both.append(rows.where(ends).join(crowded, keys, "left_semi").select(path.alias("path"), (F.col("long") - half).alias("left"), rest.alias("rest"), "word"))
    longer, shorter = map(cut, both)
    keys = ["path", "left"]
    while not longer.isEmpty():
        longer, shorter = halved(longer), halved(shorter)
        crowded = cut(longer.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > crowd) & (F.col("left") > 1)).select(*keys))
        alone = longer.join(crowded, keys, "left_anti")
        found.append(met(alone.withColumn("place", F.lit(0)), shorter.withColumn("place", F.lit(0)), keys, F.lit(True)))
        longer, shorter = cut(longer.join(crowded, keys, "left_semi")), cut(shorter.join(crowded, keys, "left_semi"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def halved(rows: DataFrame) -> DataFrame:
    """The next chunks, at the start and at the end of what is left: half of what is left of the longer word."""
    half = F.floor(F.col("left") / 2).cast("int")
    size = F.length("rest")
    first = F.struct(
        F.concat("path", F.lit("<"), part(F.col("rest"), F.lit(0), half)).alias("path"), (F.col("left") - half).alias("left"), F.substring(F.col("rest"), half + 1, size).alias("rest")
    )
    last = F.struct(
        F.concat("path", F.lit(">"), part(F.col("rest"), size - half, half)).alias("path"), (F.col("left") - half).alias("left"), F.substring("rest", F.lit(1), size - half).alias("rest")
    )
    fits = size >= half
    return rows.where(fits).select(F.explode(F.array(first, last)).alias("_c"), "word").select("_c.*", "word")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, n, n_near, form_n`` of every word."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    # The largest count, then the first word in order.
    ranked = F.struct((-F.col("m")).alias("down"), F.col("b").alias("other"))
    best = both.join(counts, "b").groupBy(F.col("a").alias("_of")).agg(F.count("*").alias("n_near"), F.min(ranked).alias("best"))
    large = -F.col("best.down") >= times * F.col("n")
    return words.join(best, F.col("word") == F.col("_of"), "left").select(
        "word",
        F.when(large, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, -F.col("best.down")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: each round doubles how far they look."""
    now = cut(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("_beyond"))
        moved = cut(now.join(next_, "root", "left"))
        now = moved.select("word", F.coalesce("_beyond", "root").alias("root"))
        if moved.where(F.col("_beyond").isNotNull()).isEmpty():
            return now


def group_variants(
    rows: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    one_in: int | None = None,
    crowd: int = CROWD,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every long and frequent enough word of all texts."""
    words = cut(vocabulary(rows, text, doc_id, least_length, least_count, one_in))
    found = cut(forms(words, near_pairs(words.select("word"), crowd), times))
    last = roots(found).withColumnRenamed("word", "_of")
    return found.join(last, F.col("word") == F.col("_of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

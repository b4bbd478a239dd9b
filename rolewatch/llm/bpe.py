"""Byte-level BPE: exact merges in linear time by backtracking, and decoding with an offset table.

Encoding takes the longest vocabulary token at a position (an Aho-Corasick automaton over the
vocabulary) and keeps it if it is compatible with the token before it; else it tries the next shorter
token that is a prefix, and steps back when there is none.  A position found to be a dead end is never
tried again, so each position is left at most once.  Two neighbours are compatible if merging their
joint bytes in rank order gives these two tokens; a sequence of pairwise compatible tokens is exactly
what the merges give.

Results: a null or empty text has no ids and decodes to an empty text; the text of a special token is that token.
Repeated rows stay repeated; other columns pass, but for one with the name of a new column, which is replaced.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Recent, kept_by_worker, list_array, lists_of, with_computed

#: Fixed values of the format: how texts are split before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pairs whose compatibility a worker keeps, some 100 bytes each; the table starts anew beyond it.
CACHED_PAIRS = 250_000
NEVER = 1 << 60
#: Bytes of ids of chunks after a blank that a worker holds.
STORED_CHUNKS = 48 << 20
#: A longer piece is scanned once for all its matches.
LONG_PIECE = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    moved = {b: 0x100 + n for n, b in enumerate(rest)}
    return [chr(moved.get(b, b)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks, the automaton, the pair table and the offset table of one vocabulary file."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        letters = byte_letters()
        self.to_letters = {b: letter for b, letter in enumerate(letters)}
        as_byte = {letter: b for b, letter in enumerate(letters)}
        ids = data["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.size = len(ids)
        self.length = [0] * (max(ids.values()) + 1)
        #: the longest token that is a proper prefix of a token; -1 if there is none
        self.shorter = [-1] * len(self.length)
        for token, i in ids.items():
            self.length[i] = len(token)
            self.shorter[i] = next((ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ids), -1)
        #: rank of merging two ids; the parts and rank from which an id is made
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.parts.setdefault(ids[a + b], (ids[a], ids[b], r))
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        stored = {**{i: bytes(as_byte[c] for c in token) for token, i in ids.items()}, **{i: t.encode() for t, i in self.special.items()}}
        sizes = np.zeros(max(stored) + 2, np.int64)
        for i, value in stored.items():
            sizes[i + 1] = len(value)
        self.offsets = np.cumsum(sizes)
        self.bytes = np.frombuffer(b"".join(stored[i] for i in sorted(stored)), np.uint8)
        self.piece = Recent(self.merge, repeated=True)
        self.first = Recent(lambda chunk: self.chunk(chunk, ""))
        self.later = Recent(lambda chunk: self.chunk(chunk, " "), STORED_CHUNKS, repeated=True)
        self.newline = self.pieces_ids("\n")

    # -- encoding

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that touch one edge (side 0: left, 1: right) while ``token`` grows, each with the rank that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            known, ends = [(token, NEVER)], self.parts.get(token)
            while ends:
                known.append((ends[side], ends[2]))
                ends = self.parts.get(ends[side])
            self.spines[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens gives these two tokens.

        It does not if, at some moment, the parts at the seam merge with each other first.  Of equal
        ranks the leftmost goes first.  Answers are kept in the pair table.
        """
        rank, seam = self.rank, self.spine(right, 0)
        known = True
        for a, until_a in self.spine(left, 1):
            for b, until_b in seam:
                at = rank.get(a << 32 | b)
                if at is not None and at < until_a and at <= until_b:
                    known = False
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = known
        return known

    def longest_matches(self, letters: str) -> list[int]:
        """The longest token from each position, in one scan; short pieces look up only the positions they reach."""
        found, length = [0] * len(letters), self.length
        for end, token in self.automaton.iter(letters):  # a later match from the same start is a longer one
            found[end + 1 - length[token]] = token
        return found

    def merge(self, piece: str) -> bytes:
        """Ids of one piece of a text, as int32 bytes."""
        letters = piece.encode().decode("latin-1").translate(self.to_letters)
        total = len(letters)
        length, shorter, pairs = self.length, self.shorter, self.pairs
        scan = self.automaton.iter_long
        longest = self.longest_matches(letters) if total > LONG_PIECE else None
        out: list[int] = []
        dead: set[int] = set()
        at, token, before = 0, longest[0] if longest else next(scan(letters))[1], -1
        while True:
            end = at + length[token]
            if end not in dead:
                known = before < 0 or pairs.get(before << 32 | token)
                if self.compatible(before, token) if known is None else known:
                    out.append(token)
                    if end == total:
                        return array("i", out).tobytes()
                    at, before = end, token
                    token = longest[at] if longest else next(scan(letters, at))[1]
                    continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                before = out[-1] if out else -1

    def pieces_ids(self, text: str) -> bytes:
        store = self.piece
        return b"".join([store[piece] for piece in PIECES.findall(text)])

    def chunk(self, chunk: str, lead: str) -> bytes | None:
        """Ids of what stands between two breaks; None where white space touches a break, as it then belongs together."""
        if chunk.isalpha():
            return self.merge(lead + chunk)
        odd = not chunk or chunk[0].isspace() or chunk[-1].isspace()
        return None if odd else self.pieces_ids(lead + chunk)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as int32 bytes.

        A single blank or line feed between two visible characters always separates pieces, so texts are
        cut there and equal chunks are encoded once.  Other white space sends the text through whole.
        """
        first, later = self.first, self.later
        out: list[bytes | None] = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.newline)
            out.append(first[head])
            out += [later[chunk] for chunk in rest]
        return self.pieces_ids(text) if None in out else b"".join(out[1:])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.marks is None or not self.marks.search(text):
            return np.frombuffer(self.plain(text), np.int32)
        parts = [
            np.array([self.special[part]], np.int32).tobytes() if part in self.special else self.plain(part)
            for part in self.marks.split(text)
            if part
        ]
        return np.frombuffer(b"".join(parts), np.int32)

    # -- decoding

    def decode(self, ids) -> str:
        """The text of ids: each id's bytes are copied from one store by its offsets.  Bytes that are no UTF-8 become U+FFFD; unknown ids are left out."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return ""
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.bytes[where].tobytes().decode("utf-8", "replace")


def vocabulary_of(content: bytes) -> Vocabulary:
    """The vocabulary, made once per worker process for as long as the worker serves this operator."""
    return kept_by_worker("bpe", content, lambda: Vocabulary(content))


@lru_cache(maxsize=4)
def file_content(path: str) -> bytes:
    return Path(path).read_bytes()


def encode_texts(
    rows: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, vocabulary: str | None = None
) -> DataFrame:
    """Add ``ids``: the token ids of every whole text; with ``decoded``, a column of that name with what they decode to.

    ``vocabulary`` is the path of the vocabulary file on the driver; its content, of fixed size, is sent to the workers.
    Decoding in the same pass saves each task a second Python worker.
    """
    content = rows.sparkSession.sparkContext.broadcast(file_content(vocabulary or default_vocabulary()))
    made = {ids: T.ArrayType(T.IntegerType()), **({decoded: T.StringType()} if decoded else {})}

    def work():
        coder = vocabulary_of(content.value)

        def apply(texts: pa.Array) -> list:
            found = [coder.encode(x) for x in texts.to_pylist()]
            return [list_array(found), *([[coder.decode(x) for x in found]] if decoded else [])]

        return apply

    return with_computed(rows, text, made, work)


def decode_ids(rows: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add ``text``: what the ids stand for, special tokens included.  Null ids give an empty text."""
    content = rows.sparkSession.sparkContext.broadcast(file_content(vocabulary or default_vocabulary()))

    def work():
        decoder = vocabulary_of(content.value)
        return lambda lists: [[decoder.decode(x) for x in lists_of(lists)]]

    return with_computed(rows, ids, {text: T.StringType()}, work)

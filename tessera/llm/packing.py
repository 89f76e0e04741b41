"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Lengths fall into reciprocal classes: class ``k`` holds pieces longer than
``C / (k + 1)`` and at most ``C / k``, and each of its bins takes exactly ``k``
pieces. A document longer than the capacity gives whole sequences and a rest.
A rest that would waste more than ``WASTE`` of its slot is cut at the next
smaller slot size, at most ``CUTS`` times, so its parts fill their slots.

The texts never move: tokenising is one pass that emits a narrow row per piece.
Pieces are then dealt by hash to workers of about ``WORKER_PIECES`` pieces, and
every worker fills its bins independently. Bins that a worker cannot fill (fewer
than ``k`` pieces left in a class, a number bounded by the classes alone) are
filled best-fit, longest piece first.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_text, map_partitions, ship_by_value

CAPACITY, WASTE, CUTS = 2048, 1 / 32, 2
WORKER_PIECES = 16_384
#: Words a task keeps encoded.
HELD = 500_000
BLOCK = 1 << 20
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch


def piece_lengths(n: int, capacity: int = CAPACITY, waste: float = WASTE, cuts: int = CUTS) -> list[int]:
    """Lengths of the pieces a document of ``n`` ids is cut into, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    for _ in range(cuts):
        k = capacity // rest if rest else 0
        if not rest or (capacity // k - rest) <= waste * (capacity // k):
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out + [rest] if rest else out


def _words(text: str) -> Iterator[list[str]]:
    """Parts that the tokeniser treats alone (blanks and line feeds part words and are dropped)."""
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > BLOCK:
            cuts = [x for x in (text.find(" ", at + BLOCK), text.find("\n", at + BLOCK)) if x >= 0]
            to = min(cuts, default=to)
        yield text[at:to].replace("\n", " ").split(" ")
        at = to


def stem_and_marks(word: str) -> tuple[str, str]:
    """A word as (stem, trailing marks) whose ids, one after the other, are the word's.

    The tokeniser parts letters and digits from marks and lower-cases, so marks
    after a letter or digit stand alone, and letters below U+0250 (save the one
    whose lower case is two characters) may be lower-cased first."""
    stem = word.rstrip(".,;:!?")
    if not stem or not stem[-1].lower()[-1].isalnum():
        return word, ""
    return (stem.lower() if _LATIN(stem) else stem), word[len(stem):]


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other
    bytes take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class Words:
    """Ids of single words. A stem of Latin letters is one pre-token whatever stands around it, so
    the library's merges are applied to it directly; any other word takes the whole path."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.bytes = byte_alphabet()
        self.marks: dict[str, bytes] = {}

    def other(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, word: str) -> bytes:
        stem, marks = stem_and_marks(word)
        if not _LATIN(stem):
            return self.other(word)
        letters = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.bytes)
        ids = array("I", [t.id for t in self.merge(letters)]).tobytes()
        if marks:
            if marks not in self.marks:
                if len(self.marks) >= 1000:
                    self.marks.clear()
                self.marks[marks] = self.other(marks)
            ids += self.marks[marks]
        return ids


def document_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every document."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Words(tokenizer_path).ids
        known: dict[str, bytes] = {}

        def ids_of(text: str) -> bytes:
            nonlocal known
            parts = []
            for words in _words(text):
                missing = set(words).difference(known)
                if missing:
                    if len(known) + len(missing) > HELD:
                        known, missing = {}, set(words)
                    known.update((w, encode(w)) for w in missing)
                parts.append(b"".join(map(known.__getitem__, words)))
            parts.append(np.array([end_id], "<u4").tobytes())
            return b"".join(parts)

        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data, at = memoryview(ids_of(text)), 0
                n = len(data) // 4
                for length in piece_lengths(n, capacity):
                    crc = zlib.crc32(data[4 * at:4 * (at + length)])
                    for col, v in zip(cols, (doc, at, length, crc, n)):
                        col.append(v)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_partitions(id_text(docs, id_col, text_col), cut,
                          "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill_bins(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: full bins of each class, the rest best-fit."""
    k = capacity // length
    order = np.argsort(k, kind="stable")
    ks = k[order]
    first = np.searchsorted(ks, ks)
    in_class = np.arange(len(ks)) - first
    size = np.searchsorted(ks, ks, side="right") - first
    full = in_class < size // ks * ks
    bins, offset = np.full(len(ks), -1, np.int64), np.zeros(len(ks), np.int64)
    # full bins: every ks-th piece of a class opens one
    opens = full & (in_class % ks == 0)
    number = np.cumsum(opens) - 1
    bins[order[full]] = number[full]
    ends = np.cumsum(np.where(full, length[order], 0))
    begin = ends - length[order]
    offset[order[full]] = (begin - begin[np.flatnonzero(opens)][number])[full] if opens.any() else 0
    n_bins = int(opens.sum())
    # what is left of the classes, longest first into the fullest bin with room
    left = order[~full]
    room: list[tuple[int, int]] = []
    for i in left[np.argsort(-length[left], kind="stable")].tolist():
        need = int(length[i])
        j = bisect_left(room, (need, -1))
        if j < len(room):
            free, b = room.pop(j)
        else:
            free, b = capacity, n_bins
            n_bins += 1
        bins[i], offset[i] = b, capacity - free
        if free > need:
            insort(room, (free - need, b))
    return bins, offset


def harmonic_pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length.

    A document is its ids and then ``end_id``; every id lies in exactly one
    piece, and the pieces of a sequence follow each other from offset 0.
    ``padded_length`` is the capacity, or the ids held if their number is a
    power of two. Null or empty text: one piece, the end id alone. Null ids
    and repeated rows are documents of their own. Empty table: no rows."""
    pieces = cut_lineage(document_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col))
    workers = max(1, -(-pieces.count() // WORKER_PIECES))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32")])
        length = group.column("length").to_numpy()
        bins, offset = fill_bins(length, capacity)
        held = np.bincount(bins, weights=length).astype(np.int64)[bins]
        worker = group.column("worker").to_numpy()
        for name, col in (("sequence_id", (worker << 32) + bins), ("offset", offset),
                          ("padded_length", np.where(held & (held - 1) == 0, held, capacity))):
            group = group.append_column(name, pa.array(col, pa.int64()))
        return group.drop_columns(["worker"])

    # dealt by the row itself: repeated rows are spread like all others
    dealt = pieces.withColumn("worker", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(workers)))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long, padded_length long")
    return dealt.groupBy("worker").applyInArrow(fill, schema)


ship_by_value(__name__)

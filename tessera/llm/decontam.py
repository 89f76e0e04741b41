"""Benchmark decontamination by greedy string tiling.

Seeds are windows of ``MIN_MATCH`` tokens that a document and a benchmark item
share, found by a rolling Karp-Rabin hash. Where the seeds could cover enough of an
item, greedy string tiling marks the longest common run of unmarked tokens again and
again, and the share of the item's tokens that lie in tiles is its coverage. Tiles may
lie anywhere in the document, so passages whose parts were reordered or taken apart are
found. The longest run is found by running Karp-Rabin over window lengths: hashes of all
unmarked windows of a length on both sides, met by sorting, halving the range of lengths.
Pairs of equal windows are never written out, so repetitive texts cost no more than
others. Every tile is checked token by token.

Documents are read once per block of items and never move. A block holds at
most ``BLOCK_CHARS`` characters of items (or one longer item), which bounds what
is broadcast; a larger benchmark makes more blocks, not a larger broadcast.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import held, id_text, map_partitions, share, ship_by_value

MIN_MATCH, COVERAGE = 5, 0.6
BLOCK_CHARS = 16 << 20
_BASE = 0x9E3779B97F4A7C15
_TOKEN = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def window_hashes(ids: np.ndarray, m: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``m`` ids, modulo 2**64."""
    h = np.zeros(max(len(ids) - m + 1, 0), np.uint64)
    for j in range(m if len(h) else 0):
        h = h * np.uint64(_BASE) + ids[j:j + len(h)].astype(np.uint64)
    return h


@dataclass
class Seeds:
    """A block of benchmark items: their words numbered from 1, and the hashes of their windows, by
    window length. An item shorter than ``m`` has one window, itself."""

    words: dict[str, int]
    item_id: list
    ids: list[np.ndarray]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]   # length: hashes (sorted), item, place
    m: int

    @classmethod
    def of(cls, items: list[tuple[int, str]], m: int) -> Seeds:
        words: dict[str, int] = {}
        ids = [np.array([words.setdefault(w, len(words) + 1) for w in tokens(text)], np.int64) for _, text in items]
        windows = {}
        for size in sorted({min(m, len(x)) for x in ids if len(x)}):
            own = [i for i, x in enumerate(ids) if min(m, len(x)) == size]
            hashes = [window_hashes(ids[i], size) for i in own]
            item = np.repeat(np.array(own, np.int64), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            windows[size] = flat[order], item[order], place[order]
        return cls(words, [i for i, _ in items], ids, windows, m)

    def shared(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, items, places in them) of the items' windows that the document holds. Each
        is named once however often the document holds it."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (hashes, item, place) in self.windows.items():
            h = window_hashes(ids, size)
            if not len(h):
                continue
            h = np.unique(h[unknown[size:] == unknown[:-size]])      # windows of known words only
            low = np.searchsorted(hashes, h)
            n = np.searchsorted(hashes, h, side="right") - low
            entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            yield size, item[entry], place[entry]


class Windows:
    """Hashes of the windows of any one length of a sequence, from its running sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))))
        # ids are spread over 64 bits first
        x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(x * power[:n])))
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        self.back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), inverse, np.uint64))))
        self.marked = np.zeros(n + 1, np.int64)       # running count of marked places

    def mark(self, places: list[tuple[int, int]]) -> None:
        taken = np.diff(self.marked)
        for at, length in places:
            taken[at:at + length] = 1
        self.marked[1:] = np.cumsum(taken)

    def free(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of the windows without a marked place."""
        at = np.flatnonzero(self.marked[length:] == self.marked[:-length])
        return (self.sums[at + length] - self.sums[at]) * self.back[at], at


def tiling(item: np.ndarray, doc: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the item, place in the document, length), longest first, at
    ties the earliest in the item and then in the document. Ids of 0 match nothing."""
    a, b = Windows(item), Windows(doc)
    b.mark([(int(i), 1) for i in np.flatnonzero(doc == 0)])
    found, most = [], min(len(item), len(doc))
    while most >= m:
        low, high = m - 1, most                       # a common window of length low, none above high
        while low < high:
            mid = (low + high + 1) // 2
            if len(np.intersect1d(a.free(mid)[0], b.free(mid)[0])):
                low = mid
            else:
                high = mid - 1
        if low < m:
            break
        laid = _lay(item, doc, a, b, low)
        found += [(p, d, low) for p, d in laid]
        a.mark([(p, low) for p, _ in laid])
        b.mark([(d, low) for _, d in laid])
        most = low if laid else low - 1
    return found


def _lay(item: np.ndarray, doc: np.ndarray, a: Windows, b: Windows, length: int) -> list[tuple[int, int]]:
    """Tiles of one length, the greatest there is, in order of the item and then of the document."""
    ha, pa_ = a.free(length)
    hb, pb = b.free(length)
    order = np.argsort(hb, kind="stable")
    hb, pb = hb[order], pb[order]
    low = np.searchsorted(hb, ha)
    high = np.searchsorted(hb, ha, side="right")
    reached: dict[int, int] = {}                      # start of a run of equal hashes: next place to try
    laid, item_end, taken = [], -1, []
    for p, s, e in zip(pa_[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
        if p < item_end:
            continue
        i = reached.get(s, s)
        while i < e:
            d = int(pb[i])
            i += 1
            if _meets(taken, d, length):
                continue
            if np.array_equal(item[p:p + length], doc[d:d + length]):
                insort(taken, d)
                laid.append((p, d))
                item_end = p + length
                break
        reached[s] = i
    return laid


def _meets(taken: list[int], at: int, length: int) -> bool:
    """Whether [at, at + length) meets one of the sorted tiles of the same length."""
    i = bisect_left(taken, at)
    return (i < len(taken) and taken[i] < at + length) or (i > 0 and taken[i - 1] + length > at)


def contamination(text: str, seeds: Seeds, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(item index, tiles, covered tokens, item tokens) of the items that the text covers."""
    get = seeds.words.get
    ids = np.array([get(w, 0) for w in tokens(text)], np.int64)
    for size, item, place in seeds.shared(ids):
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        for i, p in zip(item[first].tolist(), np.split(place, first[1:])):
            own = seeds.ids[i]
            reach = np.zeros(len(own) + 1, np.int64)
            np.add.at(reach, p, 1)
            np.add.at(reach, p + size, -1)
            if np.count_nonzero(np.cumsum(reach)) < coverage * len(own):
                continue                                # even overlapping seeds cover too little
            laid = tiling(own, _near(ids, own, size), size)
            covered = sum(n for _, _, n in laid)
            if covered >= coverage * len(own):
                yield i, len(laid), covered, len(own)


def _near(ids: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """The parts of the document that windows of the item cover, in order, with a 0 between."""
    hit = np.flatnonzero(np.isin(window_hashes(ids, size), window_hashes(own, size)))
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + size, -1)
    inside = np.cumsum(covered[:-1]) > 0
    # a place just before a part stands for the gap
    gap = ~inside & np.append(inside[1:], False)
    return np.where(inside, ids, 0)[inside | gap]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, m: int) -> Iterator:
    """Broadcast seeds of consecutive blocks of items."""
    items = id_text(benchmark, id_col, text_col).withColumnRenamed("doc_id", "item_id")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-2 * total // BLOCK_CHARS))
    for b in range(n_blocks):
        rows = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
                .distinct().collect())
        block = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r))
        yield share(benchmark.sparkSession, Seeds.of(block, m))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE,
                 min_match: int = MIN_MATCH, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item it covers: doc_id, item_id, n_tiles, covered, item_words, coverage.

    Tokens are lower-cased word runs; ``coverage`` is the least share of the
    item's tokens in tiles of at least ``min_match`` tokens. An item with fewer
    tokens is matched as a whole; one without tokens matches nothing. Null texts are
    empty and match nothing; null ids are returned as null; repeated documents give repeated
    rows, repeated equal items count once. Empty tables: no rows."""
    docs = id_text(docs, id_col, text_col)

    def pairs(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = held(shared)
            for batch in batches:
                rows = [(doc, seeds.item_id[i], t, c, n, c / n)
                        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                        for i, t, c, n in contamination(text, seeds, coverage)]
                if rows:
                    cols = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array([r[5] for r in rows])],
                        ["doc_id", "item_id", "n_tiles", "covered", "item_words", "coverage"])
        return run

    schema = "doc_id long, item_id long, n_tiles long, covered long, item_words long, coverage double"
    return reduce(DataFrame.union, [map_partitions(docs, pairs(b), schema)
                                    for b in _blocks(benchmark, item_col, item_text_col, min_match)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE,
                      min_match: int = MIN_MATCH, text_col: str = "text") -> DataFrame:
    """The documents that cover no benchmark item, with all their columns; no row moves. Between
    two blocks of items the documents that are left are written below the shared folder, so a
    task holds one block."""
    at = docs.columns.index(text_col)
    spark, first = docs.sparkSession, True

    def clean(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = held(shared)
            for batch in batches:
                yield batch.filter(pa.array([next(contamination(t or "", seeds, coverage), None) is None
                                             for t in batch.column(at).to_pylist()], pa.bool_()))
        return run

    for shared in _blocks(benchmark, "item_id", "text", min_match):
        if not first:
            path = scratch_path(spark, "decontaminated")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
        docs, first = map_partitions(docs, clean(shared), docs.schema), False
    return docs


ship_by_value(__name__)

"""Phrase collocations counted by prefix-free parsing.

Parse: a text's pieces are cut where their words trigger it. A window of
``max_words - 1`` words whose hash is 0 modulo ``PERIOD`` ends a chunk and begins the
next, so neighbouring chunks overlap by that window and every phrase lies whole in the
chunk that holds its first word's place. Copies of a passage parse into the same chunks
whatever stands before them. The distinct chunks of a language with the number of their
occurrences are the dictionary of the parse: the only table that grows with the text.

Count: every distinct chunk is read once and its phrases weigh as much as the chunk
occurs. The places of a chunk's overlap belong to the next chunk, which assigns phrases
in overlaps once. Blocks of words are counted by sorting number keys. What is shuffled is
one row per block and phrase of up to ``max_words - 1`` words; the longest phrases
travel as the counted last words of their first part, and are only laid out where that
part is frequent enough to have frequent phrases at all.

Score: phrases of ``min_count`` or more get the counts of their parts by a join. Parts
that hold at least one of ``HEAVY`` shares of all words are at most ``HEAVY`` for each
phrase length (their counts add up to the number of words), so that table has a bound
and is broadcast; all other parts meet in a shuffle and have few phrases each.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k_per_group
from .common import cut_lineage, map_partitions, ship_by_value, text_of

#: Words of a chunk on average, and at most (runs without a trigger are cut there).
PERIOD, LONGEST = 24, 1024
#: Bytes of text parsed at a time, and words of chunks counted at a time.
SLICE, BLOCK = 1 << 20, 3 << 20
#: Bytes of words a task keeps numbered.
HELD = 32 << 20
HEAVY = 1000
#: Next words of a phrase that a task counts before it gives them out.
MANY = 1 << 20
UNKNOWN = "und"

#: After a chunk that is followed by another in its piece; between chunks laid end to end. No word holds
#: the characters that end pieces, so these cannot be words.
MORE, _NEXT, _TAB = b" .", b",", b"\t"
# FIXED VALUES: where pieces end; a tab parts words as a blank does.
_END, _ENDS = b".", b",;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t", _END * len(_ENDS) + b" ")


class Numbers(dict):
    """Numbers of words in order of appearance, with a hash of each; the ``marks`` come first."""

    def __init__(self, *marks: bytes):
        super().__init__()
        self.marks = marks
        self.clear_all()

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.hashes.append(zlib.crc32(word))
        self.size += len(word) + 100
        return n

    def clear_all(self) -> None:
        self.clear()
        self.hashes, self.size = array("I"), 0
        for mark in self.marks:
            self[mark]

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), "i8", len(words))


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SLICE`` bytes, cut at blanks or ends of pieces."""
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > SLICE:
            cuts = [x for x in (text.find(b" ", at + SLICE), text.find(_END, at + SLICE)) if x >= 0]
            to = min(cuts, default=to)
        yield text[at:to]
        at = to


def chunk_starts(ids: np.ndarray, hashes: np.ndarray, window: int, period: int) -> np.ndarray:
    """Places where a chunk begins: the first word of every piece, and every trigger."""
    n = len(ids)
    word = ids != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    if n >= window:
        h, whole = np.zeros(n - window + 1, "u4"), np.ones(n - window + 1, bool)
        for j in range(window):
            h = h * np.uint32(0x01000193) + hashes[ids[j:n - window + 1 + j]]
            whole &= word[j:n - window + 1 + j]
        h ^= h >> np.uint32(15)
        first[:len(h)] |= whole & ((h * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(period) == 0)
    return np.flatnonzero(first)


def parse(text: bytes, numbers: Numbers, window: int, period: int = PERIOD) -> Iterator[list[bytes]]:
    """The chunks of a text whose pieces end at ``_END``, in order. A chunk that is followed by
    another in its piece ends with the window they share and with ``MORE``."""
    kept: list[bytes] = []           # the chunk that goes on in the next slice
    parts = list(_slices(text))
    for i, part in enumerate(parts):
        if numbers.size > HELD:
            numbers.clear_all()
        words = kept + part.replace(_END, b" . ").split()
        ids = numbers.of(words)
        starts = chunk_starts(ids, np.frombuffer(numbers.hashes, "u4").copy(), window, period)
        ends = np.append(np.flatnonzero(ids == 0), len(ids))
        piece_end = ends[np.searchsorted(ends, starts)]
        to = np.minimum(np.append(starts[1:], len(words)), piece_end)
        # the last chunk is open while its piece goes on in the next slice
        kept = []
        if len(starts) and i + 1 < len(parts) and piece_end[-1] == len(words):
            s = int(starts[-1])
            # of an open chunk whole lengths go out, if the words of their overlap are there
            cut = s + max(0, len(words) - s - window) // LONGEST * LONGEST
            kept, to[-1] = words[cut:], cut
        if len(starts) and int((to - starts).max()) > LONGEST:
            starts, to, piece_end = _cut_long(starts, to, piece_end, window)
        more = (to < piece_end).tolist()
        yield [b" ".join(words[s:e + window]) + MORE if m else b" ".join(words[s:e])
               for s, e, m in zip(starts.tolist(), to.tolist(), more) if e > s]


def _cut_long(starts: np.ndarray, to: np.ndarray, piece_end: np.ndarray, window: int):
    """Chunks longer than ``LONGEST`` are cut there, as long as a whole overlap follows."""
    out: list[tuple[int, int, int]] = []
    for s, t, e in zip(starts.tolist(), to.tolist(), piece_end.tolist()):
        while t - s > LONGEST and s + LONGEST + window <= e:
            out.append((s, s + LONGEST, e))
            s += LONGEST
        out.append((s, t, e))
    return tuple(np.array(x, "i8") for x in zip(*out))


def dictionary(docs: DataFrame, max_words: int = 3, period: int = PERIOD, lang_col: str = "lang",
               text_col: str = "text") -> DataFrame:
    """(chunk, n): the distinct chunks of the parse and how often each occurs. The language stands before
    the chunk and a tab (no word holds one): a column less in every row that is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(_END)
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                found: Counter = Counter()
                held = 0
                # texts of a language are parsed end to end, as pieces of one
                whole = _END.join(t for t, x in zip(texts, langs) if x == lang)
                for chunks in parse(whole.translate(_TABLE).lower(), numbers, max_words - 1, period):
                    found.update(chunks)
                    held += SLICE
                    if held >= 16 * SLICE:
                        yield rows(lang, found)
                        found, held = Counter(), 0
                if found:
                    yield rows(lang, found)

    def rows(lang: str, found: Counter) -> pa.RecordBatch:
        head = lang.encode() + _TAB
        return pa.RecordBatch.from_arrays(
            [pa.array([head + c for c in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["chunk", "n"])

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        text_of(text_col).cast("binary").alias("text"))
    return map_partitions(texts, run, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


class Block:
    """Chunks laid end to end: word numbers, where each place's chunk and its own places end, and how
    often it occurs."""

    def __init__(self, window: int):
        self.window = window
        self.numbers = Numbers(_NEXT, MORE.strip())
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = 0

    def add(self, chunks: list[bytes], times: list[int]) -> None:
        ids = self.numbers.of((b" , ".join(chunks) + b" ,").split())
        sep = np.flatnonzero(ids == 0)
        more = ids[sep - 1] == 1
        begin, end = np.append(0, sep[:-1] + 1), sep - more
        size = end - begin
        keep = ids > 1
        first = self.words + np.cumsum(size) - size
        self.parts.append((ids[keep], np.repeat(first + size, size), np.repeat(first + size - more * self.window, size),
                           np.repeat(np.array(times, "i8"), size)))
        self.words += int(size.sum())

    def counts(self, max_words: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array | None]]:
        """(phrases, counts, tails) for phrases of 1 to ``max_words - 1`` words; the tails of the longest
        of them are their next words, ``word`` or ``word:count``, joined by commas."""
        ids, ends, own_to, weight = (np.concatenate(x) for x in zip(*self.parts))
        forms = pa.array(list(self.numbers), pa.binary())
        place = np.flatnonzero(np.arange(len(ids)) < own_to)
        key, total, last = ids[place], len(self.numbers), None
        for k in range(1, max_words + 1):
            if k > 1:
                # the prefix counts as its rank, so that keys of any length stay below 2**63
                fits = place + k <= ends[place]
                place, key = place[fits], rank[fits]
                key = key * total + ids[place + k - 1]
            order = np.argsort(key)
            ordered = key[order]
            heads = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(key) else np.zeros(0, "i8")
            counts = np.add.reduceat(weight[place[order]], heads) if len(heads) else heads
            if k == max_words:
                # distinct (prefix, last word) in order of the prefix
                prefix = ordered[heads] // total
                word = forms.take(pa.array(ordered[heads] % total))
                entry = pc.if_else(pa.array(counts == 1), word, pc.binary_join_element_wise(
                    word, pa.array(counts).cast(pa.string()).cast(pa.binary()), b":"))
                at = np.searchsorted(prefix, np.arange(len(last[1]) + 1)).astype("i4")
                yield *last, pc.binary_join(pa.ListArray.from_arrays(pa.array(at), entry), b",")
                return
            rank = np.empty(len(key), "i8")
            rank[order] = np.cumsum(np.diff(ordered, prepend=-1) != 0) - 1
            at = place[order[heads]]
            cols = [forms.take(pa.array(ids[at + j])) for j in range(k)]
            if last is not None:
                yield *last, None
            last = (cols[0] if k == 1 else pc.binary_join_element_wise(*cols, b" ")), counts

    def occurrences(self) -> int:
        return sum(int(t[np.arange(a, a + len(i)) < o].sum()) for (i, _, o, t), a in zip(
            self.parts, np.cumsum([0] + [len(p[0]) for p in self.parts])))


def phrase_counts(chunks: DataFrame, max_words: int = 3, min_count: int = 10) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of 1 to ``max_words`` words that occur ``min_count`` times
    or more, and one row of 0 words per language with the number of all word occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Block] = {}
        for batch in batches:
            of: dict[bytes, tuple[list, list]] = {}
            for chunk, n in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist()):
                lang, _, words = chunk.rpartition(_TAB)
                mine = of.setdefault(lang, ([], []))
                mine[0].append(words)
                mine[1].append(n)
            for lang, mine in of.items():
                held.setdefault(lang, Block(max_words - 1)).add(*mine)
            while sum(b.words for b in held.values()) >= BLOCK:
                # the largest block goes: small languages go on merging
                most = max(held, key=lambda x: held[x].words)
                yield from flush({most: held.pop(most)})
        yield from flush(held)

    def flush(held: dict[bytes, Block]) -> Iterator[pa.RecordBatch]:
        for lang, block in held.items():
            yield part(lang, pa.array([b""], pa.binary()), np.array([block.occurrences()]), None)
            for phrases, f, tails in block.counts(max_words):
                for a in range(0, len(f), 65_536):
                    yield part(lang, phrases[a:a + 65_536], f[a:a + 65_536], None if tails is None else tails[a:a + 65_536])

    def part(lang: bytes, phrases: pa.Array, f: np.ndarray, tails: pa.Array | None) -> pa.RecordBatch:
        keys = pc.binary_join_element_wise(pa.array([lang] * len(f), pa.binary()), phrases, _TAB)
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(f, pa.int64()), pa.array([b""] * len(f), pa.binary()) if tails is None else tails],
            ["phrase", "f", "tail"])

    counted = map_partitions(chunks, run, "phrase binary, f long, tail binary")
    # Blocks have merged what repeats inside them, so the rows are dealt and sorted before they are added
    # up; sorted by a hash first, which is compared as a number and does not travel.
    dealt = counted.repartition("phrase").sortWithinPartitions(F.xxhash64("phrase"), "phrase")
    merged = map_partitions(dealt, lambda batches: _merged(batches, min_count), "phrase binary, last binary, f long")
    key = F.col("phrase").cast("string")
    text = F.substring_index(key, "\t", -1)
    whole = F.when(F.col("last").isNull(), text).otherwise(F.concat(text, F.lit(" "), F.col("last").cast("string")))
    lang = F.substring(key, F.lit(1), F.length(key) - F.length(text) - 1)
    found = merged.select(lang.alias("lang"), whole.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return found.select("lang", words.alias("words"), "phrase", "f").where((F.col("f") >= min_count) | (F.col("words") == 0))


class _Group:
    """The rows of one phrase, taken in as they come."""

    def __init__(self, phrase: bytes):
        self.phrase, self.f = phrase, 0
        self.tails: list[bytes] = []
        self.size, self.open = 0, False
        self.last: Counter = Counter()

    def add(self, f: int, tails: list[bytes]) -> None:
        self.f += f
        self.tails += tails
        self.size += sum(map(len, tails))

    def count(self) -> None:
        for entry in b",".join(self.tails).split(b",") if self.tails else ():
            word, _, n = entry.partition(b":")
            self.last[word] += int(n) if n else 1
        self.tails, self.size = [], 0


def _merged(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by phrase to (phrase, last, f): the phrases of ``min_count`` or more, and with
    ``last`` the next words that follow them so often. A phrase with very many next words gives some
    of them in several rows."""
    out: list[list] = [[], [], []]

    def put(phrase, last, f):
        for col, v in zip(out, (phrase, last, f)):
            col.append(v)

    def rows() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int64()))],
                                          ["phrase", "last", "f"])
        for col in out:
            col.clear()
        return done

    def close(g: _Group) -> None:
        if g.f >= min_count or g.phrase.endswith(_TAB):
            put(g.phrase, None, g.f)
            g.count()
            for word, n in g.last.items():
                if n >= min_count or g.open:
                    put(g.phrase, word, n)

    group: _Group | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        phrase, tail = (batch.column(c) for c in ("phrase", "tail"))
        f = batch.column("f").to_numpy()
        same = np.zeros(n, bool)
        if n > 1:
            same[1:] = np.asarray(pc.equal(phrase[1:], phrase[:-1]))
        heads = np.flatnonzero(~same)
        ends = np.append(heads[1:], n)
        sums = np.add.reduceat(f, heads)
        # all but the first and last group of a batch are whole; of those the rare ones are done with
        pick = (sums >= min_count) | np.asarray(pc.ends_with(phrase.take(pa.array(heads)), _TAB))
        pick[0] = pick[-1] = True
        chosen = np.flatnonzero(pick)
        inside = np.zeros(n + 1, "i8")
        np.add.at(inside, heads[chosen], 1)
        np.add.at(inside, ends[chosen], -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        tails = iter(tail.take(pa.array(at)).to_pylist())
        first = pa.array(heads[chosen])
        for words, size, total in zip(phrase.take(first).to_pylist(), (ends - heads)[chosen].tolist(), sums[chosen].tolist()):
            if group is None or words != group.phrase:
                if group is not None:
                    close(group)
                group = _Group(words)
            group.add(total, [t for t in islice(tails, size) if t])
            if group.size > SLICE:
                group.count()
                if len(group.last) > MANY:
                    group.open = True
                    for word, k in group.last.items():
                        put(group.phrase, word, k)
                    group.last.clear()
        if len(out[0]) >= 65_536:
            yield rows()
    if group is not None:
        close(group)
    if out[0]:
        yield rows()


def _first_words(phrase: Column, k: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(1), k), " ")


def _counts_of(rows: DataFrame, freq: DataFrame, heavy: DataFrame, part: str, out: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``: heavy ones by broadcast."""
    big = F.broadcast(heavy.select("lang", F.col("phrase").alias(part), F.col("f").alias("_heavy")))
    known = rows.join(big, ["lang", part], "left")
    small = freq.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_light"))
    # a heavy part needs no partner: its rows keep a key of their own, spread over the tasks
    key = F.when(F.col("_heavy").isNull(), F.col(part)).otherwise(F.concat(F.lit(" "), F.col("phrase")))
    met = known.withColumn("_key", key).join(small, (F.col("_key") == F.col("_part")) & (F.col("lang") == F.col("_lang")), "left")
    return met.withColumn(out, F.coalesce("_heavy", "_light")).select(*rows.columns, out)


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, absorb: int = 50, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text", period: int = PERIOD) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Phrases have 2 to ``max_words`` words and ``a`` >= ``min_count`` occurrences; ``l`` and
    ``r`` count the parts of the cut with the lowest score floor(10^6 a a / (l r)), the first
    of equal ones; ``n`` counts the language's words. A phrase inside a longer candidate of at
    least ``absorb`` % of its count is dropped. Order: score and ``a`` descending, phrase
    ascending. Null text: empty. Null language: ``und``. Repeated rows count each time; ids
    are not read. No words: no rows. Empty table: no rows."""
    if max_words < 2:
        raise ValueError("max_words must be 2 or more")
    # every part of a candidate occurs at least as often, so rarer phrases are of no use to any
    freq = cut_lineage(phrase_counts(dictionary(docs, max_words, period, lang_col, text_col), max_words, min_count))
    sizes = freq.where("words = 0").select("lang", F.col("f").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = freq.where((F.col("words") > 0) & (F.col("f") * HEAVY >= total))
    parts = freq.where("words > 0")
    found = freq.where("words > 1").withColumnRenamed("f", "a")
    cut = found.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("left", _first_words(F.col("phrase"), F.col("k"))).withColumn(
        "right", F.expr("substring(phrase, length(left) + 2)"))
    cut = _counts_of(_counts_of(cut, parts, heavy, "left", "l"), parts, heavy, "right", "r")
    # at most 10^6 as a <= l and a <= r; the products need decimals of 38 digits
    wide = [F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")]
    cut = cut.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0]) \
             .withColumn("down", wide[1] * wide[2]).withColumn("score", F.expr("up div down"))
    best = cut.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "words")).alias("b")).select("lang", "phrase", "b.*")
    if max_words > 2:
        # the proper inner phrases of the longer candidates, with the longest of their counts
        inner = (found.where("words > 2")
                 .select("lang", F.col("a").alias("longer"), F.split("phrase", " ").alias("w"), "words")
                 .select("lang", "longer", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
                 .select("lang", "longer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("i"))
                 .groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("phrase"))
                 .agg(F.max("longer").alias("longer")))
        best = best.join(inner, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorb))
    ranked = top_k_per_group(best, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top,
                             F.col("phrase"), out_col="rank")
    named = ranked.join(sizes, "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ship_by_value(__name__)

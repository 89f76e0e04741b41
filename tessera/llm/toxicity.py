"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word boundaries) and itself,
hashed into ``2**BITS`` embedding rows; a document is the average of its words'
vectors, where a word repeated within ``WINDOW`` words counts once and leaves
its other places zero, so repetition alone does not make a text extreme. A
softmax over two classes reads ``SCALE`` times the average. Embeddings and
softmax are trained jointly in numpy, so an unseen misspelling of a toxic word
shares most of its n-gram vectors.

The model is fitted on a bounded sample of labelled rows (``MAX_PER_CLASS``
per class, the smallest hashes of the id) and is a fixed-size table. Scoring
reads every word of every text; with a linear softmax a document's log odds are
the average of one number per word, kept in a bounded cache in each task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, id_text, map_partitions, share, ship_by_value

BITS, DIM, GRAMS, WINDOW = 17, 8, (3, 4, 5), 32
#: Most labelled rows of each class that training reads.
MAX_PER_CLASS = 2_500
#: Longer texts are not taken into the training sample, which bounds its bytes.
MAX_TRAINING_CHARS = 1 << 16
MIN_DOCS, SCALE, EPOCHS, BATCH, RATE, SPARSE, SEED = 3, 100.0, 12, 128, 0.02, 1.0, 7
#: Words a task keeps scored, words of a block, characters whose n-grams are built at a time, and the
#: longest word that is kept scored.
HELD, BLOCK, CHARS, LONGEST = 200_000, 1 << 16, 1 << 18, 256
GRAM_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(r"\w+")


def blocks(text: str) -> Iterator[list[str]]:
    """A text's lower-cased words, ``BLOCK`` at a time (a multiple of ``WINDOW``)."""
    found = (m.group() for m in _WORD.finditer(text.lower()))
    while words := list(islice(found, BLOCK)):
        yield words


def windows(words: list) -> Iterator[set]:
    """The distinct words of each window."""
    return (set(words[s:s + WINDOW]) for s in range(0, len(words), WINDOW))


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all n-grams of all words, and each word's first entry among them."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code))
    rows, owner = [], []
    h = np.zeros(len(code), np.uint64)
    for j in range(max(GRAMS)):
        step = np.zeros(len(code), np.uint64)
        step[:max(len(code) - j, 0)] = code[j:]
        h = (h + step + np.uint64(1)) * GRAM_BASE
        if j + 1 in GRAMS:
            inside = at + j + 1 <= end
            rows.append(h[inside] >> np.uint64(64 - BITS))
            owner.append(word[inside])
    # the word itself: a position-weighted sum of its codes
    weight = np.power(WORD_BASE, (at - (end - size[word])).astype(np.uint64))
    first = np.cumsum(size) - size
    whole = np.add.reduceat(code * weight, first) * GRAM_BASE
    rows.append(whole >> np.uint64(64 - BITS))
    owner.append(np.arange(len(words)))
    row, own = np.concatenate(rows).astype(np.int64), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return row[order], np.searchsorted(own[order], np.arange(len(words)))


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``gram_rows`` of many words, built for about ``CHARS`` characters at a time."""
    rows, first, a, n, at = [], [], 0, 0, 0
    for b in range(len(words) + 1):
        if b == len(words) or n + len(words[b]) > CHARS and b > a:
            if b > a:
                r, f = gram_rows(words[a:b])
                rows.append(r.astype(np.int32))
                first.append(f + at)
                at += len(r)
            a, n = b, 0
        if b < len(words):
            n += len(words[b])
    return np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate([np.zeros(0, np.int64), *first])


@dataclass
class Model:
    """``table``: each embedding row's share of the log odds; a word's is their mean.
    ``prior``: the toxic share of all labelled training rows, the score without words."""

    table: np.ndarray
    bias: float
    prior: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Mean of the table over each word's n-grams, for about ``CHARS`` characters at a time."""
        out, a, n = [], 0, 0
        for b, word in enumerate(words):
            if len(word) > CHARS or n + len(word) > CHARS:
                out.append(self._few(words[a:b]))
                a, n = b, 0
            if len(word) > CHARS:
                out.append(np.array([self._long(word)]))
                a = b + 1
            else:
                n += len(word)
        return np.concatenate([*out, self._few(words[a:])])

    def _few(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        rows, first = gram_rows(words)
        return np.add.reduceat(self.table[rows], first) / np.diff(np.append(first, len(rows)))

    def _long(self, word: str) -> float:
        """The same mean for one long word: its n-grams by where they begin, in pieces."""
        word = f"<{word}>"
        total, whole, count = 0.0, np.uint64(0), 1
        weight = np.power(WORD_BASE, np.arange(CHARS, dtype=np.uint64))
        step = np.uint64(pow(int(WORD_BASE), CHARS, 1 << 64))
        lead = np.uint64(1)
        for a in range(0, len(word), CHARS):
            code = np.frombuffer(word[a:a + CHARS + max(GRAMS) - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
            own = min(CHARS, len(word) - a)
            h = np.zeros(own, np.uint64)
            for j in range(max(GRAMS)):
                part = np.zeros(own, np.uint64)
                part[:max(min(own, len(code) - j), 0)] = code[j:j + own]
                h = (h + part + np.uint64(1)) * GRAM_BASE
                if j + 1 in GRAMS:
                    inside = max(min(own, len(code) - j), 0)
                    total += float(self.table[(h[:inside] >> np.uint64(64 - BITS)).astype(np.int64)].sum())
                    count += inside
            with np.errstate(over="ignore"):
                whole = whole + lead * (code[:own] * weight[:own]).sum(dtype=np.uint64)
                lead = lead * step
        with np.errstate(over="ignore"):
            row = int((whole * GRAM_BASE) >> np.uint64(64 - BITS))
        return (total + float(self.table[row])) / count

    def score(self, text: str, known: dict[str, float]) -> float:
        """The document's probability; the training prior without words."""
        total, n = 0.0, 0
        for words in blocks(text):
            missing = [w for w in set(words) if w not in known]
            if missing:
                if len(known) + len(missing) > HELD:
                    known.clear()
                    missing = list(set(words))
                known.update(zip(missing, self.word_scores(missing).tolist()))
            get = known.__getitem__
            total += sum(sum(map(get, part)) for part in windows(words))
            n += len(words)
            for w in missing:
                if len(w) > LONGEST:
                    del known[w]
        return float(1 / (1 + np.exp(-np.clip(SCALE * total / n + self.bias, -50, 50)))) if n else self.prior


def train(sample: list[tuple[str, int]], seed: int = SEED, share: float | None = None) -> Model:
    """Joint training on (text, label) rows. Rows of one class only: that
    class's constant score. No rows: nothing is known to be toxic, so every score is near 0.

    ``share``: the toxic share of the rows the sample was drawn from (default: the sample's own),
    which a sample capped per class does not show."""
    sample = [(text, y) for text, y in sample if _WORD.search(text)]
    labels = np.array([y for _, y in sample])
    toxic = float(labels.mean()) if len(labels) else 0.0
    prior = share if share is not None and len(labels) else toxic
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 50.0 if toxic else -50.0, prior)
    number: dict[str, int] = {}
    word, weight = [], []                 # of each document: its words and their shares
    for text, _ in sample:
        counts: Counter = Counter()
        n = 0
        for words in blocks(text):
            n += len(words)
            for part in windows(words):
                counts.update(part)
        word.append(np.array([number.setdefault(w, len(number)) for w in counts], np.int64))
        weight.append(np.fromiter(counts.values(), float, len(counts)) * SCALE / max(n, 1))
    rows, first = grams_of(list(number))
    grams = np.diff(np.append(first, len(rows)))
    rng = np.random.default_rng(seed)
    # start: rows seen in too few documents stay zero; the others' first dimension is the squared
    # log ratio of their document shares in the two classes, which training then refines
    seen = np.zeros((2, 1 << BITS))
    for d, y in enumerate(labels.tolist()):
        g = grams[word[d]]
        begin = np.cumsum(g) - g
        seen[y][np.unique(rows[np.repeat(first[word[d]] - begin, g) + np.arange(g.sum())])] += 1
    share = (seen + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1)
    ratio = np.log(share[1] / share[0])
    learns = (seen.sum(axis=0) >= MIN_DOCS)[:, None]
    embed = rng.normal(0, 0.01, (1 << BITS, DIM)).astype(np.float32)
    embed[:, 0] = np.sign(ratio) * ratio ** 2 / 8
    embed *= learns
    soft, bias = rng.normal(0, 0.01, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    soft[0] = (-0.5, 0.5)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embed, soft, bias)]
    of_class = 0.5 * len(labels) / np.bincount(labels, minlength=2)
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(sample)), max(1, len(sample) // BATCH)):
            size = [len(word[d]) for d in part]
            owner = np.repeat(np.arange(len(part)), size)
            used, inverse = np.unique(np.concatenate([word[d] for d in part]), return_inverse=True)
            share = np.concatenate([weight[d] for d in part])
            g = grams[used]
            begin = np.cumsum(g) - g
            gram = rows[np.repeat(first[used] - begin, g) + np.arange(g.sum())]
            vectors = np.add.reduceat(embed[gram], begin) / g[:, None]
            mean = np.stack([np.bincount(owner, weights=share * vectors[inverse, j], minlength=len(part))
                             for j in range(DIM)], axis=1)
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= (of_class[labels[part]] / len(part))[:, None]
            g_mean = p @ soft.T
            g_word = np.stack([np.bincount(inverse, weights=share * g_mean[owner, j], minlength=len(used))
                               for j in range(DIM)], axis=1) / g[:, None]
            g_gram = np.repeat(g_word, g, axis=0)
            g_embed = np.stack([np.bincount(gram, weights=g_gram[:, j], minlength=1 << BITS)
                                for j in range(DIM)], axis=1).astype(np.float32)
            step += 1
            for param, grad, (m, v) in zip((embed, soft, bias), (g_embed, mean.T @ p, p.sum(axis=0)), state):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            norm = np.sqrt((embed * embed).sum(axis=1, keepdims=True))
            embed *= learns * np.maximum(0, 1 - SPARSE * RATE / np.maximum(norm, 1e-9)).astype(np.float32)
    return Model((embed @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]), prior)


def training_fold(id_col: str = "doc_id") -> Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> Model:
    """A model from at most ``max_per_class`` labelled rows of each class, the training fold only.

    Ids that carry both labels, null ids and null labels teach nothing."""
    marks = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(training_fold())
             .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
             .select("doc_id", "y", F.xxhash64("doc_id").alias("h")))
    # the share of all labelled training rows: the sample below is capped per class
    share = marks.agg(F.avg("y")).first()[0]
    # the smallest hashes of each class that has a document: bounded, drawn from all rows
    texts = id_text(docs, id_col, text_col).where(F.length("text").between(1, MAX_TRAINING_CHARS))
    have = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = [have.where(F.col("y") == y).orderBy("h").limit(max_per_class) for y in (0, 1)]
    chosen = sample[0].union(sample[1]).select("doc_id", "y", "h")
    # an id that stands for several rows teaches one of its texts
    rows = (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))
            .orderBy("h", "doc_id").collect())
    return train([(r["text"], r["y"]) for r in rows], share=share)


def _scored(shared: Broadcast) -> Callable[[], Callable[[list[str], dict[str, float]], list[float]]]:
    def load():
        model = held(shared)
        return lambda texts, known: [model.score(t or "", known) for t in texts]
    return load


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null, empty or wordless text: the toxic share of all labelled training rows as score.
    Null id: held_out null. Repeated rows stay. Empty table: no rows."""
    load = _scored(share(docs.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, known = load(), {}
        for batch in batches:
            s = score(batch.column("text").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return (map_partitions(id_text(docs, id_col, text_col), run, "doc_id long, score double")
            .select("doc_id", (~training_fold()).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents scored below 0.5, with all their columns; no row moves."""
    load = _scored(share(docs.sparkSession, model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, known = load(), {}
        for batch in batches:
            s = score(batch.column(at).to_pylist(), known)
            yield batch.filter(pa.array([x < 0.5 for x in s], pa.bool_()))

    return map_partitions(docs, run, docs.schema)


ship_by_value(__name__)

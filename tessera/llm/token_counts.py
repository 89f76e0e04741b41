"""Token counts by a map-side two-tier lookup.

A text's token count is the sum over its pre-tokens, so only pre-token lengths
are needed. First tier: a broadcast table of the corpus's most frequent
pre-tokens, at most ``FREQUENT`` entries of at most ``LONGEST`` characters.
Second tier: a bounded cache in each task that encodes what the table lacks.
Documents' pre-tokens never shuffle. The table comes from one pass over all
texts in which every task keeps a bounded summary and emits at most
``SUMMARY`` words of it; those summaries are all that meets. The table only
decides where a length is found, never what it is.

Pre-tokens are cut where no vocabulary piece can reach across: before a run of
blanks, and around each line feed. Both are verified against the vocabulary;
a model that has such a piece is refused.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_partitions, ship_by_value

FREQUENT, LONGEST, SUMMARY = 32_768, 64, 4_096
#: Entries a task holds while it counts or caches.
HELD = 200_000
#: Characters of a text cut into pre-tokens at a time.
BLOCK = 1 << 20
#: The blank, and the character that stands for it in the vocabulary.
_PRE = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+")
_CUT = re.compile("(?<![ ▁])[ ▁]|\n")


def pre_tokens(text: str) -> Iterator[list[str]]:
    """Pre-tokens of a non-empty text with the leading blank the library adds; line feeds left out."""
    text, at = " " + text, 0
    while at < len(text):
        stop = _CUT.search(text, at + BLOCK)
        to = stop.start() if stop else len(text)
        yield _PRE.findall(text, at, to)
        at = to


def load_model(path: str):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or re.search("[^▁]▁", piece):
            raise ValueError(f"piece {piece!r} reaches across a pre-token boundary")
    return model


def lengths(model, pre: list[str]) -> list[int]:
    """Token counts of pre-tokens in place. The line feed put before each keeps the library from
    adding its own blank; both it and that blank are one token."""
    return [len(ids) - 2 for ids in model.encode(["\n" + p for p in pre], num_threads=1)]


def frequent_pre_tokens(docs: DataFrame, size: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts, by merged per-task summaries."""
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for pre in pre_tokens(text) if text else ():
                    seen.update(pre)
                    if len(seen) > HELD:
                        seen = Counter(dict(seen.most_common(HELD // 4)))
        top = [(w, n) for w, n in seen.most_common(SUMMARY) if len(w) <= LONGEST]
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top]), pa.array([n for _, n in top])],
                                             ["word", "n"])

    merged = map_partitions(docs.select("text"), summary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in merged.orderBy(F.desc("n"), "word").limit(size).collect()]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library's ``encode`` of the whole text without
    begin or end tokens. Null or empty text: 0. Null ids and repeated rows
    stay as they are. Empty table: no rows."""
    docs = id_text(docs, id_col, text_col)
    words = frequent_pre_tokens(docs)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(words, lengths(load_model(model_path), words))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, model = table.value, load_model(model_path)
        known = dict(frequent)

        def of(text: str) -> int:
            nonlocal known
            total = text.count("\n")
            for pre in pre_tokens(text) if text else ():
                missing = [w for w in set(pre) if w not in known]
                if missing:
                    if len(known) + len(missing) > len(frequent) + HELD:
                        known = dict(frequent)
                        missing = [w for w in set(pre) if w not in known]
                    known.update(zip(missing, lengths(model, missing)))
                total += sum(map(known.__getitem__, pre))
            return total

        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_partitions(docs, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


ship_by_value(__name__)

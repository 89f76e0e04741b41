"""License scans with a positional rare-token index.

Every template (a base phrase or a licence notice) is indexed by its rarest
words: word -> (template, position) postings. Rarity is the inverse document
frequency over the whole corpus, counted in a first pass that keeps one number
per licence word. A file looks up its indexed words; each hit votes for
``file position - template position``, and votes of one template that agree on
the relative position (within ``DRIFT`` words for notices) are one candidate. A
candidate stands when the mandatory key phrases of its template occur, word for
word, in its place. Base phrases are their own key phrases, and any place of a
phrase holds its rarest word, so the index misses none of them.

Both passes read every word and move none; what is broadcast is the index,
bounded by the templates.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_text, map_partitions, share, ship_by_value

# FIXED VALUES: base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met 1 redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution ")
_BSD_KEYS = ("redistribution and use in source and binary forms", "redistributions of source code must retain")
_ENDORSE, _ADVERTISE = "to endorse or promote products", "all advertising materials mentioning features or use of this software"

#: Notices of public licences: label, opening words, mandatory key phrases; phrases of which none may
#: stand there or in the REACH words after it (a further condition makes it another licence).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mit", "released under the mit license see the license file for details", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2.0 the license you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at",
     ("licensed under the apache license version 2 0",)),
    ("bsd-4-clause", _BSD + _ADVERTISE + " must display the following acknowledgement this product includes software "
                     "developed by", (*_BSD_KEYS, _ADVERTISE)),
    ("bsd-3-clause", _BSD + "3 neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission",
     (*_BSD_KEYS, "neither the name of", _ENDORSE), (_ADVERTISE,)),
    ("bsd-3-clause", _BSD + "3 the name of the author may not be used to endorse or promote products derived from this "
                     "software without specific prior written permission",
     (*_BSD_KEYS, "may not be used to endorse or promote products"), (_ADVERTISE,)),
    ("bsd-2-clause", _BSD + "this software is provided by the copyright holders and contributors as is", _BSD_KEYS,
     (_ENDORSE, _ADVERTISE)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
              "general public license as published by the free software foundation either version 2 of the license",
     ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
              "general public license as published by the free software foundation either version 3 of the license",
     ("gnu general public license", "version 3 of the license")),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
                 "lesser general public license as published by the free software foundation either version 2 1 of the "
                 "license", ("gnu lesser general public license", "version 2 1 of the license")),
    ("lgpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
               "lesser general public license as published by the free software foundation either version 3 of the "
               "license", ("gnu lesser general public license", "version 3 of the license")),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as "
               "published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
              "was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     ("permission to use copy modify and or distribute this software", "with or without fee")),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software released into the public domain",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0 international",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights "
            "to this work cc0 1 0 universal public domain dedication",
     ("waived all copyright and related or neighboring rights",)),
)

#: Rarest words indexed per notice; words a notice may be shifted by; least share of rare-word weight found.
RARE, DRIFT, LEAST = 8, 12, 0.6
#: Words after a notice in which a phrase that it must not have is looked for.
REACH = 60
BLOCK = 1 << 20
#: ASCII to lower case, everything that parts words to a blank; other bytes are word bytes.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split()


def word_blocks(text: str) -> Iterator[list[bytes]]:
    data, at = text.encode("utf-8").translate(_TABLE), 0
    while at < len(data):
        to = data.find(b" ", at + BLOCK)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[list[bytes]]
    base: bool
    without: list[list[bytes]] = field(default_factory=list)


def templates() -> list[Template]:
    out = [Template(label, words_of(p), [words_of(p)], True) for p, label in BASE]
    return out + [Template(label, words_of(t), [words_of(p) for p in phrases], False, [words_of(p) for q in without for p in q])
                  for label, t, phrases, *without in NOTICES]


@dataclass
class Index:
    """Postings of the rarest words: word -> [(template number, position)], and word weights."""

    templates: list[Template]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    weight: dict[bytes, float] = field(default_factory=dict)
    total: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, df: dict[bytes, int], n_docs: int) -> Index:
        index = cls(templates())
        index.weight = {w: log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-3
                        for t in index.templates for w in t.words}
        postings = defaultdict(list)
        for i, t in enumerate(index.templates):
            rare = sorted(set(t.words), key=lambda w: (-index.weight[w], w))[:1 if t.base else RARE]
            for p, w in enumerate(t.words):
                if w in rare:
                    postings[w].append((i, p))
            index.total.append(sum(index.weight[w] for w in rare))
        index.postings = dict(postings)
        return index


def _has(words: list[bytes], phrase: list[bytes], a: int, b: int) -> bool:
    first, n = phrase[0], len(phrase)
    return any(words[i] == first and words[i:i + n] == phrase for i in range(max(a, 0), min(b, len(words) - n + 1)))


def scan(text: str, index: Index) -> tuple[int, set[tuple[int, int]], dict[str, float]]:
    """(number of words, base places as (template, start), share of rare-word weight by label)."""
    keep = max(len(t.words) for t in index.templates) + 4 * DRIFT + REACH
    n, places, scores = 0, set(), {}
    held: list[bytes] = []                # last words of the block before, which a notice may begin in
    blocks = word_blocks(text)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        words = held + block
        before = n - len(held)
        n += len(block)
        here = index.postings.keys() & set(words)
        if here:
            votes = defaultdict(list)
            for at, w in enumerate(words):
                if w in here:
                    for t, p in index.postings[w]:
                        votes[t].append((at - p, w))
            for t, hits in votes.items():
                template = index.templates[t]
                if template.base:
                    size = len(template.words)
                    places.update((t, before + a) for a in {a for a, _ in hits}
                                  if a >= 0 and words[a:a + size] == template.words)
                else:
                    share = _aligned(words, template, sorted(hits), index, t, following is None)
                    if share >= LEAST:
                        scores[template.label] = max(share, scores.get(template.label, 0.0))
        held, block = words[-keep:], following
    return n, places, scores


def _aligned(words: list[bytes], template: Template, hits: list[tuple[int, bytes]], index: Index, t: int,
             last: bool = True) -> float:
    """The largest share of the template's rare-word weight whose votes agree within DRIFT words
    where the key phrases stand and no phrase the notice must not have. A place whose reach the words
    do not cover is left to the next block, unless they are the ``last``."""
    best, left, seen, weight = 0.0, 0, Counter(), 0.0
    for right, (at, w) in enumerate(hits):
        seen[w] += 1
        weight += index.weight[w] * (seen[w] == 1)
        while at - hits[left][0] > DRIFT:
            out = hits[left][1]
            seen[out] -= 1
            weight -= index.weight[out] * (seen[out] == 0)
            left += 1
        share = min(weight / index.total[t], 1.0)
        a, b = hits[left][0] - DRIFT, at + len(template.words) + DRIFT
        if share < LEAST or share <= best or not all(_has(words, p, a, b) for p in template.phrases):
            continue
        if template.without and (not last and b + REACH > len(words)
                                 or any(_has(words, p, a, b + REACH) for p in template.without)):
            continue
        best = share
    return best


def word_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """Document frequency of every licence word over all documents, and their number."""
    wanted = {w for t in templates() for w in t.words}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column("text").to_pylist():
                df.update(set().union(*(wanted.intersection(b) for b in word_blocks(text))))
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in df)]), pa.array([n, *df.values()])],
                                         ["word", "n"])

    rows = (map_partitions(docs.select("text"), count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a base phrase stands, else the largest aligned share of
    a notice's rare-word weight, else 0. Null or empty text: no words, no
    labels. Null ids and repeated rows stay. Empty table: no rows."""
    docs = id_text(docs, id_col, text_col)
    index = share(docs.sparkSession, Index.of(*word_frequencies(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(index)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            cols: list[list] = [[] for _ in types]
            for text in batch.column("text").to_pylist():
                n, places, scores = scan(text, known)
                base = {known.templates[t].label for t, _ in places}
                starts = [a for _, a in places]
                row = (n, len(places), min(starts, default=None), max(starts, default=None),
                       ",".join(sorted(base)), ",".join(sorted(base | set(scores))),
                       1.0 if base else max(scores.values(), default=0.0))
                for col, v in zip(cols, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_partitions(docs, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                     "base_labels string, labels string, score double")


ship_by_value(__name__)

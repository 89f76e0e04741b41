import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import collocations as C


def _pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def _counts(text, max_words):
    f = Counter()
    for words in _pieces(text):
        for k in range(1, max_words + 1):
            f.update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    return f


def _brute(rows, max_words=3, min_count=10, absorb=50, top=2000):
    by_lang = defaultdict(Counter)
    for lang, text in rows:
        by_lang["und" if lang is None else lang] += _counts(text or "", max_words)
    out = []
    for lang, f in by_lang.items():
        n = sum(c for p, c in f.items() if " " not in p)
        found = {tuple(p.split(" ")): c for p, c in f.items() if " " in p and c >= min_count}
        kept = []
        for w, a in found.items():
            if any(len(x) > len(w) and 100 * c >= absorb * a and any(x[i:i + len(w)] == w for i in range(len(x)))
                   for x, c in found.items()):
                continue
            score, k = min((10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def _rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_parse_holds_every_phrase_once(monkeypatch):
    rng = random.Random(5)
    signs = ["a", "b", "C", "é", "a b ", " ", "\t", ".", "\x0b", "\n", "\x1c", " the ", "x "]
    for _ in range(300):
        monkeypatch.setattr(C, "SLICE", rng.choice([5, 30, 1 << 20]))
        monkeypatch.setattr(C, "LONGEST", rng.choice([4, 7, 1024]))
        k = rng.choice([2, 3, 4])
        text = "".join(rng.choices(signs, k=rng.choice([0, 1, 5, 60, 300])))
        if rng.random() < .2:
            text = "w " * rng.randint(1, 200)
        chunks: Counter = Counter()
        for part in C.parse(text.encode().translate(C._TABLE).lower(), C.Numbers(C._END), k - 1, rng.choice([1, 2, 4, 12])):
            chunks.update(part)
        block, got = C.Block(k - 1), Counter()
        if chunks:
            half = len(chunks) // 2
            for some in (list(chunks.items())[:half], list(chunks.items())[half:]):
                if some:
                    block.add([c for c, _ in some], [n for _, n in some])
            for phrases, f, tails in block.counts(k):
                got.update(dict(zip((p.decode() for p in phrases.to_pylist()), f.tolist())))
                for p, tail in zip(phrases.to_pylist(), tails.to_pylist() if tails is not None else ()):
                    for e in tail.decode().split(",") if tail else ():
                        word, _, n = e.partition(":")
                        got[f"{p.decode()} {word}"] += int(n or 1)
            assert block.occurrences() == sum(n for p, n in got.items() if " " not in p)
        assert got == _counts(text, k), (text, k)


def test_copies_parse_alike():
    rng = random.Random(1)
    passage = " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(400))
    numbers = C.Numbers(C._END)
    one = Counter(c for part in C.parse(passage.encode(), numbers, 2) for c in part)
    two = Counter(c for part in C.parse(b"another head of it " + passage.encode(), numbers, 2) for c in part)
    assert sum((one & two).values()) >= len(one) - 1


@pytest.mark.parametrize("max_words,min_count,absorb,top", [(3, 10, 50, 2000), (4, 3, 80, 30), (2, 2, 50, 5)])
def test_against_brute_force(spark, max_words, min_count, absorb, top):
    rng = random.Random(max_words)
    vocabulary = ["The", "of", "new york", "New York City", "é", "zu", "x1", "über", "a", "the the", "."]
    rows = [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("hot", "buy now " * 3000), ("hot", "buy now, " * 500)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = _rows(C.collocations(docs, max_words, min_count, absorb, top))
    assert got == _brute(rows, max_words, min_count, absorb, top) and len(got) > 10


def test_merging_in_small_batches(monkeypatch):
    """Sorted rows of phrases cut into batches anywhere, with few next words held."""
    import pyarrow as pa
    rng = random.Random(9)
    for _ in range(200):
        monkeypatch.setattr(C, "SLICE", rng.choice([4, 1 << 20]))
        monkeypatch.setattr(C, "MANY", rng.choice([1, 1 << 20]))
        rows, want, whole = [], Counter(), Counter()
        for _ in range(rng.randint(0, 40)):
            phrase, f = rng.choice([b"x\t", b"x\ta", b"x\ta b", b"y\ta b", b"y\tc"]), rng.randint(1, 6)
            tail = Counter({rng.choice("pqr"): rng.randint(1, 5) for _ in range(rng.randint(0, 3))}) if phrase.endswith(b"b") else {}
            rows.append((phrase, f, ",".join(w if n == 1 else f"{w}:{n}" for w, n in tail.items()).encode()))
            whole[phrase] += f
            want.update({(phrase, w.encode()): n for w, n in tail.items()})
        rows.sort(key=lambda r: r[0])
        batches, at = [], 0
        while at < len(rows):
            to = at + rng.randint(1, 7)
            cols = list(zip(*rows[at:to]))
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.binary()))],
                                                      ["phrase", "f", "tail"]))
            at = to
        got = Counter()
        for b in C._merged(iter(batches), 10):
            for r in b.to_pylist():
                got[r["phrase"], r["last"]] += r["f"]
        kept = {p: n for p, n in whole.items() if n >= 10 or p.endswith(b"\t")}
        assert {k[0]: n for k, n in got.items() if k[1] is None} == kept
        assert {k: n for k, n in got.items() if k[1] is not None and n >= 10} == {k: n for k, n in want.items() if n >= 10 and k[0] in kept}


def test_edges(spark, edge_docs, edge_rows):
    assert _rows(C.collocations(edge_docs)) == _brute([(None, t) for _, t in edge_rows])


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1), ("en", 0, "", 2 * big + 1)]
    counts = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    monkeypatch.setattr(C, "phrase_counts", lambda *a: counts)
    r = C.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert r.score == 10**6 * (big - 1) ** 2 // (big * (big + 1)) and r.n == 2 * big + 1


def test_empty_table(no_docs):
    assert C.collocations(no_docs).count() == 0

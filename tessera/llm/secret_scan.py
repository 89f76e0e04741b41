"""Secret scans: known formats, and sliding-window entropy over candidate strings.

Three fixed formats (key assignments, access key ids, long hex runs) are found
leftmost and non-overlapping. Beside them, every long run of token characters is
a candidate: for each character class a window slides over the candidate, its
Shannon entropy kept by incremental counts (one character leaves, one enters),
and the windows at or above the class's threshold are joined into spans.
Candidates of known harmless shape are suppressed by the allow list; it never
touches the fixed formats. One pass, no shuffle; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_batches, ship_by_value

# FIXED VALUES: the formats of the base findings.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
_HEX = re.compile("[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

_CANDIDATE = re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """A class of characters, its window and threshold in bits, and what a window must contain."""

    name: str
    run: re.Pattern
    window: int
    bits: float
    needs: tuple[re.Pattern, ...]


_DIGIT, _UPPER, _LOWER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")
CLASSES = (
    CharClass("hex", re.compile("[0-9a-f]{24,}|[0-9A-F]{24,}"), 24, 3.2, (_DIGIT, re.compile("[A-Fa-f]"))),
    CharClass("alnum", re.compile("[A-Za-z0-9]{20,}"), 20, 3.7, (_DIGIT, _UPPER, _LOWER)),
    CharClass("lower", re.compile("[a-z0-9]{20,}"), 20, 3.6, (_DIGIT, _LOWER)),
    CharClass("upper", re.compile("[A-Z0-9]{20,}"), 20, 3.6, (_DIGIT, _UPPER)),
    CharClass("base64", re.compile("[A-Za-z0-9+/_-]{24,}"), 24, 3.9, (_DIGIT, _UPPER, _LOWER)),
)
#: Candidates of these shapes are no secrets.
ALLOWED = (
    re.compile("(?i)example|sample|dummy|placeholder|changeme|redacted|test[_-]?key|x{8}"),
    re.compile("(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"),                 # uuid
    re.compile("(?i)^sha(1|256|384|512)-"),                                      # integrity digests
    re.compile("(?i)abcdefghijkl|0123456789ab|zyxwvutsrqp|qwertyuiop"),          # alphabets, keyboards
)
#: Links and embedded data. A link ends at characters that cannot belong to it and at its query,
#: whose values are candidates; ``user`` is the part before the host, which may hold a secret.
_LINK = re.compile(r"""(?:://(?P<user>[^\s/?\#@"'`<>()\[\]{}|;,\\]++@|[^\s/:@"'`<>()\[\]{}|;,\\]*+:(?!\d+/)"""
                   r"""[^\s@"'`<>()\[\]{}|;,\\]*+@)?|www\.)[^\s?"'`<>()\[\]{}|;,\\]*|;base64,[A-Za-z0-9+/_=-]*""")
_LOG = [0.0] + [n * log2(n) for n in range(1, 65)]


def entropies(text: str, window: int) -> Iterator[float]:
    """Shannon entropy in bits per character of every window of ``text``."""
    counts: dict[str, int] = {}
    total, whole = 0.0, log2(window)
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _LOG[n + 1] - _LOG[n]
        if i >= window:
            out = text[i - window]
            n = counts[out]
            counts[out] = n - 1
            total += _LOG[n - 1] - _LOG[n]
        if i >= window - 1:
            yield whole - total / window


def link_spans(text: str) -> list[tuple[int, int]]:
    """Where links (without the part before the host) and embedded data stand."""
    return [(m.start() if m["user"] is None else m.end("user"), m.end()) for m in _LINK.finditer(text)]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Joined windows of high entropy inside the candidates that the allow list lets pass."""
    found, links, link = [], None, 0
    for candidate in _CANDIDATE.finditer(text):
        word, at = candidate.group(), candidate.start()
        if not (_DIGIT.search(word) and re.search("[A-Za-z]", word)):
            continue
        if any(p.search(word) for p in ALLOWED):
            continue
        if links is None:
            links = link_spans(text)
        while link < len(links) and links[link][1] <= at:
            link += 1
        if link < len(links) and links[link][0] <= at:
            continue
        for cls in CLASSES:
            for run in cls.run.finditer(word):
                s = run.group()
                for i, bits in enumerate(entropies(s, cls.window)):
                    if bits >= cls.bits and all(p.search(s, i, i + cls.window) for p in cls.needs):
                        a = at + run.start() + i
                        found.append((a, a + cls.window))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    return joined


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    # a run shorter than the least length has no long run inside, so the length may stand in the pattern
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += [("entropy", a, b) for a, b in entropy_spans(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    ``spans`` is kind:start:end of all findings, comma-joined; base_sha256 the
    digest of the fixed formats' part. Null or empty text: no findings. Null
    ids and repeated rows stay. Empty table: no rows."""
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], [], []]
        for text in batch.column("text").to_pylist():
            spans = find_secrets(text)
            kinds = [k for k, _, _ in spans]
            base = _joined([s for s in spans if s[0] != "entropy"])
            row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), _joined(spans),
                   kinds.count("entropy"))
            for col, v in zip(cols, row):
                col.append(v)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]))],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return map_batches(id_text(docs, id_col, text_col), scan,
                       "doc_id long, n_assign long, n_access long, n_hex long, "
                       "base_sha256 string, spans string, n_entropy long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The input with every found span of the text replaced by ``mark``; nulls stay null."""
    at = docs.columns.index(text_col)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text in batch.column(at).to_pylist():
            out, end = [], 0
            for _, a, b in find_secrets(text or ""):
                if a >= end:
                    out += [text[end:a], mark]
                end = max(end, b)
            texts.append(text if text is None or not out else "".join([*out, text[end:]]))
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_batches(docs, clean, docs.schema)


ship_by_value(__name__)

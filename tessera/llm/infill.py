"""Fill-in-the-middle transformation by displacement scatter.

A text is units (a run of A-Za-z, or any other single character); two cuts part it
into prefix, middle and suffix, which the output holds in another order behind marks.
A whole Arrow batch is handled as one byte array: every part's first byte gets the
change of the output shift (a difference array over the batch), its running sum is the
shift of every byte, and one numpy scatter moves them all. Restoring finds the marks in
the output, builds the same array over the restored bytes and gathers. Arrays of eight
bytes an element exist for one window of ``WINDOW`` bytes at a time, so the memory is a
few bytes for each byte of the batch. One map-only pass, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import id_text, map_batches, ship_by_value

# FIXED VALUES: the marks and the shares of the forms.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
CHANGED, SPM = 90, 20
PLAIN, PSM, SPM_FORM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
WINDOW = 1 << 20


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one array and the rows' offsets in it (rows + 1)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], "i8" if wide else "i4")[column.offset:column.offset + len(column) + 1].astype("i8")
    data = np.frombuffer(buffers[2], "u1") if buffers[2] is not None else np.zeros(0, "u1")
    return data[at[0]:at[-1]], at - at[0]


def _texts(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1,
                                            [None, pa.py_buffer(at.astype("i8")), pa.py_buffer(data)]).cast(pa.string())


def unit_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where a unit begins, where a code point begins), as masks over the bytes."""
    point = (data & 0xC0) != 0x80
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A)
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    unit[at[:-1][at[:-1] < len(data)]] = True
    return unit, point


def counts_before(mask: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many places of the mask are set before each of the (ascending) positions."""
    out, done = np.zeros(len(positions), "i8"), 0
    for a in range(0, len(mask) + 1, WINDOW):
        part = mask[a:a + WINDOW]
        i, j = np.searchsorted(positions, [a, a + WINDOW])
        if j > i:
            sums = np.concatenate([[0], np.cumsum(part, dtype="i8")])
            out[i:j] = done + sums[positions[i:j] - a]
        done += int(np.count_nonzero(part))
    return out


def nth_places(mask: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Place of the set element of each (ascending, 0-based) rank; the mask's length beyond the last."""
    out, done = np.full(len(ranks), len(mask), "i8"), 0
    for a in range(0, len(mask), WINDOW):
        places = np.flatnonzero(mask[a:a + WINDOW])
        i, j = np.searchsorted(ranks, [done, done + len(places)])
        out[i:j] = a + places[ranks[i:j] - done]
        done += len(places)
    return out


def marks_in(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Places where the three bytes of a mark stand."""
    m = np.frombuffer(mark, "u1")
    return np.flatnonzero((data[:-2] == m[0]) & (data[1:-1] == m[1]) & (data[2:] == m[2])) if len(data) > 2 \
        else np.zeros(0, "i8")


def displaced(n: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Windows (from, to, shift of every byte) of ``n`` bytes; part i begins at ``starts[i]``
    (ascending, first 0, empty parts allowed) and moves by ``shifts[i]``."""
    change = np.diff(shifts, prepend=0)
    carry = 0
    for a in range(0, n, WINDOW):
        b = min(n, a + WINDOW)
        diff = np.zeros(b - a, "i8")
        i, j = np.searchsorted(starts, [a, b])
        np.add.at(diff, starts[i:j] - a, change[i:j])
        diff[0] += carry
        shift = np.cumsum(diff, out=diff)
        carry = int(shift[-1])
        yield a, b, shift


def choices(doc_ids: list[int | None]) -> np.ndarray:
    """h1 to h4 of each document (rows of four)."""
    out = [hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest() for d in doc_ids]
    return np.array([[int(h[i:i + 8], 16) for i in range(0, 32, 8)] for h in out], "i8").reshape(-1, 4)


def transform(data: np.ndarray, at: np.ndarray, h: np.ndarray):
    """(output bytes, output offsets, form, units, prefix and middle in code points) of a batch."""
    begin, end = at[:-1], at[1:]
    unit, point = unit_starts(data, at)
    before = counts_before(unit, at)
    n = np.diff(before)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # rank n of a document is the first unit after it, which begins at its end
    places = nth_places(unit, (before[:-1, None] + cuts).ravel())
    first, second = places.reshape(-1, 2).T if len(n) else (places, places)
    marked = np.zeros(len(n), bool)
    for mark in MARKS.values():
        found = marks_in(data, mark)
        doc = np.searchsorted(end, found, side="right")
        marked[doc[found + 3 <= end[doc]]] = True
    form = np.where((n == 0) | marked | (h[:, 2] % 100 >= CHANGED), PLAIN,
                    np.where(h[:, 3] % 100 < SPM, SPM_FORM, PSM))
    extra = np.where(form == PLAIN, 0, 9)
    out_at = np.concatenate([[0], np.cumsum(end - begin + extra)])
    o, p, m, s = out_at[:-1], first - begin, second - first, end - second
    # where each part's text begins in the output
    psm, plain = form == PSM, form == PLAIN
    to_p = np.where(plain, o, np.where(psm, o + 3, o + 3 + s + 3))
    to_m = np.where(plain, o + p, o + p + s + 9)
    to_s = np.where(plain, o + p + m, np.where(psm, o + 3 + p + 3, o + 3))
    out = np.empty(int(out_at[-1]), "u1")
    for mark, place in ((b"<P>", to_p), (b"<S>", to_s), (b"<M>", to_m)):
        put = place[~plain] - 3
        for k in range(3):
            out[put + k] = mark[k]
    starts = np.stack([begin, first, second], axis=1).ravel()
    shifts = np.stack([to_p - begin, to_m - first, to_s - second], axis=1).ravel()
    for a, b, shift in displaced(len(data), starts, shifts):
        out[np.arange(a, b) + shift] = data[a:b]
    chars = counts_before(point, np.stack([begin, first, second], axis=1).ravel()).reshape(-1, 3)
    return out, out_at, form, n, np.diff(chars, axis=1)


def restore_bytes(out: np.ndarray, out_at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, from outputs and forms alone. A mark stands once in a
    rearranged output: the text has none, and none can arise where text meets a mark."""
    begin, end = out_at[:-1], out_at[1:]
    changed = np.flatnonzero(form != PLAIN)
    at = np.concatenate([[0], np.cumsum(end - begin - np.where(form == PLAIN, 0, 9))])
    place = {}
    for name, mark in MARKS.items():
        found = marks_in(out, mark)
        doc = np.searchsorted(end, found, side="right")
        ok = (form[doc] != PLAIN) & (found + 3 <= end[doc])
        if not np.array_equal(doc[ok], changed):
            raise ValueError("an output does not hold each mark once")
        place[name] = found[ok]
    src = np.repeat(begin[:, None], 3, axis=1)
    length = np.stack([end - begin, np.zeros_like(begin), np.zeros_like(begin)], axis=1)
    p, s, m, e = place["P"], place["S"], place["M"], end[changed]
    psm = form[changed] == PSM
    src[changed] = np.stack([p + 3, m + 3, s + 3], axis=1)
    length[changed] = np.stack([np.where(psm, s, m) - p - 3, e - m - 3, np.where(psm, m, p) - s - 3], axis=1)
    starts = at[:-1, None] + np.cumsum(length, axis=1) - length
    text = np.empty(int(at[-1]), "u1")
    for a, b, shift in displaced(len(text), starts.ravel(), (src - starts).ravel()):
        text[a:b] = out[np.arange(a, b) + shift]
    return text, at


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n (units), form (plain, psm, spm), prefix_chars,
    middle_chars (null if plain), output.

    Cuts and form come from the sha256 of the id, so a rerun gives the same rows. Null or
    empty text: plain, n 0, empty output. Null id: hashed as no digits. Texts that hold a
    mark stay plain. Repeated rows stay, all alike. Empty table: no rows."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = _bytes_of(batch.column("text"))
        out, out_at, form, n, chars = transform(data, at, choices(batch.column("doc_id").to_pylist()))
        plain = form == PLAIN
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(FORMS)[form], pa.string()),
             pa.array(chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 1], pa.int64(), mask=plain),
             _texts(out, out_at)],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(id_text(docs, id_col, text_col), run,
                       "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, form_col: str = "form", output_col: str = "output",
            text_col: str = "restored") -> DataFrame:
    """The rows with the text rebuilt from output and form in ``text_col`` (null where either is null)."""
    names = rows.columns
    if text_col in names:
        raise ValueError(f"there is a column {text_col}")
    f, o = names.index(form_col), names.index(output_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        forms, outputs = batch.column(f), batch.column(o)
        gone = np.array(outputs.is_null()) | np.array(forms.is_null())
        data, at = _bytes_of(outputs.fill_null("") if outputs.null_count else outputs)
        form = np.array([FORMS.index(x) if x else PLAIN for x in forms.to_pylist()])
        text = _texts(*restore_bytes(data, at, form))
        if gone.any():
            text = pa.array([None if g else t for g, t in zip(gone, text.to_pylist())], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, text], [*names, text_col])

    return map_batches(rows, run, StructType([*rows.schema.fields, StructField(text_col, StringType())]))


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the text restored from it, instead
    of the output."""
    rows = restore(fill_in_middle(docs, id_col, text_col))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ship_by_value(__name__)

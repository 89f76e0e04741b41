import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import infill
from tessera.llm.infill import FORMS, choices, fill_in_middle, fim_digests, restore, restore_bytes, transform


def _brute(doc_id, text):
    """(n, form, output, (prefix, middle) in characters) by slices of the units."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, (None, None)
    if h4 % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))


@pytest.mark.parametrize("window", [3, 50, 1 << 20])
def test_batches_against_slices(monkeypatch, window):
    monkeypatch.setattr(infill, "WINDOW", window)
    rng = random.Random(window)
    signs = ["a", "Bc", "é", "日", "<", "P", ">", "<S>", "S", " ", "\n", "🎉", "<M"]
    for _ in range(150):
        texts = ["".join(rng.choices(signs, [4, 4, 2, 2, 3, 2, 3, .2, 2, 4, 1, 1, 1], k=rng.choice([0, 0, 1, 3, 40, 120])))
                 for _ in range(rng.randint(0, 10))]
        ids = [rng.choice([None, rng.randint(-9, 10**9)]) for _ in texts]
        data = [t.encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype("i8")
        whole = np.frombuffer(b"".join(data), "u1")
        out, out_at, form, n, chars = transform(whole, at, choices(ids))
        back, back_at = restore_bytes(out, out_at, form)
        assert back.tobytes() == whole.tobytes() and (back_at == at).all()
        for i, (d, t) in enumerate(zip(ids, texts)):
            got = (n[i], FORMS[form[i]], out[out_at[i]:out_at[i + 1]].tobytes().decode())
            want = _brute(d, t)
            assert got == want[:3], (d, t)
            assert want[1] == "plain" or tuple(chars[i]) == want[3]


def test_an_output_without_its_marks_is_refused():
    out = np.frombuffer(b"<P>a<S>b", "u1")
    with pytest.raises(ValueError):
        restore_bytes(out, np.array([0, len(out)]), np.array([infill.PSM]))


def test_edges(spark, edge_docs, edge_rows):
    rows = fill_in_middle(edge_docs)
    got = restore(rows).collect()
    want = sorted(((d, *_brute(d, t or "")[:3], *_brute(d, t or "")[3], t or "") for d, t in edge_rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.restored) for r in got), key=repr) \
        == sorted(((d, n, f, o, p, m, t) for d, n, f, o, p, m, t in want), key=repr)
    assert {r.form for r in got} >= {"plain", "psm"}


def test_null_outputs_restore_to_null(spark):
    rows = spark.createDataFrame([(1, None, "plain"), (2, "ab", "plain"), (3, "x", None)], "k int, output string, form string")
    assert {r.k: r.restored for r in restore(rows).collect()} == {1: None, 2: "ab", 3: None}


def test_a_long_text(spark):
    text = "word é, " * 400_000
    r = fim_digests(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()
    n, form, out, (p, m) = _brute(7, text)
    assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
    assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
    assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(no_docs):
    assert fim_digests(no_docs).count() == 0

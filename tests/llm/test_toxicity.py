import random
import zlib

import pytest

from tessera.llm.toxicity import drop_toxic, fit, toxicity_scores, train

from ..conftest import SF_CHECK

BAD = ["idiot", "moron", "worthless", "pathetic", "disgusting"]


def _sample(n, seed):
    rng = random.Random(seed)
    fine = ["".join(rng.choice(["er", "on", "th", "an", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [rng.choice(fine) for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((" ".join(words), int(i % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    return train(_sample(600, 1))


def test_held_out_accuracy_and_misspellings(model):
    rows = _sample(300, 2)
    right = sum((model.score(t, {}) >= 0.5) == bool(y) for t, y in rows)
    assert right / len(rows) > 0.97
    fine = rows[1][0].split()[:20]
    assert model.score(" ".join(fine + ["pathetiic", "morron"]), {}) > model.score(" ".join(fine), {}) + 0.2


def test_degenerate_training():
    assert train([]).score("a b", {}) < 0.01 and train([]).score("", {}) == 0.0
    assert train([("a b", 0)]).score("a b", {}) < 0.01
    assert train([("a b", 1)]).score("a b", {}) > 0.99


def test_samples_without_words_and_repeated_ids(spark):
    assert train([(" ", 0), ("!!", 1)]).score("a", {}) < 0.01
    docs = spark.createDataFrame([(1, "b a"), (1, "a b"), (2, None), (2, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (1, 0)], "doc_id long, toxic int")
    model = fit(docs, labels)
    assert 0 <= model.score("a b x y", {}) <= 1


def test_scores_over_edges(edge_docs, edge_rows, no_docs, model):
    got = toxicity_scores(edge_docs, model).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.score for r in got if r.doc_id in (3, 4, 5)} == {model.prior}
    kept = drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.score < 0.5 for r in got)
    assert toxicity_scores(no_docs, model).count() == 0 and drop_toxic(no_docs, model).count() == 0


def test_fit_uses_the_training_fold_only(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    a = fit(docs, labels)
    # labels of the held-out fold turned round change nothing; null and double labels teach nothing
    turned = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    extra = spark.createDataFrame([(None, 1), (10**9, None)], "doc_id long, toxic int")
    b = fit(docs, turned.union(extra))
    assert (a.table == b.table).all() and a.bias == b.bias
    assert fit(docs, labels.where("false")).prior == 0.0


def test_wordless_texts_score_the_share_of_all_rows_when_the_sample_is_capped(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(_sample(80, 3))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, ""), (1001, None), (1002, "!!")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learnt = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert min(sum(learnt), len(learnt) - sum(learnt)) > 5
    model = fit(docs, labels, max_per_class=5)
    assert model.prior == pytest.approx(sum(learnt) / len(learnt)) and model.prior < 0.4
    got = {r.doc_id: r for r in toxicity_scores(docs, model).collect()}
    assert all(got[i].score == model.prior and got[i].predicted == 0 for i in (1000, 1001, 1002))
    assert {1000, 1001, 1002} <= {r.doc_id for r in drop_toxic(docs, model).collect()}


def test_scores_are_plain_averages_of_gram_embeddings():
    """The scoring against its definition: mean over a document's windows' distinct words of the mean
    over a word's n-grams."""
    import numpy as np

    from tessera.llm import toxicity as X
    rng = np.random.default_rng(0)
    model = X.Model(rng.normal(0, .01, 1 << X.BITS), -0.2, 0.3)

    def rows(word):
        w, m = f"<{word}>", 1 << 64
        out = []
        for n in X.GRAMS:
            for i in range(len(w) - n + 1):
                h = 0
                for c in w[i:i + n]:
                    h = (h + ord(c) + 1) * int(X.GRAM_BASE) % m
                out.append(h >> (64 - X.BITS))
        whole = sum(ord(c) * pow(int(X.WORD_BASE), i, m) for i, c in enumerate(w)) % m
        return out + [(whole * int(X.GRAM_BASE) % m) >> (64 - X.BITS)]

    text = "The quick a brün " * 30 + "日本 x" + "y" * 900
    words = X._WORD.findall(text.lower())
    total = sum(np.mean([model.table[r] for r in rows(w)])
                for s in range(0, len(words), X.WINDOW) for w in set(words[s:s + X.WINDOW]))
    want = 1 / (1 + np.exp(-(X.SCALE * total / len(words) + model.bias)))
    assert abs(model.score(text, {}) - want) < 1e-9


def test_long_words_are_scored_in_pieces(monkeypatch):
    import random

    import numpy as np

    from tessera.llm import toxicity as X
    model = X.Model(np.random.default_rng(1).normal(0, .01, 1 << X.BITS), 0.0, 0.3)
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdé日", k=n)) for n in (1, 5, 63, 64, 65, 66, 67, 128, 129, 1000, 3)]
    want = model.word_scores(words)
    monkeypatch.setattr(X, "CHARS", 64)
    assert np.allclose(model.word_scores(words), want, rtol=1e-9)


def test_a_text_of_one_long_word_stays_small():
    import resource

    import numpy as np

    from tessera.llm import toxicity as X
    model = X.Model(np.zeros(1 << X.BITS), 0.0, 0.3)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    known = {}
    assert model.score("ab" * 10_000_000, known) == 0.5 and not known
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10


def test_grams_built_in_pieces(monkeypatch):
    import random

    import numpy as np

    from tessera.llm import toxicity as X
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdé日", k=rng.randint(1, 90))) for _ in range(200)]
    rows, first = X.gram_rows(words)
    monkeypatch.setattr(X, "CHARS", 64)
    got = X.grams_of(words)
    assert np.array_equal(got[0], rows) and np.array_equal(got[1], first) and len(X.grams_of([])[0]) == 0

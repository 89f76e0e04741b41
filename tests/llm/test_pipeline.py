import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as E
from tessera.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, written and read as the driver does."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF_CHECK).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns_and_only_remove(stages):
    names = list(stages)
    for before, after in zip(names, names[1:-1]):
        a, b = stages[before], stages[after]
        assert a.columns == b.columns
        assert not b.exceptAll(a).count() and b.count() <= a.count()
    assert stages["packing"].select("doc_id").distinct().count() == stages["benchmark_decontamination"].count()


def test_each_stage_against_its_operator(spark, stages):
    from tessera.llm.decontam import contaminated
    from tessera.llm.simhash import near_dedup
    from tessera.llm.toxicity import fit, toxicity_scores
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    docs = stages["documents"]
    model = fit(docs, spark.read.parquet(f"{SF_CHECK}/labels.parquet"))
    assert ids(stages["toxicity"]) == ids(toxicity_scores(docs, model).where("predicted = 0"))
    texts = [r.text for r in stages["exact_dedup"].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in stages["toxicity"].collect()}
    near = near_dedup(stages["exact_dedup"]).collect()
    assert ids(stages["simhash_near_dedup"]) == {r.component_id for r in near}
    bad = ids(contaminated(stages["simhash_near_dedup"], spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")))
    assert bad and ids(stages["benchmark_decontamination"]) == ids(stages["simhash_near_dedup"]) - bad


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_edge_rows_and_empty_tables(spark, edge_docs, edge_rows, no_docs, k):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, no rows."""
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, edge_docs, SF_CHECK)
    if name == "packing":
        assert got.where("start = 0").count() == len(edge_rows)
    else:
        assert got.columns == edge_docs.columns
        kept = [(r.doc_id, r.text) for r in got.collect()]
        assert set(kept) <= set(edge_rows)
        if name == "exact_dedup":
            assert sorted(t or "" for _, t in kept) == sorted({t or "" for _, t in edge_rows})
        if name in ("toxicity", "benchmark_decontamination"):
            assert sorted(kept, key=repr) == sorted(edge_rows, key=repr)
    none = stage(spark, no_docs, SF_CHECK)
    assert none.count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF_CHECK)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert not got.select(key).exceptAll(stages["packing"].select(key)).count()
    assert got.count() == stages["packing"].count()


def test_all_are_registered():
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) <= names


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    got = QUERIES[name](spark, SF_CHECK).toPandas()
    want = con.execute(ORACLE[name]).df()[list(got.columns)]
    key = got.columns[0]
    assert got.sort_values(key).reset_index(drop=True).astype(str).equals(
        want.sort_values(key).reset_index(drop=True).astype(str))

"""Source guards (missing path, wrong extension) and the spread rule."""
import os
import tempfile

import pytest

from tessera.session import spread
from tessera.sources import readers as R


def test_missing_path_refused(spark):
    with pytest.raises(FileNotFoundError):
        R.read_reports(spark, ["/nonexistent/folder/a.json"])


def test_wrong_extension_refused(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    p = os.path.join(d, "reports.txt")
    with open(p, "w") as f:
        f.write('{"report_id": 1, "content": "x"}\n')
    with pytest.raises(ValueError):
        R.read_reports(spark, [p])


def test_every_file_of_a_folder_is_read(spark, tmp_path):
    import gzip
    line = '{"report_id": %d, "content": "x"}\n'
    (tmp_path / "a.json").write_text(line % 1)
    (tmp_path / "b").write_text(line % 2)
    (tmp_path / "c.json.gz").write_bytes(gzip.compress((line % 3).encode()))
    got = R.read_reports(spark, [str(tmp_path)])
    assert sorted(r.report_id for r in got.collect()) == [1, 2, 3]


def test_surrogate_ids_stay(spark, tmp_path):
    from pyspark.sql import types as T
    for i in range(5):
        (tmp_path / f"{i}.json").write_text('{"content": "t%d"}\n' % i)
    schema = T.StructType([f for f in R.REPORT_SCHEMA.fields if f.name != "report_id"])
    df = R.read_reports(spark, str(tmp_path), schema)
    a = {r.content: r.report_id for r in df.collect()}
    b = {r.content: r.report_id for r in df.repartition(3).collect()}
    assert a == b and len(set(a.values())) == 5


def test_spread_only_when_too_few_partitions(spark):
    n = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one, "id").rdd.getNumPartitions() == n
    many = spark.range(0, 100, 1, n + 3)
    assert spread(many, "id").rdd.getNumPartitions() == n + 3


@pytest.mark.parametrize("name", ["t10_clean_reports", "c4_top_tokens", "g9_roc_band", "x3_perturbations"])
def test_building_a_query_runs_no_job_but_file_schemas(spark, name):
    import __spark_entry__ as E

    from .conftest import SF_SMALL
    sc = spark.sparkContext
    sc.setJobGroup("schemas", "")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
    per_table = len(sc.statusTracker().getJobIdsForGroup("schemas")) / 2
    sc.setJobGroup(f"build {name}", "")
    df = E.queries()[name](spark, SF_SMALL)
    df._jdf.queryExecution().executedPlan()
    built = len(sc.statusTracker().getJobIdsForGroup(f"build {name}"))
    sc.setJobGroup("", "")
    assert built <= 6 * per_table


def test_one_csv_file_is_many_tasks(spark, tmp_path):
    import csv
    import random
    rng = random.Random(8)
    signs = ["a", "é", '"', '""', "\n", "\r\n", ",", " ", "\n\n", "x,y", "long word " * 5]
    rows = [("".join(rng.choices(signs, k=rng.randint(1, 30))) + "z", str(i) if i % 5 else None) for i in range(400)]
    with open(tmp_path / "sessions.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
        out.writerow(["report", "ipp"])
        out.writerows((t, "" if i is None else i) for t, i in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700b", "5000b", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = R.read_sessions(spark, str(tmp_path / "sessions.csv"))
            got = sorted(((r.report, r.ipp) for r in df.collect()), key=repr)
            n = spark.read.text(str(tmp_path / "sessions.csv")).rdd.getNumPartitions()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == sorted(rows, key=repr) and (size == before or n > 5)


def _vectors(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(i % 2, i, v) for i, v in enumerate((
        Vectors.sparse(6, [0, 3], [0.5, -2.0]), Vectors.sparse(6, [5], [1e-7]), Vectors.sparse(6, [], []),
        Vectors.sparse(6, range(6), [1.0, 0.0, 3.0, 4.0, 5.0, 6.0]), Vectors.dense([0.0, 1.5, 0.0, 0.0, 0.0, 2.0])))]
    return spark.createDataFrame(rows, ["outer_fold", "label", "features"])


def test_dense_lines_hold_every_number(spark, tmp_path):
    from tessera.sources import sinks as K
    K.write_vectors_tsv(_vectors(spark), str(tmp_path))
    got = {(r["outer_fold"], r["value"]) for r in spark.read.text(f"{tmp_path}/vectors").collect()}
    assert got == {(0, "0.5\t0.0\t0.0\t-2.0\t0.0\t0.0"), (1, "0.0\t0.0\t0.0\t0.0\t0.0\t1.0E-7"), (0, "0.0\t0.0\t0.0\t0.0\t0.0\t0.0"),
                   (1, "1.0\t0.0\t3.0\t4.0\t5.0\t6.0"), (0, "0.0\t1.5\t0.0\t0.0\t0.0\t2.0")}


def test_an_index_twice_is_refused(spark, tmp_path):
    from pyspark.errors import PySparkException
    from tessera.operators import features as FE
    from tessera.sources import sinks as K
    doubled = spark.sql("SELECT 0 AS outer_fold, 0 AS label, named_struct('type', CAST(0 AS TINYINT), 'size', 6, "
                        "'indices', array(2, 2), 'values', array(1.0D, 2.0D)) AS features")
    with pytest.raises(PySparkException):
        K.write_vectors_tsv(FE.stored_vectors(doubled, str(tmp_path / "v")), str(tmp_path / "t"))


def test_vectors_are_sorted_not_their_long_lines(spark):
    """Writing by folder sorts what it is given: the lines of a vocabulary's length went through that sort."""
    from tessera.sources import sinks as K
    plan = K.vector_lines(_vectors(spark), "features", "outer_fold", "dense")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_join") < plan.index("Sort [outer_fold") and "UDF" not in plan

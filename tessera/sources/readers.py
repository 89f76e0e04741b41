"""Sources: annotated reports (JSON lines), the session table (CSV), stored curves.

Schemas are declared, never inferred: inference is a full extra pass over the
data and would change with the files present.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage, spread

CLASSIFICATION_ENTRY = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
])

REPORT_SCHEMA = T.StructType([
    T.StructField("report_id", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("annotation", T.StructType([
        T.StructField("classificationResult", T.ArrayType(CLASSIFICATION_ENTRY)),
    ])),
])

SESSION_SCHEMA = T.StructType([
    T.StructField("report", T.StringType()),
    T.StructField("ipp", T.StringType()),
])


def _check_paths(spark: SparkSession, paths: Sequence[str], ext: str) -> None:
    """Every path must exist; plain files must carry the extension."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if not fs.exists(hp):
            raise FileNotFoundError(f"Path {p} does not exist")
        if fs.getFileStatus(hp).isFile() and not p.lower().endswith(ext):
            raise ValueError(f"{p} must be the path to a {ext} file")


def read_reports(spark: SparkSession, paths: Sequence[str] | str,
                 schema: T.StructType = REPORT_SCHEMA) -> DataFrame:
    """Scan several JSON-lines files/folders and stack them.

    Every file of a folder is read; malformed lines fail the job (FAILFAST).
    Without a ``report_id`` field a surrogate id is drawn and the rows are
    written once, so the id is the same in every later job."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    _check_paths(spark, paths, ".json")
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    if "report_id" not in df.columns:
        return cut_lineage(df.withColumn("report_id", F.monotonically_increasing_id()))
    return spread(df, "report_id")


def read_quoted_csv(spark: SparkSession, paths, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV whose quoted fields may hold line feeds, read by as many tasks as the files have splits.

    Lines are read in splits. The quotes counted before a line tell whether it begins inside a
    field: each split counts its own, and the split's state at its start is the parity of the
    splits before it (one row per split). A line that begins outside a field begins a record; its
    number is the split's offset plus its own count, and the lines of a number are one record
    whichever splits they stand in. Doubled quotes do not change the parity. Malformed records
    fail the job; empty lines are no records."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"), F.col("value").alias("_line"))
    lines = lines.withColumn("_n", F.length("_line") - F.length(F.replace("_line", F.lit('"'))))
    inside = Window.partitionBy("_f", "_b").orderBy("_i")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("_q", F.coalesce(F.sum("_n").over(before(inside)), F.lit(0)) % 2)
    along = before(Window.partitionBy("_f").orderBy("_b"))
    splits = x.groupBy("_f", "_b").agg(F.sum("_n").alias("_n"), F.count_if(F.col("_q") == 0).alias("_even"),
                                       F.count_if(F.col("_q") == 1).alias("_odd"))
    splits = splits.withColumn("_in", F.coalesce(F.sum("_n").over(along), F.lit(0)) % 2)
    splits = splits.withColumn("_off", F.coalesce(F.sum(F.when(F.col("_in") == 0, F.col("_even")).otherwise(F.col("_odd"))).over(along), F.lit(0)))
    y = x.join(splits.select("_f", "_b", "_in", "_off"), ["_f", "_b"])
    starts = F.sum((F.col("_q") == F.col("_in")).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = F.sort_array(F.collect_list(F.struct("_b", "_i", "_line")))
    records = y.withColumn("_r", F.col("_off") + starts).groupBy("_f", "_r").agg(
        F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["_line"]), "\n"), "\r$", "").alias("_record"))
    records = records.where((F.col("_r") > (1 if header else 0)) & (F.col("_record") != ""))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    return records.select(F.from_csv("_record", ddl, options).alias("_c")).select("_c.*")


def read_sessions(spark: SparkSession, paths, schema: T.StructType = SESSION_SCHEMA) -> DataFrame:
    """The session table, header row, quoted free text with newlines."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    _check_paths(spark, paths, ".csv")
    return read_quoted_csv(spark, paths, schema)


def read_curves(spark: SparkSession, root: str, embedding: str, run_date: str) -> DataFrame:
    """Stored predictions/curves of one embedding and run date.

    The filter is on partition columns, so only those folders are listed."""
    return (spark.read.parquet(root)
            .where((F.col("embedding") == embedding) & (F.col("run_date") == run_date)))

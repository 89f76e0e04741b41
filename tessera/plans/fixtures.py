"""Views over the driver tables that stand in for the reference's inputs.

Each view exists twice: a Spark builder (used by queries) and a DuckDB CTE
(used by the oracle SQL). Both are read off the given ``documents`` and
``labels`` tables, so their size grows with the data. See FIXTURES.md.

``H(x)`` = first four hex digits of md5(x) as an integer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RF_MAX_FEATURES, TFIDF_NGRAMS, TFIDF_PVS
from ..functions.hashing import hex_int, seed_key
from ..functions.text import TOKEN_PATTERN, explode_rows
from ..session import spread

N_PRED_REALIZATIONS = 10
EMBEDDINGS = ("tf_idf", "d2v")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _h(*parts):
    return hex_int(seed_key(*parts), 4)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, content, lang, ipp, label): documents with a 4-class label; every eleventh
    report has no patient id."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc_id"), "quality", "toxic")
    j = d.join(lab, d.doc_id == lab.l_doc_id, "left")
    label = (F.when(F.col("l_doc_id").isNull(), 3).when(F.col("toxic") == 1, 2)
             .when(F.col("quality") == 0, 1).otherwise(0))
    ipp = F.when(F.col("doc_id") % 11 != 0, F.expr("doc_id div 2"))
    return j.select(F.col("doc_id").alias("report_id"), F.col("text").alias("content"), "lang",
                    ipp.alias("ipp"), label.cast("int").alias("label"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(embedding, realization, report_id, y_true, votes): integer scores out of 51."""
    lab = table(spark, sf_dir, "labels")
    y = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    x = (lab.select(F.col("doc_id").alias("report_id"), y.alias("y_true"))
         .withColumn("embedding", F.explode(F.array(*[F.lit(e) for e in EMBEDDINGS])))
         .withColumn("realization", F.explode(F.sequence(F.lit(0), F.lit(N_PRED_REALIZATIONS - 1)))))
    h = _h(F.col("embedding"), F.col("realization"), F.col("report_id"))
    votes = F.floor((h * 6 + F.col("y_true") * 262144) * 51 / F.lit(655360)).cast("int")
    return x.select("embedding", "realization", "report_id", F.col("y_true").cast("int"),
                    votes.alias("votes"))


def grid_rows():
    """(seq, n_gram, pvs, mf) of the TF-IDF grid, in the reference loop order."""
    rows, seq = [], 0
    for n in TFIDF_NGRAMS:
        for p in TFIDF_PVS:
            for m in RF_MAX_FEATURES:
                rows.append((seq, n, p, m))
                seq += 1
    return rows


def grid_column():
    return F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(n).alias("n_gram"),
                              F.lit(p).cast("double").alias("pvs"), F.lit(m).cast("double").alias("mf"))
                     for s, n, p, m in grid_rows()])


def val_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(realization, outer_fold, inner_fold, seq, n_gram, pvs, mf, f1): validation F1
    of every grid combo on every inner fold, from pseudo predictions on ``labels``."""
    lab = table(spark, sf_dir, "labels")
    y = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    x = (lab.select(F.col("doc_id").alias("report_id"), y.alias("y_true"))
         .withColumn("realization", F.explode(F.sequence(F.lit(0), F.lit(N_PRED_REALIZATIONS - 1))))
         .withColumn("g", F.explode(grid_column())).select("*", "g.*").drop("g"))
    x = (x.withColumn("outer_fold", _h(F.lit("o"), F.col("realization"), F.col("report_id")) % 5)
          .withColumn("inner_fold", _h(F.lit("i"), F.col("realization"), F.col("report_id")) % 5)
          .withColumn("y_pred", F.when(_h(F.col("realization"), F.col("seq"), F.col("report_id"))
                                       < F.col("y_true") * 30000 + 20000, 1).otherwise(0)))
    tp = F.sum(F.col("y_true") * F.col("y_pred"))
    fp = F.sum((1 - F.col("y_true")) * F.col("y_pred"))
    fn = F.sum(F.col("y_true") * (1 - F.col("y_pred")))
    agg = x.groupBy("realization", "outer_fold", "inner_fold", "seq", "n_gram", "pvs", "mf").agg(
        (tp * 2).alias("a"), (tp * 2 + fp + fn).alias("b"))
    f1 = F.coalesce(F.try_divide(F.col("a").cast("double"), F.col("b").cast("double")), F.lit(0.0))
    return agg.select("realization", "outer_fold", "inner_fold", "seq", "n_gram", "pvs", "mf",
                      f1.alias("f1"))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, word, weight, rank): six words per labelled report, the
    largest |weight| among its distinct lowercase alphanumeric tokens."""
    from pyspark.sql.window import Window
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(
        table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 0),
                                      lambda w: w.rlike(r"^[\p{L}\p{N}]+$")))
    x = explode_rows(d, words, "word", F.col("doc_id").alias("report_id"))
    x = x.withColumn("weight", (_h(F.col("report_id"), F.col("word")) - 32768) / F.lit(65536))
    w = Window.partitionBy("report_id").orderBy(F.abs("weight").desc(), "word")
    return (x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 6))


# ---------------------------------------------------------------- DuckDB CTEs
def H(expr: str) -> str:
    return f"('0x'||substr(md5({expr}),1,4))::INT"


def _key(*parts: str) -> str:
    return "concat_ws('-', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


SQL_REPORTS = f"""reports AS (
  SELECT d.doc_id AS report_id, d.text AS content, d.lang,
         CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id // 2 END AS ipp,
         CAST(CASE WHEN l.doc_id IS NULL THEN 3 WHEN l.toxic = 1 THEN 2
                   WHEN l.quality = 0 THEN 1 ELSE 0 END AS INT) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SQL_PRED = f"""pred AS (
  SELECT e.embedding, CAST(r.realization AS INT) AS realization, l.doc_id AS report_id,
         CAST(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS INT) AS y_true,
         CAST(floor((6 * {H(_key('e.embedding', 'r.realization', 'l.doc_id'))}
                + 262144 * CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) * 51 / 655360) AS INT) AS votes
  FROM labels l CROSS JOIN (VALUES ('tf_idf'), ('d2v')) e(embedding)
       CROSS JOIN (SELECT range AS realization FROM range({N_PRED_REALIZATIONS})) r)"""


def _grid_values() -> str:
    vals = []
    for s, n, p, m in grid_rows():
        ps = "NULL::DOUBLE" if p is None else f"{p}::DOUBLE"
        vals.append(f"({s}, {n}, {ps}, {m}::DOUBLE)")
    return "(VALUES " + ", ".join(vals) + ") g(seq, n_gram, pvs, mf)"


SQL_VAL_SCORES = f"""vs_x AS (
  SELECT CAST(r.realization AS INT) AS realization, g.seq, g.n_gram, g.pvs, g.mf,
         CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS y_true,
         {H(_key("'o'", 'r.realization', 'l.doc_id'))} % 5 AS outer_fold,
         {H(_key("'i'", 'r.realization', 'l.doc_id'))} % 5 AS inner_fold,
         CASE WHEN {H(_key('r.realization', 'g.seq', 'l.doc_id'))}
                   < 30000 * (CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) + 20000
              THEN 1 ELSE 0 END AS y_pred
  FROM labels l CROSS JOIN (SELECT range AS realization FROM range({N_PRED_REALIZATIONS})) r
       CROSS JOIN {_grid_values()}),
val_scores AS (
  SELECT realization, outer_fold, inner_fold, seq, n_gram, pvs, mf,
         coalesce(2.0 * sum(y_true * y_pred)
                  / nullif(2 * sum(y_true * y_pred) + sum((1 - y_true) * y_pred) + sum(y_true * (1 - y_pred)), 0), 0.0) AS f1
  FROM vs_x GROUP BY ALL)"""

SQL_TOKEN_PATTERN = TOKEN_PATTERN

SQL_EXPLANATIONS = f"""ex_w AS (
  SELECT DISTINCT d.doc_id AS report_id, unnest(regexp_extract_all(lower(d.text), '{TOKEN_PATTERN}')) AS word
  FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id),
ex_s AS (
  SELECT report_id, word, ({H(_key('report_id', 'word'))} - 32768) / 65536 AS weight
  FROM ex_w WHERE regexp_full_match(word, '[\\p{{L}}\\p{{N}}]+')),
explanations AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY abs(weight) DESC, word) AS rank
                 FROM ex_s) WHERE rank <= 6)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------ file fixtures
def write_reports_json(spark: SparkSession, sf_dir: str) -> list[str]:
    """``reports`` as annotated JSON lines in two folders (English / other
    languages). Each report carries a decoy classification entry first; the
    last entry marked 'Classification' holds its true global label."""
    from ..config import GLOBAL_LABELS
    from ..session import scratch_path
    r = reports(spark, sf_dir)
    glob = F.element_at(F.array(*[F.lit(t) for t, _ in GLOBAL_LABELS]), F.col("label") + 1)
    entries = F.array(
        F.struct(F.lit("Classification").alias("label"),
                 F.array(F.lit(" Global_unknown"), F.lit(" Lesion_size")).alias("classes")),
        F.struct(F.lit("Comment").alias("label"), F.array(F.lit("Global remark")).alias("classes")),
        F.struct(F.lit("Classification").alias("label"),
                 F.array(F.lit(" Lesion_stable"), glob).alias("classes")))
    out = r.select("report_id", "content", F.struct(entries.alias("classificationResult")).alias("annotation"))
    base = scratch_path(spark, "reports-json")
    paths = []
    for name, cond in (("chunk_en", r.lang == "en"), ("chunk_other", ~(r.lang == "en"))):
        p = f"{base}/{name}"
        out.where(cond).write.mode("overwrite").json(p)
        paths.append(p)
    return paths


def write_sessions_csv(spark: SparkSession, sf_dir: str) -> str:
    """``(report, ipp)`` as CSV with a header; report texts hold newlines."""
    from ..session import scratch_path
    r = reports(spark, sf_dir)
    p = scratch_path(spark, "sessions-csv")
    (r.select(F.col("content").alias("report"), F.col("ipp").cast("string").alias("ipp"))
      .write.option("header", True).option("quote", '"').option("escape", '"').csv(p))
    return p

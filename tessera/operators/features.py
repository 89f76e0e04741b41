"""TF-IDF features as long tables.

Plan shape for many splits at once:
  doc_terms  (report_id, term, n, tf)      - one explode per report, once, for
                                              the largest n; smaller n filter it
  membership (split_id, report_id, role)   - from the split table
  stats      (split_id, term, df, ctf)     - join + aggregate over training rows
  vocab      (split_id, term, idf)         - df pruning, top-k cap
  weights    (split_id, report_id, term, w) - join, L2 norm per (split, report)
  vectors    (split_id, report_id, features) - sparse, from the numbered vocabulary
No step holds a whole vocabulary or a whole split in one task or the driver: the
cap and the term numbers come from range-partitioned running numbers.
"""

from __future__ import annotations

import math

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.ranking import ordered_number
from ..session import cut_lineage, scratch_path

#: Terms in this share of a split's documents are joined by broadcast, and at most so many.
HEAVY_SHARE, HEAVY_TERMS = 0.05, 20_000
#: Bits of the filter of a vocabulary's terms, at most: 8 MB to every executor.
FILTER_BITS = 1 << 26


def doc_terms(docs: DataFrame, text_col: str, n_max: int, id_col: str = "report_id",
              lowercase: bool = True) -> DataFrame:
    """E1 + E2 + E3 (document part): (report_id, term, n, tf) for every word
    n-gram with n <= n_max. The texts of an id meet in one row (they move, their
    n-grams do not) and are counted there, so nothing is held but one report. The
    rows stay partitioned by ``id_col``, which later joins by it make use of."""
    texts = docs.groupBy(id_col).agg(F.collect_list(text_col).alias("_texts"))
    # words first, as a column: the n-gram lambdas index into it, and an
    # inlined tokenizer would be re-run per element
    words = texts.select(id_col, F.transform("_texts", lambda t: T.vectorizer_tokens(t, lowercase)).alias("_w"))
    grams = F.concat(*[T.counted(F.flatten(F.transform("_w", lambda w: T.ngrams(w, n, n))), n=F.lit(n)) for n in range(1, n_max + 1)])
    t = T.explode_rows(words.select(id_col, grams.alias("_g")), F.col("_g"), "_t", id_col)
    return t.select(id_col, "_t.term", "_t.n", "_t.tf")


def _of_members(terms: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """The members' terms. Terms are partitioned by id already: the members, a few numbers a row, go
    to them, and a hash join leaves the terms unsorted where they are."""
    return terms.join(members.hint("shuffle_hash"), id_col)


def term_stats(terms: DataFrame, members: DataFrame, n_max_col: Column | None = None,
               id_col: str = "report_id") -> tuple[DataFrame, DataFrame]:
    """E3 (corpus part): per (split_id, term) df and ctf over training rows,
    plus the number of training documents per split.

    ``members``: (split_id, report_id[, n_gram]) training rows. With an
    ``n_gram`` column, terms longer than that split's n are dropped."""
    j = _of_members(terms, members, id_col)
    if "n_gram" in members.columns:
        j = j.where(F.col("n") <= F.col("n_gram"))
    stats = j.groupBy("split_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    n_docs = members.groupBy("split_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return stats, n_docs


def heldout_term_stats(terms: DataFrame, universe: DataFrame, parent_cols, n_folds: int,
                       id_col: str = "report_id", min_df: int = 1) -> tuple[DataFrame, DataFrame]:
    """E3 for k-fold splits: per (parent, fold) the statistics of the
    training documents = the parent's totals minus the documents held out in
    that fold. Held-out sets partition a parent's documents, so one
    aggregation over (parent, fold, term) serves all k splits, instead of
    joining every document-term row to each of the k-1 splits it trains in.
    The statistics do not depend on n-gram length or cap: those filters apply
    afterwards, on the small per-term table.

    ``universe``: (parent..., report_id, fold) with fold = the held-out fold,
    or -1 for documents that train in every fold of the parent. Terms in fewer
    than ``min_df`` of a parent's documents leave before the folds multiply
    them: no fold's training part can hold more.
    Returns (parent..., fold, term, n, df, ctf) and (parent..., fold, n_docs)."""
    pc = list(parent_cols)
    g = _of_members(terms, universe.select(*pc, id_col, "fold"), id_col)
    # one aggregation: parent totals and, per fold, the held-out part
    # (k conditional sums, k is small), then one row per fold
    aggs = [F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_ctf"), F.first("n").alias("n")]
    for f in range(n_folds):
        aggs += [F.count_if(F.col("fold") == f).alias(f"_h{f}"),
                 F.sum(F.when(F.col("fold") == f, F.col("tf")).otherwise(F.lit(0))).alias(f"_c{f}")]
    t = g.groupBy(*pc, "term").agg(*aggs).where(F.col("_df") >= min_df)
    per = F.array(*[F.struct(F.lit(f).alias("fold"), (F.col("_df") - F.col(f"_h{f}")).alias("df"),
                             (F.col("_ctf") - F.col(f"_c{f}")).alias("ctf")) for f in range(n_folds)])
    stats = t.select(*pc, "term", "n", F.explode(per).alias("_p")).select(*pc, "_p.fold", "term", "n", "_p.df",
                                                                          "_p.ctf")
    stats = stats.where(F.col("df") > 0)
    sizes = universe.groupBy(*pc, "fold").agg(F.count(F.lit(1)).alias("_c"))
    tot = sizes.groupBy(*pc).agg(F.sum("_c").alias("_all"))
    per_fold = tot.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    n_docs = per_fold.join(sizes.where(F.col("fold") >= 0), pc + ["fold"], "left").select(
        *pc, "fold", (F.col("_all") - F.coalesce("_c", F.lit(0))).alias("n_docs"))
    return stats, n_docs


def prune_df(stats: DataFrame, n_docs: DataFrame, min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """Keep terms with df >= min_df and df <= max_df * n_docs (max_df as a
    share when float, a count when int). ``n_docs`` is one row per split."""
    j = stats.join(F.broadcast(n_docs), "split_id")
    hi = F.col("n_docs") * F.lit(float(max_df)) if isinstance(max_df, float) else F.lit(max_df)
    return j.where((F.col("df") >= min_df) & (F.col("df") <= hi))


def cap_vocabulary(pruned: DataFrame, k: Column | int | None) -> DataFrame:
    """E5: the k terms of highest corpus frequency per split (ties by term);
    ``k`` may be a column (per-split cap, NULL: no cap) or None for no cap.

    Selection by counting: a histogram of the frequencies gives each split's
    cut, the value at which the running count reaches k. Terms above it stay;
    only the terms tied at the cut are ordered, over range partitions."""
    if k is None:
        return pruned
    kc = k if isinstance(k, Column) else F.lit(int(k))
    x = cut_lineage(pruned.withColumn("_k", kc))
    w = Window.partitionBy("split_id").orderBy(F.col("ctf").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # one row per frequency that occurs: their number grows like the root of the corpus
    hist = (x.where("_k IS NOT NULL").groupBy("split_id", "ctf").agg(F.count(F.lit(1)).alias("_c"), F.first("_k").alias("_k"))
            .withColumn("_to", F.sum("_c").over(w)))
    cut = hist.where(F.col("_to") > F.col("_k")).groupBy("split_id").agg(
        F.max("ctf").alias("_cut"), F.max_by(F.col("_k") - (F.col("_to") - F.col("_c")), F.col("ctf")).alias("_room"))
    y = x.join(F.broadcast(cut), "split_id", "left")
    sure = y.where(F.col("_k").isNull() | F.col("_cut").isNull() | (F.col("ctf") > F.col("_cut")))
    tied = y.where(F.col("_k").isNotNull() & (F.col("ctf") == F.col("_cut")) & (F.col("_room") > 0))
    tied = ordered_number(tied, ["split_id"], [F.col("term")], "_r").where(F.col("_r") <= F.col("_room")).drop("_r")
    return sure.unionByName(tied).select(*pruned.columns)


def vocabulary_cap(terms: DataFrame, pvs: float | None) -> int | None:
    """round_half_up(V * pvs), V = distinct single words; None without ``pvs``."""
    if pvs is None:
        return None
    v = terms.where("n = 1").select("term").distinct().agg(F.count(F.lit(1)).alias("v"))
    return v.select(T.round_half_up(F.col("v").cast("double") * F.lit(pvs)).cast("long")).first()[0]


def idf_column(n_docs: Column, df: Column) -> Column:
    """Smoothed idf: ln((1 + n) / (1 + df)) + 1."""
    return F.log((n_docs + 1).cast("double") / (df + 1).cast("double")) + F.lit(1.0)


def vocabulary(terms: DataFrame, members: DataFrame, min_df: int = 2, max_df: float = 0.9,
               pvs: float | None = None, id_col: str = "report_id", words: DataFrame | None = None) -> DataFrame:
    """(split_id, term, df, ctf, n_docs, idf). ``words``: the terms of one word, if they are cheaper
    to have than by looking for them in ``terms``."""
    stats, n_docs = term_stats(terms, members, id_col=id_col)
    pruned = cap_vocabulary(prune_df(stats, n_docs, min_df, max_df), vocabulary_cap(terms if words is None else words, pvs))
    return pruned.withColumn("idf", idf_column(F.col("n_docs"), F.col("df")))


def numbered_vocabulary(vocab: DataFrame) -> DataFrame:
    """Adds ``idx``, the term's 0-based place in its split's sorted vocabulary."""
    v = ordered_number(cut_lineage(vocab), ["split_id"], [F.col("term")], "_n")
    return v.withColumn("idx", (F.col("_n") - 1).cast("int")).drop("_n")


def _heavy_terms(vocab: DataFrame) -> DataFrame:
    """The terms in at least ``HEAVY_SHARE`` of a split's documents, told by their idf; at most
    ``HEAVY_TERMS`` of them, the most frequent first."""
    least = 1.0 - math.log(HEAVY_SHARE)
    return vocab.where(F.col("idf") <= least).orderBy("idf", "split_id", "term").limit(HEAVY_TERMS)


def maybe_known(rows: DataFrame, vocab: DataFrame, n_terms: int) -> DataFrame:
    """The rows (split_id, ..., term) whose term may be in its split's vocabulary of ``n_terms`` terms: none
    that is there is lost, and of the others few are left. Each term of the vocabulary sets one bit, by
    its hash; the bits go to the rows, whose own shuffle then leaves most unknown terms behind. The
    number of bits is bounded; a vocabulary that would set most of them filters nothing."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * n_terms).bit_length()))
    if 2 * n_terms > bits:
        return rows
    # as text, so that a split's number gives the same hash whatever its type
    bit = F.pmod(F.xxhash64(F.col("split_id").cast("string"), "term"), F.lit(bits))
    place = F.shiftright(bit, 6)
    longs = vocab.select(place.alias("_i"), (bit % 64).cast("int").alias("_b")).groupBy("_i").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b"))).alias("_l"))
    every = rows.sparkSession.range(bits // 64).join(longs, F.col("id") == F.col("_i"), "left").select(
        F.struct("id", F.coalesce("_l", F.lit(0).cast("long")).alias("l")).alias("_e"))
    held = every.agg(F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["l"]).alias("_bits"))
    # the one row is looked into by the join's condition, so it is never copied into the rows
    return rows.join(F.broadcast(held), F.getbit(F.get("_bits", place.cast("int")), (bit % 64).cast("int")) == 1, "left_semi")


def raw_weights(terms: DataFrame, members: DataFrame, vocab: DataFrame, id_col: str = "report_id",
                cols=(), n_terms: int | None = None) -> DataFrame:
    """tf*idf of the member documents on their split's vocabulary before the norm, with the vocabulary
    columns ``cols``; unknown terms drop out. (split_id, report_id, term, cols..., _x). With the vocabulary's
    size ``n_terms`` most unknown terms drop out before they move (``maybe_known``).

    A word in most documents would be one join key: such terms are few and go through a broadcast
    map; their rows pass the shuffled join of the others under a key of their own document."""
    cols = ["idf", *cols]
    j = _of_members(terms.select(id_col, "term", "tf"), members.select("split_id", id_col), id_col)
    if n_terms is not None:
        j = maybe_known(j, vocab, n_terms)
    heavy = _heavy_terms(vocab).select("split_id", "term", *[F.col(c).alias(f"_h_{c}") for c in cols])
    light = vocab.select(F.col("split_id").alias("_s"), F.col("term").alias("_t"), *[F.col(c).alias(f"_l_{c}") for c in cols])
    x = j.join(F.broadcast(heavy), ["split_id", "term"], "left")
    # no term begins with a blank; a light term is its own key and moves once
    is_heavy = F.col("_h_idf").isNotNull()
    x = x.select("split_id", id_col, "tf", *[f"_h_{c}" for c in cols], F.when(is_heavy, F.col("term")).alias("_heavy"),
                 F.when(is_heavy, F.concat(F.lit(" "), F.col(id_col).cast("string"))).otherwise(F.col("term")).alias("_key"))
    y = x.join(light, (F.col("split_id") == F.col("_s")) & (F.col("_key") == F.col("_t")), "left")
    y = y.select("split_id", id_col, F.coalesce("_heavy", "_key").alias("term"), "tf",
                 *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in cols])
    return y.where(F.col("idf").isNotNull()).select("split_id", id_col, "term", *cols[1:],
                                                    (F.col("tf") * F.col("idf")).alias("_x"))


def tfidf_weights(terms: DataFrame, members: DataFrame, vocab: DataFrame,
                  id_col: str = "report_id") -> DataFrame:
    """L2-normalised tf*idf of the member documents (training or
    unseen) on their split's vocabulary; unknown terms drop out.
    (split_id, report_id, term, tfidf). ``vocab`` is read several times: a stored table."""
    w = raw_weights(terms, members, vocab, id_col, n_terms=vocab.count())
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy("split_id", id_col)))
    return w.select("split_id", id_col, "term", (F.col("_x") / norm).alias("tfidf"))


def indexed_weights(terms: DataFrame, members: DataFrame, numbered: DataFrame,
                    id_col: str = "report_id", n_terms: int | None = None) -> DataFrame:
    """E8 as rows, before the norm: (split_id, report_id, idx, weight). ``n_terms`` as in ``raw_weights``."""
    return raw_weights(terms, members, numbered, id_col, ["idx"], n_terms).select(
        "split_id", id_col, "idx", F.col("_x").alias("weight"))


def sparse_rows(weights: DataFrame, members: DataFrame, size: int, id_col: str = "report_id") -> DataFrame:
    """(report_id, features) of one split's members, ``features`` as the struct that a sparse
    vector is stored as. Entries are sorted by number before they are summed, so a vector is the
    same to the last bit however the rows arrived. A member without a known term is the zero vector."""
    rows = weights.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("_e"))
    norm = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"]))
    # the norm as a column of its own would be put back into the lambda and summed for every entry
    values = T.let(norm, lambda total: F.transform("_e", lambda e: e["weight"] / total))
    vec = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(int(size)).alias("size"),
                   F.transform("_e", lambda e: e["idx"]).alias("indices"), values.alias("values"))
    none = F.array().cast("array<struct<idx:int,weight:double>>")
    return (members.select(id_col).join(rows, id_col, "left").withColumn("_e", F.coalesce("_e", none))
            .select(id_col, vec.alias("features")))


def stored_vectors(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` written once and read back with ``features`` as a vector: the stored struct is read
    under the vector type, so no row passes a Python worker. Default path: a fresh scratch folder."""
    path = path or scratch_path(rows.sparkSession, "vectors")
    rows.write.mode("overwrite").parquet(path)
    fields = [T_.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in rows.schema.fields]
    return rows.sparkSession.read.schema(T_.StructType(fields)).parquet(path)


def sparse_vectors(weights: DataFrame, members: DataFrame, size: int, id_col: str = "report_id",
                   path: str | None = None) -> DataFrame:
    """E8 at the model boundary: (report_id, features) of one split's members."""
    return stored_vectors(sparse_rows(weights, members, size, id_col), path)


def vector_entries(col: str) -> Column:
    """The non-zero entries of a sparse vector column: array of (idx, w)."""
    v = F.unwrap_udt(F.col(col))
    return F.arrays_zip(v["indices"].alias("idx"), v["values"].alias("w"))


def with_terms(df: DataFrame, text_col: str, n_max: int, out_col: str = "terms") -> DataFrame:
    """E1 + E2 as one array column."""
    w = df.withColumn("_w", T.vectorizer_tokens(F.col(text_col)))
    return w.withColumn(out_col, T.ngrams(F.col("_w"), n_max)).drop("_w")

"""Report cleaning (T2, T10, T11): one narrow projection per report.

The proper-noun step is re-aimed from a per-row tagger to a *table*: a lexicon
of word forms that the corpus itself writes capitalised mid-sentence. It is
built by one aggregate (map-side combined, so hot forms do not skew) and joined
to the distinct word forms of each report; the names found come back as one
short list per report, by which the projection filters its tokens. The plan is
the same for a lexicon of any size: Spark broadcasts it if it measures small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..functions import text as T


def _capitalised(tok: Column) -> Column:
    first = F.substring(tok, 1, 1)
    return first != F.lower(first)


def proper_noun_lexicon(docs: DataFrame, text_col: str = "content",
                        cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Word forms (lowercase) capitalised in at least ``lexicon_min_capital_share``
    of their mid-sentence occurrences, seen at least ``lexicon_min_count`` times.

    Mid-sentence: not the first token, and the previous token holds none of
    ``. ! ?``. Letters-only tokens only.
    """
    # tokens once per row, then the previous token by position (a lambda that
    # called the tokenizer itself would re-run it per element)
    toks = docs.select(T.tokenize(F.col(text_col)).alias("_t"))
    t = F.col("_t")
    ends = lambda s: s.contains(".") | s.contains("!") | s.contains("?")
    mid = F.filter(t, lambda x, i: (i > 0) & ~ends(F.get(t, i - 1)))
    # occurrences are counted as written; the letters are looked at once per written form
    written = T.explode_rows(toks, mid, "tok").groupBy("tok").agg(F.count(F.lit(1)).alias("_n"))
    forms = written.where(F.col("tok").rlike(r"^\p{L}+$")).select(
        F.lower("tok").alias("form"), "_n", F.when(_capitalised(F.col("tok")), F.col("_n")).otherwise(0).alias("_cap"))
    agg = forms.groupBy("form").agg(F.sum("_n").alias("n"), F.sum("_cap").alias("n_cap"))
    return (agg.where((F.col("n") >= cfg.lexicon_min_count)
                      & (F.col("n_cap") >= F.col("n") * F.lit(cfg.lexicon_min_capital_share)))
            .select("form"))


def _bypass(tok: Column, keep_words) -> Column:
    """Tokens never dropped as names: those with a digit or in the keep list."""
    cond = tok.rlike(r"\p{Nd}")
    if keep_words:
        cond = cond | tok.isin(list(keep_words))
    return cond


def names_found(df: DataFrame, id_col: str, tokens: Column, lexicon: DataFrame, keep_words) -> DataFrame:
    """(id, _names): the lexicon words among a report's tokens, bypassed tokens left out; only reports
    that hold one. A report's distinct forms meet the lexicon, never its text."""
    each = df.select(id_col, F.array_distinct(tokens).alias("_d"))
    forms = F.array_distinct(F.transform(F.filter("_d", lambda x: ~_bypass(x, keep_words)), F.lower))
    return (T.explode_rows(each.select(id_col, forms.alias("_f")), F.col("_f"), "form", id_col)
            .join(lexicon, "form").groupBy(id_col).agg(F.collect_set("form").alias("_names")))


def _without_names(tokens_col: str, keep_words) -> Column:
    kept = F.filter(tokens_col, lambda x: _bypass(x, keep_words) | ~F.array_contains("_names", F.lower(x)))
    return F.when(F.col("_names").isNull(), F.col(tokens_col)).otherwise(kept)


def drop_proper_nouns(df: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame, keep_words) -> DataFrame:
    """``tokens_col`` without the lexicon's words, bypassed tokens kept; a NULL list stays NULL.

    Rows that share an id share the names found, all of them lexicon words."""
    out = df.join(names_found(df, id_col, F.col(tokens_col), lexicon, keep_words), id_col, "left")
    return out.withColumn(tokens_col, _without_names(tokens_col, keep_words)).drop("_names")


def clean_reports(df: DataFrame, cfg: CleanConfig = CleanConfig(), text_col: str = "content",
                  id_col: str = "report_id", lexicon: DataFrame | None = None) -> DataFrame:
    """The whole cleaning pipeline, steps in the reference order
    (T1 -> T2 -> T3 -> T1 -> T4 -> T5 -> T6 -> T7 -> T8 -> T9).

    Adds ``orig_tokens``, ``tokens``, ``clean_text``, ``n_orig_tokens``,
    ``n_tokens``, ``has_indication``, ``has_description``.
    """
    out = df
    if cfg.remove_proper_nouns:
        if lexicon is None:
            lexicon = proper_noun_lexicon(df, text_col, cfg)
        # the names come to the text, which is cut into tokens where it then stands
        out = df.join(names_found(df, id_col, T.tokenize(F.col(text_col)), lexicon, cfg.keep_words), id_col, "left")
    out = out.withColumn("orig_tokens", T.tokenize(F.col(text_col)))
    if cfg.remove_proper_nouns:
        s = T.join_tokens(_without_names("orig_tokens", cfg.keep_words))
    else:
        s = F.col(text_col)
    if cfg.lowercase:
        s = F.lower(s)
    tok = T.tokenize(s)
    if cfg.remove_punctuation:
        tok = T.drop_punctuation(tok)
    if cfg.remove_stopwords:
        tok = T.drop_words(tok, cfg.stop_words)
    if cfg.remove_custom_words:
        tok = T.drop_words(tok, cfg.custom_words)
    out = out.withColumn("tokens", tok)
    if cfg.from_indication_onward:
        out = out.withColumn("has_indication",
                             T.last_marker_index("tokens", cfg.indication_markers).isNotNull())
        out = out.withColumn("tokens", T.after_last_marker("tokens", cfg.indication_markers))
    else:
        out = out.withColumn("has_indication", F.lit(None).cast("boolean"))
    if cfg.from_description_onward:
        out = out.withColumn("has_description",
                             T.last_marker_index("tokens", cfg.description_markers).isNotNull())
        out = out.withColumn("tokens", T.after_last_marker("tokens", cfg.description_markers))
    else:
        out = out.withColumn("has_description", F.lit(None).cast("boolean"))
    if cfg.remove_proper_nouns:
        out = out.select(*df.columns, *[c for c in out.columns if c not in (*df.columns, "_names")])
    return (out.withColumn("clean_text", T.join_tokens("tokens"))
               .withColumn("n_orig_tokens", F.size("orig_tokens").cast("long"))
               .withColumn("n_tokens", F.size("tokens").cast("long")))


def missing_sections(cleaned: DataFrame) -> DataFrame:
    """How many reports lack the indication / description marker."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.sum(F.when(F.col("has_indication") == F.lit(False), 1).otherwise(0)).cast("long")
        .alias("n_without_indication"),
        F.sum(F.when(F.col("has_description") == F.lit(False), 1).otherwise(0)).cast("long")
        .alias("n_without_description"))

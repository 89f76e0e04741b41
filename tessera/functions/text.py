"""Column expressions for one report row -> tokens.

All are built-in higher-order functions, so they stay inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DATE_WORDS

# Word runs or punctuation runs (a word/punctuation tokenizer). Whitespace is
# spelled out so that Java and RE2 agree with Python's notion of blank.
_BLANK = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _BLANK + r"]+"
ALNUM_PATTERN = r"^[\p{L}\p{N}]+$"
# Vectorizer tokens: runs of at least two word characters.
VECTORIZER_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text) -> Column:
    """word/punctuation tokens of a string, in order."""
    return F.regexp_extract_all(_col(text), F.lit(TOKEN_PATTERN), 0)


def vectorizer_tokens(text, lowercase: bool = True) -> Column:
    """Lowercase, words of two or more word characters."""
    t = _col(text)
    return F.regexp_extract_all(F.lower(t) if lowercase else t, F.lit(VECTORIZER_PATTERN), 0)


def date_like(tok: Column) -> Column:
    """Tokens with '_' that a fuzzy date parser reads as a date: a digit or a
    month/weekday name among the '_'-separated parts."""
    parts = F.split(F.lower(tok), "_")
    has_date_word = F.exists(parts, lambda p: p.isin(list(DATE_WORDS)))
    return tok.contains("_") & (tok.rlike(r"\d") | has_date_word)


def drop_punctuation(tokens) -> Column:
    """T4: keep alphanumeric tokens and date-like tokens."""
    return F.filter(_col(tokens), lambda x: x.rlike(ALNUM_PATTERN) | date_like(x))


def drop_words(tokens, words: Sequence[str]) -> Column:
    """Remove every token equal to one of ``words`` (order and repeats kept)."""
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda x: ~x.isin(list(words)))


def last_marker_index(tokens, markers: Sequence[str]) -> Column:
    """0-based index of the last marker token, NULL when there is none."""
    return F.array_max(F.transform(_col(tokens), lambda x, i: F.when(x.isin(list(markers)), i)))


def after_last_marker(tokens, markers: Sequence[str]) -> Column:
    """Tokens after the last marker; the whole list when no marker."""
    t = _col(tokens)
    idx = last_marker_index(t, markers)
    return F.when(idx.isNull(), t).otherwise(F.slice(t, idx + 2, F.greatest(F.size(t), F.lit(1))))


def join_tokens(tokens) -> Column:
    """Tokens joined by a blank."""
    return F.array_join(_col(tokens), " ")


def round_half_up(x, decimals: int = 0) -> Column:
    """Round half up (floor(x*10^d + 0.5) / 10^d), as DOUBLE."""
    m = float(10 ** decimals)
    return F.floor(_col(x).cast("double") * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)


def _gram_at(w: Column, n: int):
    """Lambda (1-based start -> n-gram) with n bound; a one-argument function,
    since a second parameter would be read as the element index."""
    return lambda i: F.array_join(F.slice(w, i, n), " ")


def ngrams(words, n_max: int, n_min: int = 1) -> Column:
    """All word n-grams for n in n_min..n_max, joined by a blank, grouped by n."""
    w = _col(words)
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(w)
            continue
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), _gram_at(w, n))
        parts.append(F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def ngrams_with_n(words, n_max: int) -> Column:
    """E2 as (term, n) structs, so that no term has to be split again to learn its n."""
    w = _col(words)
    empty = F.array().cast("array<struct<term:string,n:int>>")

    def of(n: int) -> Column:
        # grams come from the word list alone; the lambda binds n, not the element index
        grams = w if n == 1 else F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), _gram_at(w, n))
        tagged = F.transform(grams, lambda g: F.struct(g.alias("term"), F.lit(n).alias("n")))
        return F.when(F.size(w) >= n, tagged).otherwise(empty)

    return F.concat(*[of(n) for n in range(1, n_max + 1)])


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: named in a lambda's body, an expression would be
    worked out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(items: Column, **fields: Column) -> Column:
    """The distinct strings of an array with their counts, as structs (term, the further ``fields``, tf):
    equal strings stand together once sorted, so a count is the distance to the next start."""
    def runs(g):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(g), F.lit(1))), lambda i: (i <= F.size(g)) & (
            (i == 1) | (F.get(g, i - 1) != F.get(g, i - 2))))
        return let(starts, lambda s: F.transform(s, lambda at, j: F.struct(
            F.get(g, at - 1).alias("term"), *[c.alias(k) for k, c in fields.items()],
            (F.coalesce(F.get(s, j + 1), F.size(g) + 1) - at).cast("long").alias("tf"))))

    return let(F.sort_array(items), runs)


def explode_rows(df, array_col, alias: str, *keep, pos: str | None = None):
    """One row per array element. ``explode_outer`` + a null filter instead of
    ``explode``: for ``explode`` the optimizer infers ``size(array) > 0`` and
    pushes it below the projection, which re-evaluates the whole array
    expression (tokenizer, n-grams) a second time, inside lambdas per element."""
    from pyspark.sql import functions as F
    if pos is None:
        out = df.select(*keep, F.explode_outer(array_col).alias(alias))
    else:
        out = df.select(*keep, F.posexplode_outer(array_col).alias(pos, alias))
    return out.where(F.col(alias).isNotNull())

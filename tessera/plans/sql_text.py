"""DuckDB text of the cleaning pipeline, used only by the oracle SQL.

It restates the Spark expressions of ``functions.text`` / ``operators.clean``
in DuckDB's dialect (1-based lambda index, inclusive slices).
"""

from __future__ import annotations

from ..config import DATE_WORDS, CleanConfig
from ..functions.text import ALNUM_PATTERN, TOKEN_PATTERN


def _in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def tokenize(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{TOKEN_PATTERN}')"


def date_like(x: str) -> str:
    return (f"(contains({x}, '_') AND (regexp_matches({x}, '\\d') OR "
            f"len(list_filter(string_split(lower({x}), '_'), lambda q: q IN {_in_list(DATE_WORDS)})) > 0))")


def clean_ctes(src: str = "reports", cfg: CleanConfig = CleanConfig()) -> list[str]:
    """CTEs ending in ``cleaned(report_id, ot, tokens, has_indication)``."""
    ctes = [f"c_tok0 AS (SELECT *, {tokenize('content')} AS ot FROM {src})"]
    if cfg.remove_proper_nouns:
        ctes.append(
            "c_lex_occ AS (SELECT unnest(list_filter(list_transform(ot, lambda x, i: "
            "{'tok': x, 'prev': CASE WHEN i > 1 THEN ot[i - 1] END}), lambda p: p.prev IS NOT NULL "
            "AND NOT regexp_matches(p.prev, '[.!?]') AND regexp_full_match(p.tok, '\\p{L}+'))) AS p FROM c_tok0)")
        ctes.append(
            "c_lex AS (SELECT list(form) AS forms FROM (SELECT lower(p.tok) AS form, count(*) AS n, "
            "sum(CASE WHEN substr(p.tok, 1, 1) <> lower(substr(p.tok, 1, 1)) THEN 1 ELSE 0 END) AS n_cap "
            f"FROM c_lex_occ GROUP BY 1) WHERE n >= {cfg.lexicon_min_count} "
            f"AND n_cap >= n * {cfg.lexicon_min_capital_share}::DOUBLE)")
        keep = f" OR x IN {_in_list(cfg.keep_words)}" if cfg.keep_words else ""
        s = ("array_to_string(list_filter(ot, lambda x: regexp_matches(x, '\\p{Nd}')" + keep +
             " OR NOT list_contains(coalesce(c_lex.forms, []), lower(x))), ' ')")
        ctes.append(f"c_s AS (SELECT c_tok0.*, {s} AS s FROM c_tok0 CROSS JOIN c_lex)")
    else:
        ctes.append("c_s AS (SELECT *, content AS s FROM c_tok0)")
    s = "lower(s)" if cfg.lowercase else "s"
    t = tokenize(s)
    if cfg.remove_punctuation:
        t = f"list_filter({t}, lambda x: regexp_full_match(x, '{ALNUM_PATTERN[1:-1]}') OR {date_like('x')})"
    if cfg.remove_stopwords:
        t = f"list_filter({t}, lambda x: NOT x IN {_in_list(cfg.stop_words)})"
    if cfg.remove_custom_words:
        t = f"list_filter({t}, lambda x: NOT x IN {_in_list(cfg.custom_words)})"
    ctes.append(f"c_t AS (SELECT *, {t} AS t1 FROM c_s)")
    if cfg.from_indication_onward:
        idx = f"list_max(list_transform(t1, lambda x, i: CASE WHEN x IN {_in_list(cfg.indication_markers)} THEN i END))"
        ctes.append(f"c_i AS (SELECT *, {idx} AS ind FROM c_t)")
        ctes.append("c_i2 AS (SELECT *, ind IS NOT NULL AS has_indication, "
                    "CASE WHEN ind IS NULL THEN t1 ELSE t1[ind + 1:] END AS t2 FROM c_i)")
    else:
        ctes.append("c_i2 AS (SELECT *, NULL::BOOLEAN AS has_indication, t1 AS t2 FROM c_t)")
    if cfg.from_description_onward:
        idx = f"list_max(list_transform(t2, lambda x, i: CASE WHEN x IN {_in_list(cfg.description_markers)} THEN i END))"
        ctes.append(f"c_d AS (SELECT *, {idx} AS des FROM c_i2)")
        ctes.append("cleaned AS (SELECT *, des IS NOT NULL AS has_description, "
                    "CASE WHEN des IS NULL THEN t2 ELSE t2[des + 1:] END AS tokens FROM c_d)")
    else:
        ctes.append("cleaned AS (SELECT *, NULL::BOOLEAN AS has_description, t2 AS tokens FROM c_i2)")
    return ctes
